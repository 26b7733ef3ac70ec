"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir`` (or a checkpoint folder already set on the context). Only a local
    master may fall back to a temporary folder: on a cluster the executors would not share it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@lru_cache(maxsize=8)
def _session_folder(root: str, application: str) -> str:
    """One folder below the root for all intermediate tables of an application, deleted when it ends."""
    context = SparkContext.getOrCreate()
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{root}/lodestar-{application}-{uuid.uuid4().hex[:8]}")
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return folder.toString()


_collectors: ContextVar[tuple[list[str], ...]] = ContextVar("collectors", default=())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one intermediate table."""
    folder = _session_folder(checkpoint_root(spark), spark.sparkContext.applicationId)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    for paths in _collectors.get():
        paths.append(path)
    return path


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of all intermediate tables made inside, for ``discard`` once their readers are done."""
    paths: list[str] = []
    before = _collectors.set((*_collectors.get(), paths))
    try:
        yield paths
    finally:
        _collectors.reset(before)


def stored_path(spark: SparkSession, path: str):
    """A path, and the file system that it is on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables before the session ends."""
    for path in paths:
        target, files = stored_path(spark, path)
        files.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    target, files = stored_path(spark, path)
    files.mkdirs(target)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder, if it is there, to a name that is free."""
    place, files = stored_path(spark, source)
    if files.exists(place) and not files.rename(place, stored_path(spark, target)[0]):
        raise OSError(f"{source} could not be moved to {target}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives the loss of executors, and gives later stages exact sizes
    and column pruning.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*jobs: Callable):
    """Results of independent jobs, submitted at once so that small ones share the cluster."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [running.result() for running in [pool.submit(job) for job in jobs]]


def local_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A list as a DataFrame that is part of the plan: Spark knows its size in bytes, so it is broadcast in a join
    only where the session's threshold allows it, and no Python worker is started for it."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow))
