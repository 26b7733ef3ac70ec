"""Versions of a stored thing: a folder of small numbered files, of which the last one says what there is.

A version is written under another name and renamed, and a rename never replaces a file. So readers see the old version or
the new one, a writer that dies leaves the old one, and of two writers that start from the same version one is refused.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from lodestar.session import stored_path

FOLDER = "versions"


class Conflict(RuntimeError):
    """Another writer published this version first."""


def last_version(spark: SparkSession, path: str) -> int | None:
    """Number of the last version, or None."""
    folder, files = stored_path(spark, f"{path}/{FOLDER}")
    if not files.exists(folder):
        return None
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return max((int(name) for name in names if name.isdigit()), default=None)


def read_version(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The last version: its number and content."""
    number = last_version(spark, path)
    if number is None:
        raise FileNotFoundError(f"nothing is stored in {path}")
    return number, json.loads(spark.read.text(f"{path}/{FOLDER}/{number:010d}", wholetext=True).first()[0])


def publish_version(spark: SparkSession, path: str, after: int | None, content: dict) -> int:
    """Make ``content`` the version that follows ``after`` (None: the first)."""
    number = 0 if after is None else after + 1
    draft, files = stored_path(spark, f"{path}/{FOLDER}/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    final, _ = stored_path(spark, f"{path}/{FOLDER}/{number:010d}")
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    never = context._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration()).rename(draft, final, never)
    except Py4JJavaError as failed:
        files.delete(draft, False)
        if files.exists(final):
            raise Conflict(f"version {number} of {path} was published by another writer") from failed
        raise
    return number
