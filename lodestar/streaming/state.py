"""State of a foreachBatch query that survives restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import local_frame


class BatchState:
    """A small table carried from batch to batch in the shared folder.

    Batch b reads what batch b - 1 left and writes the other of two slots. A batch that is run again after a
    failure therefore finds the same input, and storage does not grow with the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch_id: int) -> DataFrame:
        """State left by the batch before this one."""
        if batch_id == 0:
            return local_frame(self.spark, [], self.schema)
        return self._slot(batch_id - 1).filter(F.col("batch_id") == batch_id - 1).drop("batch_id")

    def save(self, state: DataFrame, batch_id: int) -> None:
        stamped = state.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        stamped.write.mode("overwrite").parquet(f"{self.path}/slot-{batch_id % 2}")

    def latest(self) -> DataFrame:
        """State of the last finished batch, whichever slot holds it. To be read while no batch runs."""
        slots = self._read(f"{self.path}/slot-*")
        last = slots.agg(F.max("batch_id")).first()[0]
        return slots.filter(F.col("batch_id") == F.lit(last)).drop("batch_id")

    def _slot(self, batch_id: int) -> DataFrame:
        return self._read(f"{self.path}/slot-{batch_id % 2}")

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch_id bigint").parquet(path)
