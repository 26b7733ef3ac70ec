"""Point messages on a topic: Kafka where its connector is present, a folder of text files anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.codec import encode_point


def publish_points(points: DataFrame, options: dict[str, str], distances=None) -> None:
    """Send each point as JSON.

    ``options`` with ``path`` write a folder; otherwise they are the Kafka options (``topic``,
    ``kafka.bootstrap.servers``, ...).
    """
    messages = points.select(encode_point(distances=distances).alias("value"))
    if "path" in options:
        messages.write.mode("append").text(options["path"])
    else:
        messages.write.format("kafka").options(**options).save()


def stream_messages(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Stream of messages ``(value)`` from the start of the topic.

    ``options`` with ``path`` read a folder, taking ``maxFilesPerTrigger`` along; otherwise they are the Kafka
    options (``subscribe``, ``kafka.bootstrap.servers``, ``maxOffsetsPerTrigger``, ...).
    """
    if "path" in options:
        return spark.readStream.format("text").options(**options).load()
    options = {"startingOffsets": "earliest", **options}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string"))
