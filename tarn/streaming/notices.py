"""Notices that cross processes: files in a shared folder, followed by Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEMA = "channel string, payload string, at timestamp"


def send(spark: SparkSession, folder: str, channel: str, payload: str = "") -> None:
    spark.range(1).select(F.lit(channel).alias("channel"), F.lit(payload).alias("payload"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(folder)


def follow(spark: SparkSession, folder: str, channel: str, handler: Callable[[str], None], checkpoint: str, once: bool = False):
    """Calls ``handler`` for each notice of a channel exactly as often as it was sent, also after a restart from ``checkpoint``."""

    def each(batch, _):
        for row in batch.orderBy("at").toLocalIterator():
            handler(row["payload"])

    notices = spark.readStream.schema(SCHEMA).json(folder).where(F.col("channel") == channel)
    writer = notices.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(f"notices-{uuid.uuid4().hex}")
    return (writer.trigger(availableNow=True) if once else writer).start()
