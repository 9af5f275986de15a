"""Packet tables, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wiretide.schema import PACKET_SCHEMA


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKET_SCHEMA).parquet(path)


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Packet files as they arrive."""
    return (spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def capped(packets: DataFrame, limit: int, per: list[str] | None = None) -> DataFrame:
    """The first ``limit`` packets per capture in arrival order.

    Captures are told apart by ``per``, by default by their ``path`` where there is one. Only packets count, not frames
    that hold none. The rank limit is pushed below the shuffle, so a task sends at most ``limit`` rows per capture.
    """
    if per is None and "path" in packets.columns:
        per = ["path"]
    if not per:
        return packets.orderBy("pkt_id").limit(limit)
    order = Window.partitionBy(*per).orderBy("pkt_id")
    return packets.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= limit).drop("_row")
