"""Streaming host windows. The grid is anchored at the epoch, since a stream has no first packet.

Two chained stateful aggregations: closed panes of packets, then closed windows of pane rows. The second one keeps a row
per window and facet, in the layout of the batch plan, and all rows of a window leave it in one micro-batch. What follows
(totals, top sources, probed ports) is the batch code on the rows of closed windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.config import SECOND_US, WindowConfig
from wiretide.operators.windows import protocol_parts
from wiretide.schema import half_open, is_probe, normalize_packets

LATENESS = "2 seconds"


def _sliding(time: Column, cfg: WindowConfig) -> Column:
    size, slide = f"{cfg.size_us} microseconds", f"{cfg.slide_us} microseconds"
    return F.window(time, size) if size == slide else F.window(time, size, slide)


def facet_stream(packets: DataFrame, cfg: WindowConfig = WindowConfig(), lateness: str = LATENESS) -> DataFrame:
    """Rows of closed windows: per target and source (facet ``source``), per target and port (``port``), and per source,
    target and port (``pair``), the two ends in ``host`` and ``other``."""
    probe = is_probe()
    panes = (normalize_packets(packets.withWatermark("ts", lateness))
             .groupBy(F.window("ts", f"{cfg.pane_us} microseconds").alias("pane"), "src_ip", "dst_ip", "dst_port", "protocol")
             .agg(F.count("*").alias("packets"), F.sum("packet_length").cast("long").alias("bytes"), F.count_if(half_open()).alias("syn_only"),
                  F.count_if(probe).alias("probes"), F.min("pkt_id").alias("first_pkt"), F.min(F.when(probe, F.col("pkt_id"))).alias("first_probe"),
                  F.min("ts_us").alias("first_ts_us"), F.max("ts_us").alias("last_ts_us")))
    rows = panes.withColumn("w", _sliding(F.window_time("pane"), cfg))
    rows = rows.withColumn("second", F.floor((F.unix_micros("pane.start") - F.unix_micros("w.start")) / F.lit(SECOND_US)))
    none = F.lit(None)
    facets = F.array(F.struct(F.lit("source").alias("facet"), F.col("dst_ip").alias("host"), F.col("src_ip").alias("other"), none.cast("int").alias("port")),
                     F.struct(F.lit("port").alias("facet"), F.col("dst_ip").alias("host"), none.cast("string").alias("other"), F.col("dst_port").alias("port")),
                     F.struct(F.lit("pair").alias("facet"), F.col("src_ip").alias("host"), F.col("dst_ip").alias("other"), F.col("dst_port").alias("port")))
    seconds = [F.sum(F.when(F.col("second") == i, F.col("packets")).otherwise(F.lit(0))).alias(f"second_{i}") for i in range(cfg.seconds)]
    closed = (rows.withColumn("f", F.explode(facets)).groupBy("w", "f")
              .agg(*(F.sum(c).alias(c) for c in ("packets", "bytes", "syn_only", "probes")),
                   *(F.min(c).alias(c) for c in ("first_pkt", "first_probe", "first_ts_us")), F.max("last_ts_us").alias("last_ts_us"),
                   *seconds, *protocol_parts()))
    return closed.select(F.unix_micros("w.start").alias("window_start_us"), "f.*", *[c for c in closed.columns if c not in ("w", "f")])


def target_rows(closed: DataFrame) -> DataFrame:
    """Closed rows in the layout of ``target_facets``."""
    return (closed.filter("facet <> 'pair'").drop("probes", "first_probe")
            .withColumnsRenamed({"host": "dst_ip", "other": "src_ip", "port": "dst_port", "packets": "n"}))


def pair_rows(closed: DataFrame) -> DataFrame:
    """Closed rows in the layout of ``probe_pairs``."""
    unused = [c for c in closed.columns if c.startswith("second_")]
    return (closed.filter("facet = 'pair'").drop("facet", "bytes", "syn_only", "first_pkt", *unused)
            .withColumnsRenamed({"host": "src_ip", "other": "dst_ip", "port": "dst_port"}))


def until_last_window(closed: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Of the windows that were still open at the end of a stream, those that the batch grid has: up to the first one that
    was open when the last packet came."""
    last = closed.agg(F.max("last_ts_us").alias("t")).scalar()
    first_open = F.floor((last - F.lit(cfg.size_us)) / F.lit(cfg.slide_us)) + 1
    return closed.filter(F.col("window_start_us") <= F.greatest(first_open, F.lit(0)) * F.lit(cfg.slide_us))
