"""Record layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")
PROTOCOLS = ("TCP", "UDP", "ICMP", "OTHER")
FLOW_KEY = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")

PACKET_SCHEMA = T.StructType([
    T.StructField("pkt_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("src_port", T.IntegerType(), False),
    T.StructField("dst_port", T.IntegerType(), False),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("packet_length", T.IntegerType(), False),
    T.StructField("payload_length", T.IntegerType(), False),
    *[T.StructField(flag, T.BooleanType(), False) for flag in FLAGS],
    T.StructField("raw_payload", T.BinaryType(), True),
])

ALERT_COLUMNS = ("ts", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                 "threat_class", "severity", "confidence_score", "evidence")

ALERT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("threat_class", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("evidence", T.StringType()),
])


def flow_id(src="src_ip", sport="src_port", dst="dst_ip", dport="dst_port", proto="protocol") -> Column:
    """``src:sport->dst:dport_PROTO``."""
    return F.format_string("%s:%s->%s:%s_%s", F.col(src), F.col(sport).cast("string"), F.col(dst),
                           F.col(dport).cast("string"), F.col(proto))


def normalize_packets(packets: DataFrame) -> DataFrame:
    """Add what an operator may rely on: ``ts_us``, flag columns and a known protocol name."""
    present = set(packets.columns)
    added = {flag: F.coalesce(F.col(flag), F.lit(False)) if flag in present else F.lit(False) for flag in FLAGS}
    if "ts_us" not in present:
        added["ts_us"] = F.unix_micros("ts")
    added["protocol"] = F.when(F.col("protocol").isin(*PROTOCOLS[:3]), F.col("protocol")).otherwise(F.lit("OTHER"))
    return packets.withColumns(added)


def half_open(syn="syn", ack="ack") -> Column:
    """A SYN that is not part of a handshake reply."""
    return F.col(syn) & ~F.col(ack)


def is_probe() -> Column:
    """A packet that opens a conversation without carrying data."""
    return (F.when(F.col("protocol") == "TCP", half_open())
            .when(F.col("protocol") == "UDP", F.col("payload_length") == 0)
            .otherwise(F.col("protocol") == "ICMP"))
