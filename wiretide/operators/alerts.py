"""Alert normalisation, severity, cooldown and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.config import DAY_US, SECOND_US, CooldownConfig
from wiretide.operators.chain import greedy_chain, materialize


def severity(confidence: Column) -> Column:
    return (F.when(confidence >= 0.90, F.lit("CRITICAL")).when(confidence >= 0.80, F.lit("HIGH"))
            .when(confidence >= 0.70, F.lit("MEDIUM")).otherwise(F.lit("LOW")))


# What an alert shows for a flow field that is missing
_MISSING = {"flow_id": "0.0.0.0:0->0.0.0.0:0_OTHER", "src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "src_port": 0,
            "dst_port": 0, "protocol": "OTHER", "threat_class": "UNKNOWN", "confidence_score": 0.0, "evidence": "{}"}


def to_alerts(detections: DataFrame) -> DataFrame:
    """The standard alert layout plus ``dedup_key``. The time is traffic time where there is any."""
    filled = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in _MISSING.items()}
    key = F.coalesce(F.col("dedup_key"), F.concat(filled["src_ip"], F.lit("->"), filled["dst_ip"]))
    return detections.select(
        F.coalesce(F.timestamp_micros("ts_us"), F.current_timestamp()).alias("ts"),
        *[filled[name].alias(name) for name in ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "threat_class")],
        severity(filled["confidence_score"]).alias("severity"), filled["confidence_score"].alias("confidence_score"),
        filled["evidence"].alias("evidence"),
        F.concat(key, F.lit("_"), filled["threat_class"]).alias("dedup_key"),
        *[name for name in ("order_us", "kind", "explain_class", "features") if name in detections.columns])


def suppress_repeats(alerts: DataFrame, cfg: CooldownConfig = CooldownConfig(), key: str = "dedup_key") -> DataFrame:
    """Publish an alert unless one with the same key was published less than the cooldown before.

    Suppressed alerts do not extend the cooldown. Of alerts with equal key and time the first by flow,
    class and ``order_us`` is the one considered.
    """
    # Alerts are few next to what they were computed from, and are read several times below
    rows = materialize(alerts.withColumn("_us", F.unix_micros("ts")))
    kept = greedy_chain(rows, [key], "_us", cfg.cooldown_us)
    columns = alerts.columns
    order = ["flow_id", "threat_class", *(["order_us"] if "order_us" in columns else ["id"] if "id" in columns else []), "evidence"]
    first = (rows.groupBy(key, "_us")
             .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("a")))
    return first.join(kept, [key, "_us"], "left_semi").select("a.*")


def with_ids(alerts: DataFrame, after: int | Column = 0, bucket_us: int = SECOND_US) -> DataFrame:
    """Dense ids in (ts, flow_id, threat_class) order, counted on from ``after``.

    Rows are numbered inside short time buckets; only one count per day is accumulated globally.
    """
    rows = alerts.withColumn("_bucket", F.floor(F.unix_micros("ts") / F.lit(bucket_us)))
    # Bucket counts are accumulated inside their day, and only one count per day over all days
    counts = (rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
              .withColumn("_day", F.floor(F.col("_bucket") * F.lit(bucket_us) / F.lit(DAY_US))))
    before = Window.unboundedPreceding, -1
    days = (counts.groupBy("_day").agg(F.sum("_n").alias("_of_day"))
            .withColumn("_days", F.coalesce(F.sum("_of_day").over(Window.orderBy("_day").rowsBetween(*before)), F.lit(0))))
    in_day = Window.partitionBy("_day").orderBy("_bucket").rowsBetween(*before)
    base = (counts.withColumn("_in_day", F.coalesce(F.sum("_n").over(in_day), F.lit(0))).join(days, "_day")
            .select("_bucket", (F.col("_days") + F.col("_in_day")).alias("_base")))
    inside = Window.partitionBy("_bucket").orderBy("ts", "flow_id", "threat_class")
    start = after if isinstance(after, Column) else F.lit(after)
    return (rows.withColumn("_row", F.row_number().over(inside)).join(base, "_bucket")
            .withColumn("id", (start + F.col("_base") + F.col("_row")).cast("long"))
            .select("id", *alerts.columns))
