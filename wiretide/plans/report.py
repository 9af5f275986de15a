"""Tables of the incident report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiretide.functions.text import parsed
from wiretide.plans.analytics import most_severe
from wiretide.plans.catalog import pick
from wiretide.plans.response import with_rules


def incidents(alerts: DataFrame, limit: int = 50, tag: str = "THREAT") -> DataFrame:
    """The most severe alerts with technique, recommended action and rules."""
    return with_rules(most_severe(alerts, limit), tag).withColumn("mitre_id", pick(F.col("threat_class"), 3))


def evidence_rows(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """One row per evidence item of the most severe alerts."""
    items = F.from_json(parsed(F.col("evidence")), "map<string,string>")
    return (most_severe(alerts, limit)
            .select("id", F.explode(F.map_entries(items)).alias("e"))
            .select("id", F.initcap(F.replace(F.col("e.key"), F.lit("_"), F.lit(" "))).alias("item"),
                    F.col("e.value").alias("value")))


def technique_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per detected class with its technique; classes outside the catalogue keep their name."""
    cls = F.col("threat_class")
    return (alerts.groupBy("threat_class").agg(F.count("*").alias("n"))
            .select("threat_class", F.coalesce(pick(cls, 3), F.lit("—")).alias("mitre_id"),
                    F.coalesce(pick(cls, 5), F.lit("—")).alias("tactic"),
                    F.coalesce(pick(cls, 4), cls).alias("technique"), "n"))
