"""Analyst queries over the alert table. Each takes alerts and returns a small or streaming-safe result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.functions.text import describe, field, parsed, title
from wiretide.plans import catalog
from wiretide.plans.catalog import CLASSES, SEVERITIES, level, pick, rank, short_name

LEVELS = tuple(row[0] for row in SEVERITIES)
URGENT = ("CRITICAL", "HIGH")


def filter_alerts(alerts: DataFrame, last_minutes: int | None = None, severities: list[str] | None = None,
                  classes: list[str] | None = None, ip: str | None = None) -> DataFrame:
    """Global filter. The time window counts back from the latest alert; an empty list filters nothing."""
    out = alerts
    if last_minutes:
        latest = alerts.agg(F.max("ts")).scalar()
        out = out.filter(F.col("ts") >= latest - F.expr(f"interval {int(last_minutes)} minutes"))
    if severities:
        out = out.filter(F.col("severity").isin(*severities))
    if classes:
        out = out.filter(F.col("threat_class").isin(*classes))
    if ip and ip.strip():
        out = out.filter(F.col("src_ip").contains(ip.strip()) | F.col("dst_ip").contains(ip.strip()))
    return out


def since(alerts: DataFrame, seen_id: int) -> DataFrame:
    """Alerts newer than a high-water mark."""
    return alerts.filter(F.col("id") > seen_id)


def high_water_mark(alerts: DataFrame, seen_id: int) -> DataFrame:
    return alerts.agg(F.greatest(F.lit(seen_id).cast("long"), F.coalesce(F.max("id"), F.lit(0).cast("long"))).alias("seen_id"),
                      F.count_if(F.col("id") > seen_id).alias("unread"))


def latest(alerts: DataFrame, limit: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("id")).limit(limit)


def page(alerts: DataFrame, number: int, size: int = 15) -> DataFrame:
    """One page of the feed, newest first; a page past the end shows the last one."""
    total = alerts.agg(F.count("*")).first()[0]
    last = max(0, -(-total // size) - 1)
    return alerts.orderBy(F.desc("id")).offset(min(max(0, number), last) * size).limit(size)


def latest_urgent(alerts: DataFrame, limit: int = 5) -> DataFrame:
    return latest(alerts.filter(F.col("severity").isin(*URGENT)), limit)


def alert_details(alerts: DataFrame, alert_id: int) -> DataFrame:
    """One alert with its evidence split into one row per item."""
    ev = F.from_json(parsed(F.col("evidence")), "map<string,string>")
    return (alerts.filter(F.col("id") == alert_id)
            .select("id", "threat_class", "severity", F.explode_outer(F.map_entries(ev)).alias("item"))
            .select("id", "threat_class", "severity", F.col("item.key").alias("item"), F.col("item.value").alias("value")))


# ---- overview -----------------------------------------------------------------------------------

def severity_counts(alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy(level(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))
    return (catalog.severities(alerts.sparkSession).join(counts, "severity", "left").fillna({"n": 0})
            .select("severity", "severity_rank", "n"))


def threat_posture(alerts: DataFrame) -> DataFrame:
    sev = level(F.col("severity"))
    counts = alerts.agg(F.count_if(sev == "CRITICAL").alias("critical"), F.count_if(sev == "HIGH").alias("high"),
                        F.count_if(sev == "MEDIUM").alias("medium"), F.count("*").alias("alerts"), F.max("ts").alias("last_ts"))
    return counts.withColumn("posture", F.when(F.col("critical") >= 5, "Critical")
                             .when((F.col("critical") >= 1) | (F.col("high") >= 5), "Elevated")
                             .when(F.col("high") >= 1, "Guarded").otherwise("Nominal"))


def kpis(alerts: DataFrame) -> DataFrame:
    sev = level(F.col("severity"))
    return alerts.agg(F.count("*").alias("alerts"), F.count_if(sev == "CRITICAL").alias("critical"),
                      F.count_if(sev == "HIGH").alias("high"), F.count_distinct("src_ip").alias("sources"),
                      F.count_distinct("threat_class").alias("vectors"), F.avg("confidence_score").alias("mean_confidence"))


def vector_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per threat class; classes without alerts are shown."""
    counts = alerts.groupBy("threat_class").agg(F.count("*").alias("n"))
    return (catalog.threats(alerts.sparkSession).join(counts, "threat_class", "left").fillna({"n": 0})
            .select("threat_class", "short", "mitre_id", "n").orderBy("n", "threat_class"))


def severity_mix(alerts: DataFrame) -> DataFrame:
    """Share of each level that occurs. The total runs over four rows at most."""
    counts = alerts.groupBy(level(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))
    total = alerts.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def timeline(alerts: DataFrame) -> DataFrame:
    """One point per alert; sorted by the caller if at all."""
    return alerts.select("id", "ts", short_name(F.col("threat_class")).alias("vector"), "severity", "src_ip", "dst_ip",
                         F.round(F.col("confidence_score") * 100, 0).alias("confidence_percent"))


def _classes_in_order(column: str = "threat_class") -> Column:
    """Distinct classes in catalogue order."""
    position = F.coalesce(pick(F.col(column), 1, [(name, i) for i, name in enumerate(CLASSES)]), F.lit(99))
    return F.transform(F.array_sort(F.collect_set(F.struct(position.alias("p"), F.col(column).alias("c")))), lambda x: x["c"])


def top_sources(alerts: DataFrame, limit: int = 8) -> DataFrame:
    """Sources with the most alerts and the classes seen from each, in catalogue order."""
    return (alerts.groupBy("src_ip")
            .agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
                 _classes_in_order().alias("classes"))
            .orderBy(F.desc("n"), F.asc("src_ip")).limit(limit))


def vector_severity_matrix(alerts: DataFrame) -> DataFrame:
    counts = (alerts.groupBy("threat_class")
              .agg(*[F.count_if(F.col("severity") == name).alias(name.lower()) for name in LEVELS[:3]],
                   F.count("*").alias("total")))
    return (catalog.threats(alerts.sparkSession).join(counts, "threat_class", "left")
            .fillna({"critical": 0, "high": 0, "medium": 0, "total": 0})
            .select("position", "threat_class", "short", "mitre_id", "critical", "high", "medium", "total"))


# ---- network ------------------------------------------------------------------------------------

def endpoint_rows(alerts: DataFrame) -> DataFrame:
    """Every alert once per endpoint."""
    sev = rank(F.col("severity")).alias("severity_rank")
    return (alerts.select(F.col("src_ip").alias("ip"), F.lit("src").alias("side"), "id", sev)
            .unionByName(alerts.select(F.col("dst_ip").alias("ip"), F.lit("dst").alias("side"), "id", sev)))


def topology_nodes(alerts: DataFrame, limit: int = 36) -> DataFrame:
    """Most involved hosts with role, worst severity and display size."""
    is_src, is_dst = F.count_if(F.col("side") == "src"), F.count_if(F.col("side") == "dst")
    role = F.when((is_src > 0) & (is_dst > 0), "both").when(is_src > 0, "src").otherwise("dst")
    return (endpoint_rows(alerts).groupBy("ip")
            .agg(F.count("*").alias("involvement"), role.alias("role"), F.min("severity_rank").alias("worst_rank"))
            .orderBy(F.desc("involvement"), F.asc("ip")).limit(limit)
            .withColumn("size", F.lit(13) + F.least(F.lit(15).cast("long"), F.col("involvement") * 2)))


def topology_edges(alerts: DataFrame, limit: int = 36) -> DataFrame:
    """Directed edges between shown hosts; the width is relative to the busiest edge of all."""
    edges = alerts.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"))
    peak = edges.agg(F.max("n")).scalar()
    nodes = topology_nodes(alerts, limit)
    return (edges.withColumn("width", F.lit(1) + F.lit(2.5) * F.col("n") / peak)
            .join(nodes.select(F.col("ip").alias("src_ip")), "src_ip", "left_semi")
            .join(nodes.select(F.col("ip").alias("dst_ip")), "dst_ip", "left_semi"))


def source_heatmap(alerts: DataFrame, limit: int = 20) -> DataFrame:
    """Alerts per class for the top sources; one pass, since the counts carry their own total."""
    return (alerts.groupBy("src_ip")
            .agg(F.count("*").alias("total"),
                 *[F.count_if(F.col("threat_class") == name).alias(f"c{i}") for i, name in enumerate(CLASSES)])
            .orderBy(F.desc("total"), F.asc("src_ip")).limit(limit))


# ---- reports ------------------------------------------------------------------------------------

def kill_chain(alerts: DataFrame) -> DataFrame:
    """The seven stages with the vectors detected in each."""
    spark = alerts.sparkSession
    seen = alerts.select("threat_class").distinct()
    hits = (catalog.threats(spark).join(seen, "threat_class", "left_semi")
            .groupBy(F.col("kill_chain").alias("stage"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "short"))), lambda x: x["short"]).alias("v")))
    return (catalog.stages(spark).join(hits, "stage", "left")
            .select("stage_order", "stage", F.coalesce(F.array_join("v", ", "), F.lit("")).alias("vectors")))


def mitre_coverage(alerts: DataFrame) -> DataFrame:
    """Per technique: alerts, mean confidence and whether it was observed."""
    counts = alerts.groupBy("threat_class").agg(F.count("*").alias("n"), F.avg("confidence_score").alias("mean_confidence"))
    spark = alerts.sparkSession
    return (catalog.threats(spark).join(catalog.tactics(spark), "tactic").join(counts, "threat_class", "left")
            .fillna({"n": 0})
            .select("tactic_order", "tactic", "mitre_id", "technique", "threat_class", "n", "mean_confidence",
                    (F.col("n") > 0).alias("observed")))


def report_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total"),
                      *[F.count_if(F.col("severity") == name).alias(name.lower()) for name in LEVELS[:3]],
                      F.count_distinct("src_ip").alias("sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def report_top_sources(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return (alerts.groupBy("src_ip")
            .agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("threat_class")), ", ").alias("classes"))
            .orderBy(F.desc("n"), F.asc("src_ip")).limit(limit))


def most_severe(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """Severity, then confidence, then id."""
    order = F.coalesce(pick(F.col("severity"), 3, SEVERITIES), F.lit(9))
    return (alerts.withColumn("severity_rank", order)
            .orderBy("severity_rank", F.desc("confidence_score"), "id").limit(limit))


def digest(alerts: DataFrame, limit: int = 6) -> DataFrame:
    """One row per class: its worst alert leads, the others are counted."""
    worst = F.struct(rank(F.col("severity")), -F.col("id"))
    lead = F.struct("id", "severity", "src_ip", "dst_ip", "dst_port", "evidence")
    return (alerts.groupBy("threat_class")
            .agg(F.count("*").alias("n"), F.min_by(lead, worst).alias("a"))
            .select("threat_class", "n", "a.*")
            .withColumns({"title": title(), "body": describe(), "severity_rank": rank(F.col("severity")),
                          "more": F.when(F.col("n") > 1, F.concat(F.lit("+"), (F.col("n") - 1).cast("string"),
                                                                  F.lit(" more of this type"))).otherwise(F.lit(""))})
            .orderBy("severity_rank", F.desc("n"), "threat_class").limit(limit))


def capture_summary(alerts: DataFrame) -> DataFrame:
    """Alerts per class of one capture with display names, most frequent first."""
    return catalog.with_catalog(alerts.groupBy("threat_class").agg(F.count("*").alias("n")).withColumn("severity", F.lit("LOW"))) \
        .select("threat_class", "short", "mitre_id", "n").orderBy(F.desc("n"), "threat_class")


def by_detection_source(alerts: DataFrame, flows: int, focus_ip: str | None = None) -> DataFrame:
    """Alert counts per class and detection source, per 10,000 flows, and those involving one host."""
    source = F.coalesce(field(parsed(F.col("evidence")), "detected_by"), F.lit("Rules"))
    focus = (F.col("src_ip") == focus_ip) | (F.col("dst_ip") == focus_ip) if focus_ip else F.lit(False)
    return (alerts.groupBy("threat_class", source.alias("detected_by"))
            .agg(F.count("*").alias("n"), F.count_if(focus).alias("involving"))
            .withColumn("per_10k_flows", F.round(F.lit(10_000.0) * F.col("n") / F.lit(max(1, flows)), 2)))
