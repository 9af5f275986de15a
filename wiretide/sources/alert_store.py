"""Alert table: sinks, read-back and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from wiretide.functions.text import parsed
from wiretide.operators.alerts import with_ids
from wiretide.plans.response import HEADER, bundle_lines, iso_time, rule_bundle
from wiretide.schema import ALERT_COLUMNS, ALERT_SCHEMA

#: Folder in a table that readers skip
ENTRIES = "_batches"


def json_lines(alerts: DataFrame) -> DataFrame:
    """One JSON object per alert with the evidence nested in it."""
    fields = [iso_time(F.col("ts")).alias("timestamp") if name == "ts" else F.col(name)
              for name in ALERT_COLUMNS if name != "evidence"]
    head = F.to_json(F.struct(*fields))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"evidence":'), parsed(F.col("evidence")), F.lit("}"))
    return alerts.select(body.alias("value"))


def append_json(alerts: DataFrame, path: str, batch: int | None = None) -> None:
    """Append JSON lines. With ``batch`` they go to a folder of that batch, which a retry replaces."""
    if batch is None:
        json_lines(alerts).write.mode("append").text(path)
    else:
        json_lines(alerts).write.mode("overwrite").text(f"{path}/batch={batch}")


def _entries(spark: SparkSession, path: str):
    """File system and folder of the batch entries, and the entries (batch, first id, last id) in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{ENTRIES}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return files, folder, sorted(tuple(int(part) for part in name.split(".")) for name in names)


def append_table(alerts: DataFrame, path: str, batch: int | None = None) -> None:
    """Append alerts with increasing ids, partitioned by day, then batch.

    With ``batch`` the rows of that batch are replaced, so a retried streaming batch writes once and keeps its ids. The
    ids follow the last entry, a folder whose name tells batch, first and last id. It is made, in one step, after the
    rows are written; older ones go, so an append costs the same whatever the table holds.
    """
    spark = alerts.sparkSession
    files, folder, entries = _entries(spark, path)
    number = -1 if batch is None else batch
    again = [e for e in entries if batch is not None and e[0] == batch]
    before = [e for e in entries if e not in again]
    if again:
        first = again[0][1]
    elif before:
        first = max(e[2] for e in before) + 1
    else:
        stored = try_read(spark, path)  # a table without entries is read once
        first = 1 if stored is None else stored.filter(F.col("batch") != batch if batch is not None else F.lit(True)).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    seen = Observation()
    rows = with_ids(alerts.select(*ALERT_COLUMNS), after=first - 1).observe(seen, F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"batch": F.lit(number).cast("long"), "day": F.to_date("ts")})
    if batch is None:
        rows.write.mode("append").partitionBy("day", "batch").parquet(path)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    entry = (number, first, first - 1 + seen.get["n"])
    new = spark._jvm.org.apache.hadoop.fs.Path(folder, ".".join(map(str, entry)))
    files.mkdirs(new)
    for old in [e for e in entries if e != entry and e[2] < entry[1]][:-1]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, ".".join(map(str, old))), True)


def try_read(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None before the first write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    partitions = [T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())]
    return spark.read.schema(T.StructType([*ALERT_SCHEMA.fields, *partitions])).parquet(path)


def parse_alerts(stored: DataFrame) -> DataFrame:
    """Tolerant read-back: bad evidence becomes ``{}``, a bad confidence 0."""
    return stored.withColumns({"evidence": parsed(F.col("evidence")),
                               "confidence_score": F.coalesce(F.col("confidence_score").try_cast("double"), F.lit(0.0))})


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return parse_alerts(spark.read.parquet(path)).drop("batch", "day")


def csv_layout(alerts: DataFrame) -> DataFrame:
    """Export columns: helper columns dropped, local time in second place."""
    local = F.date_format(F.from_utc_timestamp("ts", "+05:30"), "yyyy-MM-dd HH:mm:ss")
    rest = [c for c in ALERT_COLUMNS if c not in ("ts", "evidence")]
    return alerts.select("id", F.coalesce(local, F.lit("")).alias("time_ist"), iso_time(F.col("ts")).alias("timestamp"),
                         *rest, parsed(F.col("evidence")).alias("evidence"))


def write_csv(alerts: DataFrame, path: str) -> None:
    csv_layout(alerts).write.mode("overwrite").option("header", True).csv(path)


def write_rule_bundle(alerts: DataFrame, path: str, tag: str = "THREAT") -> None:
    """Two usable text exports, one file each: ``firewall`` (a shell script) and ``ids``, with ordered, distinct rules.

    A script is one file, so one task writes it; the rules are distinct by then.
    """
    bundle = rule_bundle(alerts, tag)
    spark = alerts.sparkSession
    for kind, head in (("firewall", ("#!/bin/sh", *HEADER, "set -e")), ("ids", HEADER)):
        first = spark.createDataFrame([(-1, i, line) for i, line in enumerate(head)], "id long, position int, line string")
        (bundle_lines(bundle, kind, first).coalesce(1).write.mode("overwrite").text(f"{path}/{kind}"))
