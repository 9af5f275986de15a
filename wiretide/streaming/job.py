"""Streaming detection: the same alerts as the batch plan on the epoch grid, published once.

Three queries share a folder. ``start_flows`` and ``start_windows`` read the packets, score what closes in a micro-batch
with the batch code, and log the detections. ``start_publisher`` reads both logs, keeps every detection until no earlier one
can follow, applies the cooldown across micro-batches and appends to the alert table.

Every logged row says in ``sealed`` up to when its log is complete: no detection of that micro-batch or a later one is
earlier. The publisher's watermark is the smaller one of both logs, so neither query has to wait for the other. A
micro-batch that is run again finds its log entry or its table rows and leaves one of each.

``end_stream`` closes a stream for good: control packets of a far-off time move the watermark past everything, so that open
flows and windows close in the ordinary way.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from wiretide.config import DetectionConfig
from wiretide.models.forest import ThreatModel, predict
from wiretide.operators.alerts import to_alerts
from wiretide.operators.detection import flow_detections, source_detections, target_detections
from wiretide.operators.detectors import Detector, built_in
from wiretide.operators.features import flow_features, with_flow_vector
from wiretide.operators.windows import source_totals, target_totals, top_sources, with_probed_ports
from wiretide.plans.detection import host_predictions, reported, with_factors, with_opinions
from wiretide.schema import ALERT_COLUMNS, ALERT_SCHEMA, PACKET_SCHEMA
from wiretide.sources.alert_store import append_json, append_table
from wiretide.streaming.state import cooldown_stream, flow_stream
from wiretide.streaming.windows import LATENESS, facet_stream, pair_rows, target_rows, until_last_window

#: Address of control packets, and the two times they carry; only the earlier one ever leaves a window or a flow.
CONTROL, END_TIMES = "-", (datetime(2200, 1, 1, tzinfo=timezone.utc), datetime(2201, 1, 1, tzinfo=timezone.utc))
LOG_SCHEMA = T.StructType([*[f for f in ALERT_SCHEMA.fields if f.name in ALERT_COLUMNS], T.StructField("dedup_key", T.StringType()),
                           T.StructField("order_us", T.LongType()), T.StructField("sealed", T.TimestampType())])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _folder(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return path


def with_end(packets: DataFrame, folder: str) -> DataFrame:
    """A packet stream and the control packets that end it."""
    spark = packets.sparkSession
    control = spark.readStream.schema(PACKET_SCHEMA).parquet(_folder(spark, f"{folder}/end"))
    return packets.select(*PACKET_SCHEMA.names).unionByName(control)


def end_stream(spark: SparkSession, folder: str) -> None:
    """Write the control packets, once. All packets must have been read by then: what is read later is late."""
    if not _exists(spark, f"{folder}/end/_SUCCESS"):
        rows = [(-1 - i, time, CONTROL, CONTROL, i, 0, "OTHER", 0, 0, *[False] * 6, None) for i, time in enumerate(END_TIMES)]
        spark.createDataFrame(rows, PACKET_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/end")


def _log(detections: DataFrame, sealed_us: Column, path: str) -> None:
    """Detections and one row without a key, which stands for a micro-batch without any. A log entry is written once."""
    spark = detections.sparkSession
    if _exists(spark, f"{path}/_SUCCESS"):
        return
    mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields[:-1]])
    rows = detections.select(*LOG_SCHEMA.names[:-1]).unionByName(mark).withColumn("sealed", F.timestamp_micros(sealed_us))
    rows.write.mode("overwrite").parquet(path)


def _alerts(detections: DataFrame, model: ThreatModel | None, kind: str) -> DataFrame:
    alerts = to_alerts(detections.withColumn("kind", F.lit(kind)))
    return alerts if model is None else with_factors(alerts, model)


def score_flows(closed: DataFrame, cfg: DetectionConfig = DetectionConfig(), model: ThreatModel | None = None,
                detectors: list[Detector] | None = None) -> DataFrame:
    """Alerts, before the cooldown, of closed flows; the model, if any, runs vectorised over them."""
    rows = flow_features(closed)
    if model is not None:
        rows = predict(with_flow_vector(rows), model.flow, model.classes["flow"])
    rules = built_in(cfg) if detectors is None else detectors
    threshold = cfg.flow_threshold if model is None else model.thresholds["flow"]
    return _alerts(flow_detections(rows, rules, model is not None, threshold), model, "flow")


def score_windows(closed: DataFrame, cfg: DetectionConfig = DetectionConfig(), model: ThreatModel | None = None,
                  detectors: list[Detector] | None = None) -> DataFrame:
    """Alerts, before the cooldown, of the rows of closed windows."""
    rules = built_in(cfg) if detectors is None else detectors
    threshold = cfg.host_threshold if model is None else model.thresholds["host"]
    facets, pairs, keys = target_rows(closed), pair_rows(closed), ["window_start_us", "dst_ip"]
    targets, sources = target_totals(facets, cfg.window), source_totals(pairs, cfg.window)
    if model is not None:
        targets, sources = with_opinions(targets, sources, host_predictions(targets, sources, model))
    hit_targets, hit_sources = (rows.filter(reported(rules, grain, model is not None)) for rows, grain in ((targets, "target"), (sources, "source")))
    tops = top_sources(facets.join(hit_targets.select(*keys), keys, "left_semi"))
    found = (target_detections(hit_targets.join(tops, keys), rules, model is not None, threshold)
             .unionByName(source_detections(with_probed_ports(hit_sources, pairs), rules, model is not None, threshold)))
    return _alerts(found, model, "host")


def _start(stream: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    def once_read(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # read by several aggregations
        try:
            if not rows.isEmpty():
                publish(rows, number)
        finally:
            rows.unpersist()
    return stream.writeStream.foreachBatch(once_read).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_flows(packets: DataFrame, folder: str, cfg: DetectionConfig = DetectionConfig(), model: ThreatModel | None = None,
                detectors: list[Detector] | None = None, lateness: str = LATENESS) -> StreamingQuery:
    """Log the detections on the flows that close."""
    def publish(closed: DataFrame, number: int) -> None:
        sealed = closed.agg(F.least(F.min("last_us"), F.max("watermark_us") - F.lit(cfg.flow.idle_us)).alias("s")).scalar()
        flows = closed.filter(F.col("src_ip") != CONTROL).drop("watermark_us")
        _log(score_flows(flows, cfg, model, detectors), sealed, f"{folder}/log/flow/batch={number}")
    return _start(flow_stream(with_end(packets, folder), cfg.flow, lateness), f"{folder}/checkpoints/flow", publish)


def start_windows(packets: DataFrame, folder: str, cfg: DetectionConfig = DetectionConfig(), model: ThreatModel | None = None,
                  detectors: list[Detector] | None = None, lateness: str = LATENESS) -> StreamingQuery:
    """Log the detections on the host windows that close."""
    def publish(closed: DataFrame, number: int) -> None:
        ended = not closed.filter(F.col("host") == CONTROL).isEmpty()
        rows = closed.filter(F.col("host") != CONTROL)
        if ended:
            rows = until_last_window(rows, cfg.window)
        sealed = closed.agg(F.min("window_start_us").alias("s")).scalar()
        _log(score_windows(rows, cfg, model, detectors), sealed, f"{folder}/log/host/batch={number}")
    return _start(facet_stream(with_end(packets, folder), cfg.window, lateness), f"{folder}/checkpoints/host", publish)


def start_publisher(spark: SparkSession, folder: str, table: str, json: str | None = None, cfg: DetectionConfig = DetectionConfig()) -> StreamingQuery:
    """Publish logged detections under the cooldown, in event order across micro-batches."""
    def log(kind: str) -> DataFrame:
        path = _folder(spark, f"{folder}/log/{kind}")
        return spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", True).parquet(path).withWatermark("sealed", "1 second")

    def publish(alerts: DataFrame, number: int) -> None:
        append_table(alerts, table, number)
        if json:
            append_json(alerts, json, number)
    # As it names the event time, this condition stays above the watermark, which rows without a key must reach
    keyed = log("flow").unionByName(log("host")).filter(F.col("dedup_key").isNotNull() | F.col("sealed").isNull())
    return _start(cooldown_stream(keyed, cfg.cooldown, "", "sealed"), f"{folder}/checkpoints/publisher", publish)


def run_available(packets: DataFrame, folder: str, table: str, json: str | None = None, cfg: DetectionConfig = DetectionConfig(),
                  model: ThreatModel | None = None, detectors: list[Detector] | None = None, lateness: str = LATENESS, end: bool = False) -> None:
    """Detect and publish what has arrived since the last run. With ``end`` nothing more will come: open flows and windows
    are closed, and everything that waits is published. Alerts are those of ``plans.detection.run`` with the window grid
    at the epoch, apart from their ids; packets that come later than ``lateness`` are left out."""
    spark = packets.sparkSession

    def read() -> None:
        for query in [start(packets, folder, cfg, model, detectors, lateness) for start in (start_flows, start_windows)]:
            query.awaitTermination()
    read()
    if end:
        end_stream(spark, folder)
        read()
        none = spark.createDataFrame([], LOG_SCHEMA)
        for kind in ("flow", "host"):
            _log(none, F.unix_micros(F.lit(END_TIMES[0])), f"{folder}/log/{kind}/batch=end")
    start_publisher(spark, folder, table, json, cfg).awaitTermination()
