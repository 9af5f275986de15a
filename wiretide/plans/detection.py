"""Batch detection: packets to published alerts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from wiretide.config import DetectionConfig
from wiretide.functions.tls import with_known_family
from wiretide.models.forest import BENIGN, ThreatModel, predict, with_explanation
from wiretide.operators.alerts import suppress_repeats, to_alerts, with_ids
from wiretide.operators.chain import materialize
from wiretide.operators.detection import flow_detections, source_detections, target_detections
from wiretide.operators.detectors import THREAT_LEVEL, Detector, built_in
from wiretide.operators.features import flow_features, with_flow_vector, with_host_vector
from wiretide.operators.flows import flows
from wiretide.operators.windows import (
    all_sources, all_targets, candidate_hosts, hosts, pane_counts, pairs_of, window_rows, with_probed_ports, with_top_sources)
from wiretide.session import swept


def _together(spark: SparkSession, *jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run independent Spark jobs at the same time, so that one fills the gaps of the other."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [future.result() for future in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


@dataclass
class RunStatistics:
    """Totals of one run, observed while its results were written, and the seconds its parts took."""

    total_packets: int = 0
    total_bytes: int = 0
    total_flows: int = 0
    total_windows: int = 0
    total_alerts: int = 0
    seconds: float = 0.0
    flow_seconds: float = 0.0
    window_seconds: float = 0.0
    model: bool = False

    def written(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """The rows, written once; what they sum up to goes to the fields named."""
        seen = Observation(f"run-{uuid.uuid4().hex}")
        out = materialize(df.observe(seen, *[value.alias(name) for name, value in metrics.items()]))
        for name, value in seen.get.items():
            setattr(self, name, value or 0)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row with totals, rates and mean latencies."""
        elapsed = max(0.001, self.seconds)
        row = (self.total_packets, self.total_bytes, self.total_flows, self.total_windows, self.total_alerts, round(self.total_packets / elapsed, 2),
               round(self.total_flows / elapsed, 2), round(1000 * self.flow_seconds / max(1, self.total_flows), 3),
               round(1000 * self.window_seconds / max(1, self.total_windows), 3), self.model)
        return spark.createDataFrame([row], "total_packets long, total_bytes long, total_flows long, total_windows long, total_alerts long, packets_per_second double, "
                                            "flows_per_second double, mean_flow_ms double, mean_window_ms double, with_model boolean")


def host_predictions(targets: DataFrame, sources: DataFrame, model: ThreatModel) -> DataFrame:
    """Model opinion on the candidate hosts of each window."""
    vectors = with_host_vector(candidate_hosts(hosts(targets, sources)))
    return (predict(vectors, model.host, model.classes["host"])
            .select("window_start_us", "host", "features", "ml_class", "ml_prob", "ml_probs"))


def reported(rules: list[Detector], grain: str, model: bool) -> Column:
    """Whether a rule fires on a row of one grain or the model sees an attack."""
    fires = F.lit(False)
    for rule in rules:
        if rule.grain == grain:
            fires = fires | (rule.confidence() >= THREAT_LEVEL)
    return fires | F.coalesce(F.col("ml_class") != BENIGN, F.lit(False)) if model else fires


def with_opinions(targets: DataFrame, sources: DataFrame, opinions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both views of the hosts with what the model says of them."""
    return (targets.join(opinions.withColumnRenamed("host", "dst_ip"), ["window_start_us", "dst_ip"], "left"),
            sources.join(opinions.withColumnRenamed("host", "src_ip"), ["window_start_us", "src_ip"], "left"))


def detections(packets: DataFrame, cfg: DetectionConfig = DetectionConfig(), model: ThreatModel | None = None,
               detectors: list[Detector] | None = None, statistics: RunStatistics | None = None,
               families: DataFrame | None = None) -> DataFrame:
    """All rule and model detections, before the cooldown.

    Packets are read by two aggregations only: the flow table and the pane table, which is written
    once. Windows are scored from panes, and details are computed for the reported windows only.
    ``statistics`` are filled in on the way, without another read of the packets. ``families`` (ja3_hash,
    family) replaces the fixed fingerprints of the TLS rule.
    """
    statistics = statistics or RunStatistics()
    rules = built_in(cfg, None if families is None else "ja3_family") if detectors is None else detectors
    spark, with_model = packets.sparkSession, model is not None
    thresholds = model.thresholds if with_model else {"flow": 0.0, "host": 0.0}

    def flow_job() -> DataFrame:
        begin, features = time.perf_counter(), flow_features(flows(packets, cfg.flow, splt=False))
        seen = Observation(f"flows-{uuid.uuid4().hex}")
        if families is not None:
            features = with_known_family(features, families)
        features = features.observe(seen, F.count(F.lit(1)).alias("n"))
        if with_model:
            features = predict(with_flow_vector(features), model.flow, model.classes["flow"])
        found = materialize(flow_detections(features, rules, with_model, thresholds["flow"]).withColumn("kind", F.lit("flow")))
        statistics.total_flows, statistics.flow_seconds = seen.get["n"], time.perf_counter() - begin
        return found

    flow_part, panes = _together(spark, flow_job, lambda: statistics.written(
        pane_counts(packets, cfg.window), total_packets=F.sum("packets"), total_bytes=F.sum("bytes")))
    begin = time.perf_counter()
    with swept(spark):
        statistics.total_windows = window_rows(panes, cfg.window).select("window_start_us").distinct().count()
    targets, sources = _together(spark, lambda: all_targets(panes, cfg.window), lambda: all_sources(panes, cfg.window))
    if with_model:
        targets, sources = _together(spark, lambda: materialize(targets), lambda: materialize(sources))
        opinions = materialize(host_predictions(targets, sources, model))
        targets, sources = with_opinions(targets, sources, opinions)
    # Reported rows are few, so they are written once and only they get their lists of sources or ports
    hit_targets, hit_sources = _together(spark, lambda: materialize(targets.filter(reported(rules, "target", with_model))),
                                         lambda: materialize(sources.filter(reported(rules, "source", with_model))))
    host_part = (target_detections(with_top_sources(hit_targets, panes, cfg.window), rules, with_model, thresholds["host"])
                 .unionByName(source_detections(with_probed_ports(hit_sources, pairs_of(hit_sources, panes, cfg.window)), rules, with_model, thresholds["host"]))
                 .withColumn("kind", F.lit("host")))
    statistics.window_seconds, statistics.model = time.perf_counter() - begin, with_model
    return flow_part.unionByName(host_part)


def with_factors(alerts: DataFrame, model: ThreatModel) -> DataFrame:
    """Append the model's strongest factors to the evidence of the alerts in which the model speaks."""
    asked = F.col("explain_class").isNotNull()
    out = alerts.filter(~asked)
    for kind in ("flow", "host"):
        rows = (with_explanation(alerts.filter(asked & (F.col("kind") == kind)), model.of(kind), kind, model.classes[kind], name="_f", baseline=model.baseline[kind])
                .withColumn("_f", F.to_json(F.transform("_f", lambda f: f["text"]))))
        body = F.expr("substring(evidence, 1, length(evidence) - 1)")
        out = out.unionByName(rows.withColumn("evidence", F.concat(
            body, F.lit(',"model_factors":'), F.coalesce("_f", F.lit("[]")), F.lit("}"))).drop("_f"))
    return out


def run(packets: DataFrame, cfg: DetectionConfig = DetectionConfig(), model: ThreatModel | None = None,
        detectors: list[Detector] | None = None, after_id: int = 0, statistics: RunStatistics | None = None,
        families: DataFrame | None = None) -> DataFrame:
    """Published alerts with ids. Without a model only the rules speak."""
    published = suppress_repeats(to_alerts(detections(packets, cfg, model, detectors, statistics, families)), cfg.cooldown)
    if model is not None:
        published = with_factors(materialize(published), model)
    return with_ids(published.drop("dedup_key", "order_us", "kind", "features", "explain_class"), after_id)


def run_with_statistics(packets: DataFrame, cfg: DetectionConfig = DetectionConfig(), model: ThreatModel | None = None,
                        detectors: list[Detector] | None = None) -> tuple[DataFrame, RunStatistics]:
    """Published alerts, written, and the statistics of the run."""
    begin, statistics = time.perf_counter(), RunStatistics()
    alerts = statistics.written(run(packets, cfg, model, detectors, statistics=statistics), total_alerts=F.count(F.lit(1)))
    statistics.seconds = time.perf_counter() - begin
    return alerts, statistics
