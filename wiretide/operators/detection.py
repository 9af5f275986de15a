"""From scored rows to detections: rule alerts, model opinions and model-only alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.operators.detectors import THREAT_LEVEL, Detector
from wiretide.operators.features import fill_defaults

MODEL_ONLY_CAP = 0.89
BOTH_CAP = 0.99
# ``order_us`` (flow or window start) breaks ties between detections with equal time and flow
DETECTION_COLUMNS = ("ts_us", "order_us", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "dedup_key",
                     "threat_class", "confidence_score", "evidence")


def opinion(rule_confidence: Column, threat_class: Column, rule_fired: Column, model_class: Column | None,
            model_prob: Column | None, class_prob: Column | None, threshold: float) -> dict[str, Column]:
    """Merge of a rule and a model on one row.

    ``model_prob`` belongs to the class the model prefers, ``class_prob`` to ``threat_class``.
    """
    rounded = F.round(rule_confidence, 4)
    if model_class is None:
        return {"alerts": rule_fired, "confidence_score": rounded, "detected_by": F.lit(None).cast("string"),
                "model_probability": F.lit(None).cast("double")}
    class_prob = F.coalesce(class_prob, F.lit(0.0))
    scored = model_class.isNotNull()
    agrees = scored & (class_prob >= threshold)
    model_only = F.coalesce(~rule_fired & (model_class == threat_class) & (model_prob >= threshold), F.lit(False))
    joint = F.round(F.least(F.lit(BOTH_CAP), F.greatest(rounded, class_prob)), 4)
    return {
        "alerts": rule_fired | model_only,
        "confidence_score": F.when(model_only, F.round(F.least(F.lit(MODEL_ONLY_CAP), model_prob), 4))
                             .when(agrees, joint).otherwise(rounded),
        "detected_by": F.when(model_only, F.lit("AI model")).when(agrees, F.lit("Rules + AI model"))
                        .when(scored, F.lit("Rules")),
        "model_probability": F.when(scored, F.round(F.when(model_only, model_prob).otherwise(class_prob), 3)),
    }


def _detection(detector: Detector, extra: list[Column], model: bool, threshold: float) -> Column:
    """Struct of one detector's outcome, null where nothing is reported."""
    confidence = detector.confidence()
    fired = confidence >= THREAT_LEVEL
    parts = opinion(confidence, F.lit(detector.name), fired, F.col("ml_class") if model else None,
                    F.col("ml_prob") if model else None, F.col("ml_probs")[detector.name] if model else None, threshold)
    fields = detector.evidence(fired)
    if model and "indicators" in fields:
        fields["indicators"] = F.when(fired, fields["indicators"])
    body = [value.alias(name) for name, value in fields.items()] + extra
    if model:
        body += [parts["detected_by"].alias("detected_by"), parts["model_probability"].alias("model_probability")]
        # Explanations are needed only where the model speaks, so the row asks for them by class
        explained = F.when(parts["detected_by"] != "Rules", F.lit(detector.name))
    else:
        explained = F.lit(None).cast("string")
    return F.when(parts["alerts"], F.struct(
        F.lit(detector.name).alias("threat_class"), parts["confidence_score"].alias("confidence_score"),
        F.to_json(F.struct(*body)).alias("evidence"), explained.alias("explain_class")))


def _explode(rows: DataFrame, detectors: list[Detector], extra: list[Column], model: bool, threshold: float,
             keep: list[str]) -> DataFrame:
    outcomes = F.array(*[_detection(d, extra, model, threshold) for d in detectors])
    return (rows.select(*keep, F.explode(F.filter(outcomes, lambda x: x.isNotNull())).alias("d"))
            .select(*keep, "d.threat_class", "d.confidence_score", "d.evidence", "d.explain_class"))


def _finish(rows: DataFrame, keep_vector: bool) -> DataFrame:
    return rows.select(*DETECTION_COLUMNS, *(["explain_class", "features"] if keep_vector else []))


def flow_detections(features: DataFrame, detectors: list[Detector], model: bool = False,
                    threshold: float = 0.85) -> DataFrame:
    """One row per detection on a flow. With ``model`` the rows carry ml_class, ml_prob and ml_probs."""
    rows = fill_defaults(features)
    keep = ["last_us", "flow_start_us", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    if model:
        keep.append("features")
    chosen = [d for d in detectors if d.grain == "flow"]
    out = _explode(rows, chosen, [], model, threshold, keep)
    return _finish(out.withColumns({"ts_us": F.col("last_us"), "order_us": F.col("flow_start_us"),
                                    "dedup_key": F.lit(None).cast("string")}), model)


def _window_bounds() -> list[Column]:
    return [F.round(F.col(f"window_{side}_us") / F.lit(1e6), 3).alias(f"window_{side}") for side in ("start", "end")]


def target_detections(targets: DataFrame, detectors: list[Detector], model: bool = False,
                      threshold: float = 0.85) -> DataFrame:
    """Fan-in detections with a synthetic flow: top source to the target, deduplicated per target."""
    rows = targets.withColumn("src_ip", F.element_at("top_sources", 1))
    keep = ["window_start_us", "src_ip", "dst_ip", "top_dst_port", "protocol", "last_ts_us"] + (["features"] if model else [])
    out = _explode(rows, [d for d in detectors if d.grain == "target"], _window_bounds(), model, threshold, keep)
    return _finish(out.withColumns({
        "ts_us": F.col("last_ts_us"), "order_us": F.col("window_start_us"), "src_port": F.lit(0), "dst_port": F.col("top_dst_port"),
        "flow_id": F.format_string("%s:*->%s:%s_%s", "src_ip", "dst_ip", F.col("top_dst_port").cast("string"), "protocol"),
        "dedup_key": F.concat(F.lit("*->"), F.col("dst_ip"))}), model)


def scan_flow() -> dict[str, Column]:
    """Synthetic flow of a scan: one host for a vertical scan, ``*`` for a horizontal one."""
    vertical = F.col("max_ports_on_one_host") >= F.col("max_hosts_on_one_port")
    dst = F.when(vertical, F.col("vertical_target")).otherwise(F.lit("*"))
    port = F.when(vertical, F.lit(0)).otherwise(F.col("horizontal_port"))
    shown = F.when(port == 0, F.lit("*")).otherwise(port.cast("string"))
    return {"flow_id": F.format_string("%s:*->%s:%s_%s", F.col("src_ip"), dst, shown, F.col("protocol")),
            "dst_ip": dst, "dst_port": port}


def source_detections(sources: DataFrame, detectors: list[Detector], model: bool = False,
                      threshold: float = 0.85) -> DataFrame:
    """Fan-out detections with a synthetic flow from the scanning host."""
    keep = ["window_start_us", "src_ip", "protocol", "last_ts_us", "max_ports_on_one_host", "max_hosts_on_one_port", "vertical_target",
            "horizontal_port"] + (["features"] if model else [])
    out = _explode(sources, [d for d in detectors if d.grain == "source"], _window_bounds(), model, threshold, keep)
    return _finish(out.withColumns({"ts_us": F.col("last_ts_us"), "order_us": F.col("window_start_us"), "src_port": F.lit(0),
                                    "dedup_key": F.lit(None).cast("string"), **scan_flow()}), model)

