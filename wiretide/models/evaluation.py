"""Labels, metrics, threshold calibration and the model card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.config import WindowConfig
from wiretide.models.forest import BENIGN, CLASSES, LAYOUT, ThreatModel, feature_importance, predict
from wiretide.operators.detectors import FLOOD, SCAN, THREAT_LEVEL, Detector
from wiretide.schema import FLOW_KEY

# Tolerated false alarms per flow and per host window
BUDGETS = {"flow": 5.0 / 10_000, "host": 1.0 / 1_000}


# ---- labels -------------------------------------------------------------------------------------

def label_flows(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on the 5-tuple: flows without a label are dropped."""
    return flows.join(labels.select(*FLOW_KEY, F.col("cls").alias("label")), list(FLOW_KEY))


def label_host_windows(hosts: DataFrame, labels: DataFrame, cfg: WindowConfig = WindowConfig(),
                       min_overlap_us: int = 800_000) -> DataFrame:
    """Class of a host window: the last label of the host that overlaps it long enough, else benign.

    The interval test becomes an equi-join: each label is expanded to the windows it overlaps by the
    minimum, and labels that meet in one (host, window) are reduced before the join.
    """
    bounds = hosts.agg(F.struct(F.min("window_start_us").alias("first"), F.max("window_start_us").alias("last")).alias("b")).scalar()
    first, last = bounds["first"], bounds["last"]
    size, slide, need = F.lit(cfg.size_us), F.lit(cfg.slide_us), F.lit(min_overlap_us)
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("t_start_us") + need - size - first) / slide))
    hi = F.least(F.floor((last - first) / slide), F.floor((F.col("t_end_us") - need - first) / slide))
    per_window = (labels.filter((F.col("t_end_us") - F.col("t_start_us") >= need) & (need <= size))
                  .withColumns({"lo": lo, "hi": hi}).filter("lo <= hi")
                  .select(F.col("ip").alias("host"), "cls", "label_seq", F.explode(F.sequence("lo", "hi")).alias("k"))
                  .withColumn("window_start_us", first + F.col("k") * slide)
                  .groupBy("host", "window_start_us").agg(F.max_by("cls", "label_seq").alias("label")))
    return hosts.join(per_window, ["host", "window_start_us"], "left").fillna({"label": BENIGN})


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


# ---- metrics ------------------------------------------------------------------------------------

def per_class(rows: DataFrame, truth: str, predicted: str, classes: tuple[str, ...] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per attack class, from one confusion count. An empty
    denominator gives zero."""
    confusion = rows.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("claimed")))).alias("s")).select("s.*")
    totals = (sides.filter(F.col("cls") != BENIGN).groupBy("cls")
              .agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed")))
    if classes:
        wanted = rows.sparkSession.createDataFrame([(c,) for c in classes if c != BENIGN], "cls string")
        totals = wanted.join(totals, "cls", "left").fillna(0)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    hit, support, claimed = F.col("hit"), F.col("support"), F.col("claimed")
    return totals.select("cls", F.round(ratio(hit, claimed), 4).alias("precision"), F.round(ratio(hit, support), 4).alias("recall"),
                         F.round(ratio(2 * hit, support + claimed), 4).alias("f1"), "support")


def benign_false_positives(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    benign = F.col(truth) == BENIGN
    wrong, total = F.count_if(benign & (F.col(predicted) != BENIGN)), F.count_if(benign)
    return rows.agg(F.round(wrong / F.greatest(F.lit(1), total), 5).alias("benign_false_positive_rate"), total.alias("benign_support"))


def rule_label(detectors: list[Detector]) -> Column:
    """Class of the fired rule with the highest (confidence, class), else benign."""
    fired = []
    for detector in detectors:
        confidence = detector.confidence()
        fired.append(F.when(confidence >= THREAT_LEVEL, F.struct(F.round(confidence, 4).alias("c"), F.lit(detector.name).alias("cls"))))
    return F.coalesce(F.array_max(F.array(*fired))["cls"], F.lit(BENIGN))


def host_rule_label(flooded: Column, scanning: Column) -> Column:
    """A flood wins over a scan."""
    return F.when(flooded, F.lit(FLOOD)).when(scanning, F.lit(SCAN)).otherwise(F.lit(BENIGN))


def model_label(threshold: float, cls: str = "ml_class", prob: str = "ml_prob") -> Column:
    return F.when((F.col(cls) != BENIGN) & (F.col(prob) >= threshold), F.col(cls)).otherwise(F.lit(BENIGN))


def hybrid_label(rule: Column, model: Column) -> Column:
    return F.when(rule != BENIGN, rule).otherwise(model)


def comparison(rows: DataFrame, truth: str = "label", classes: tuple[str, ...] | None = None) -> DataFrame:
    """Metrics of the rules, the model and both, for rows with ``rule_label`` and ``model_label``."""
    rows = rows.withColumn("hybrid_label", hybrid_label(F.col("rule_label"), F.col("model_label")))
    out = None
    for variant in ("rules", "model", "hybrid"):
        column = {"rules": "rule_label"}.get(variant, f"{variant}_label")
        part = per_class(rows, truth, column, classes).withColumn("variant", F.lit(variant))
        out = part if out is None else out.unionByName(part)
    return out


def comparison_table(metrics: DataFrame) -> DataFrame:
    """One row per class: recall of the three variants and precision of the hybrid."""
    def of(variant: str, name: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(name)))
    return metrics.groupBy("cls").agg(of("rules", "recall").alias("rules_recall"), of("model", "recall").alias("model_recall"),
                                      of("hybrid", "recall").alias("hybrid_recall"), of("hybrid", "precision").alias("hybrid_precision"),
                                      F.max("support").alias("support"))


# ---- calibration --------------------------------------------------------------------------------

def exact_quantile(rows: DataFrame, value: str, q: float, cells: int = 10_000) -> DataFrame:
    """Linearly interpolated quantile of values in [0, 1], as one row ``(n, quantile)``.

    Equal values are counted first and ranked inside narrow cells; only the cell counts, whose number
    is fixed, are accumulated globally.
    """
    counts = (rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
              .withColumn("cell", F.least(F.lit(cells), F.floor(F.col("v") * cells))))
    base = (counts.groupBy("cell").agg(F.sum("n").alias("cell_n"))
            .withColumn("base", F.coalesce(F.sum("cell_n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    inside = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(base.select("cell", "base"), "cell").withColumn("upto", F.col("base") + F.sum("n").over(inside))
    total = counts.agg(F.sum("n")).scalar()
    h = (total - 1) * F.lit(q)
    low = F.floor(h)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("v")))

    return (ranked.agg(F.sum("n").alias("n"), at(low).alias("a"), at(F.least(low + 1, total - 1)).alias("b"))
            .select("n", (F.col("a") + (F.col("b") - F.col("a")) * (h - low)).alias("quantile")))


def attack_score(rows: DataFrame) -> DataFrame:
    """Highest attack probability of scored rows."""
    return rows.withColumn("score", F.array_max(F.map_values(F.map_filter("ml_probs", lambda k, v: k != BENIGN))))


def threshold(benign_scores: DataFrame, kind: str, value: str = "score", floor: float = 0.85, budget: float | None = None) -> DataFrame:
    """Smallest threshold from ``floor`` up that keeps model-only false alarms under the budget."""
    q = exact_quantile(benign_scores, value, 1 - (BUDGETS[kind] if budget is None else budget))
    raw = F.greatest(F.lit(floor), F.coalesce(F.col("quantile") + F.lit(1e-6), F.lit(floor)))
    return q.select(F.lit(kind).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.least(F.lit(0.995), raw), 4).alias("threshold"))


def calibrate(model: ThreatModel, benign_flows: DataFrame, benign_hosts: DataFrame) -> ThreatModel:
    """A copy of the model with thresholds from benign vectors, possibly of several captures."""
    rows = None
    for kind, vectors in (("flow", benign_flows), ("host", benign_hosts)):
        part = threshold(attack_score(predict(vectors, model.of(kind), model.classes[kind])), kind)
        rows = part if rows is None else rows.unionByName(part)
    found = {row["kind"]: row["threshold"] for row in rows.collect()}
    return ThreatModel(model.flow, model.host, found, model.classes)


# ---- model card ---------------------------------------------------------------------------------

def model_card(model: ThreatModel, metrics: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """One row: layouts, class counts, strongest features, thresholds and hold-out metrics."""
    spark = metrics.sparkSession
    parts = []
    for kind, top in (("flow", 10), ("host", 8)):
        best = feature_importance(model, kind).limit(top).collect()
        seen = counts[kind].agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m")).scalar()
        parts.append(F.struct(
            F.array(*[F.lit(c) for c in model.classes[kind]]).alias("classes"), F.array(*[F.lit(n) for n in LAYOUT[kind]]).alias("features"),
            F.lit(model.of(kind).getNumTrees).alias("trees"), seen.alias("train_class_counts"),
            F.array(*[F.struct(F.lit(r["label"]).alias("feature"), F.lit(round(r["importance"], 4)).alias("importance")) for r in best]).alias("top_features"),
            F.lit(model.thresholds[kind]).alias("threshold")).alias(f"{kind}_model"))
    table = metrics.agg(F.collect_list(F.struct("variant", "cls", "precision", "recall", "f1", "support")).alias("m")).scalar()
    return spark.range(1).select(F.current_timestamp().cast("string").alias("written_at"), *parts, table.alias("holdout"))


def write_model_card(card: DataFrame, path: str) -> None:
    card.coalesce(1).write.mode("overwrite").json(path)
