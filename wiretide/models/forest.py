"""Flow and host forests on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wiretide.operators.chain import materialize
from wiretide.operators.detectors import BEACON, DGA, EXFIL, FLOOD, MALWARE, SCAN
from wiretide.operators.features import FLOW_VECTOR, HOST_VECTOR
from wiretide.session import checkpoint_dir

BENIGN = "benign"
CLASSES = {"flow": (BENIGN, BEACON, DGA, MALWARE, EXFIL), "host": (BENIGN, FLOOD, SCAN)}
LAYOUT = {"flow": FLOW_VECTOR, "host": HOST_VECTOR}
# Trees and depth per forest; the host forest runs per window and is lighter
SHAPE = {"flow": (120, 16), "host": (50, 14)}
DEFAULT_THRESHOLD = 0.85


@dataclass
class ThreatModel:
    """Any fitted Spark models with a ``probability`` column will do.

    ``baseline`` is what a vector entry is taken to be when it says nothing; explanations of models other than forests
    compare with it. Entries that it does not have are 0.
    """

    flow: Model
    host: Model
    thresholds: dict[str, float] = field(default_factory=lambda: {"flow": DEFAULT_THRESHOLD, "host": DEFAULT_THRESHOLD})
    classes: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(CLASSES))
    baseline: dict[str, list[float]] = field(default_factory=lambda: {"flow": [], "host": []})

    def of(self, kind: str):
        return self.flow if kind == "flow" else self.host


def with_balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = N / (k * n_class), so that every class weighs the same."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    weights = counts.select(label, (totals["n"] / (totals["k"] * F.col("_n"))).alias("weight"))
    return rows.join(weights, label)


def _indexed(rows: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label"))
    return rows.filter(position > 0).withColumn("label_index", (position - 1).cast("double"))


def train(kind: str, rows: DataFrame, seed: int = 42, trees: int | None = None, depth: int | None = None,
          classes: tuple[str, ...] | None = None) -> RandomForestClassificationModel:
    """Fit one forest on ``features`` and ``label``."""
    shape = SHAPE[kind]
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=trees or shape[0],
        maxDepth=depth or shape[1], minInstancesPerNode=2, seed=seed)
    prepared = with_balanced_weights(_indexed(rows, classes or CLASSES[kind]))
    # The fit reads its input once per level group, so the features are computed once
    return forest.fit(materialize(prepared.select("features", "label_index", "weight")))


def train_both(flow_rows: DataFrame, host_rows: DataFrame, seed: int = 42, **shape) -> ThreatModel:
    return ThreatModel(train("flow", flow_rows, seed, **shape), train("host", host_rows, seed + 1, **shape))


def predict(rows: DataFrame, model, classes: tuple[str, ...]) -> DataFrame:
    """Adds ``ml_class``, ``ml_prob`` and the per-class map ``ml_probs`` to rows with ``features``."""
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    # A class that training never saw has no entry in the probability vector
    names = F.slice(F.array(*[F.lit(c) for c in classes]), F.lit(1), F.size("_p"))
    best = F.array_max("_p")
    return (scored.withColumns({"ml_prob": best, "ml_class": F.element_at(names, F.array_position("_p", best).cast("int")),
                                "ml_probs": F.map_from_arrays(names, F.col("_p"))})
            .drop("_p", "probability", "rawPrediction", "prediction"))


_META = "kind string, threshold double, classes array<string>, baseline array<double>"


def save(model: ThreatModel, path: str) -> None:
    for kind in ("flow", "host"):
        model.of(kind).write().overwrite().save(f"{path}/{kind}")
    spark = SparkSession.active()
    meta = [(kind, float(model.thresholds[kind]), list(model.classes[kind]), [float(v) for v in model.baseline[kind]]) for kind in ("flow", "host")]
    (spark.createDataFrame(meta, _META).coalesce(1)
     .write.mode("overwrite").json(f"{path}/meta"))


def load(path: str) -> ThreatModel | None:
    """The stored model, or None where there is none or it was made for another vector layout.

    Anything else that goes wrong is an error: detection must not silently go on with rules only.
    """
    spark = SparkSession.active()
    meta_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not meta_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta_path):
        return None
    # The stored metadata names the class
    parts = {kind: DefaultParamsReader.loadParamsInstance(f"{path}/{kind}", spark) for kind in ("flow", "host")}
    rows = {row["kind"]: row for row in spark.read.schema(_META).json(f"{path}/meta").collect()}
    # A pipeline does not say how wide its input is
    if any(getattr(parts[kind], "numFeatures", len(LAYOUT[kind])) != len(LAYOUT[kind]) for kind in parts):
        return None
    return ThreatModel(parts["flow"], parts["host"], {kind: rows[kind]["threshold"] for kind in parts},
                       {kind: tuple(rows[kind]["classes"]) for kind in parts}, {kind: list(rows[kind]["baseline"] or []) for kind in parts})


def feature_importance(model: ThreatModel, kind: str) -> DataFrame:
    """Mean decrease in impurity per vector entry."""
    values = model.of(kind).featureImportances.toArray()
    rows = [(name, label, float(v)) for (name, label), v in zip(LAYOUT[kind].items(), values)]
    return (SparkSession.active().createDataFrame(rows, "feature string, label string, importance double")
            .orderBy(F.desc("importance"), "feature"))


# ---- explanations -------------------------------------------------------------------------------

_EXPLANATION = "array<struct<feature:string,value:double,contribution:double,text:string>>"


def leaf_table(spark: SparkSession, model) -> DataFrame:
    """What reaching a leaf says: per (tree, leaf, feature) the summed change of every class share at the
    splits on that feature. Leaves count from the left, as the model's own leaf column does. One task
    reads one tree."""
    path = f"{checkpoint_dir(spark)}/forest-{model.uid}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.impurityStats")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    shares = nodes.withColumn("share", F.transform("impurityStats", lambda v: F.when(total > 0, v / total).otherwise(F.lit(0.0))))
    return shares.select("tree", "id", "leftChild", "rightChild", "featureIndex", "share").groupBy("tree").applyInPandas(
        _leaf_rows, "tree int, leaf int, feature int, gains array<double>")


def _leaf_rows(tree: pd.DataFrame) -> pd.DataFrame:
    tree = tree.set_index("id").sort_index()
    parent = pd.concat([pd.Series(tree.index, tree[side]) for side in ("leftChild", "rightChild")])
    parent = parent[parent.index >= 0]
    # Node numbers follow a walk that takes the left branch first, so their order is that of the leaves
    at = pd.Series(tree.index[tree["leftChild"] < 0])
    leaf, found = pd.Series(range(len(at))), []
    while len(at := at[at.isin(parent.index)]):
        above = at.map(parent)
        gain = np.stack(tree.loc[at, "share"]) - np.stack(tree.loc[above, "share"])
        found.append(pd.DataFrame(gain).assign(leaf=leaf[at.index].to_numpy(), feature=tree.loc[above, "featureIndex"].to_numpy()))
        at = above
    if not found:
        # A tree that never splits; lists need a column of objects even where there are none
        return pd.DataFrame({"tree": [], "leaf": [], "feature": [], "gains": pd.Series([], dtype=object)})
    sums = pd.concat(found).groupby(["leaf", "feature"]).sum()
    keys = sums.index.to_frame(index=False)
    return keys.assign(tree=int(tree["tree"].iloc[0]), gains=sums.to_numpy().tolist())[["tree", "leaf", "feature", "gains"]]


def leaf_credits(asked: DataFrame, model) -> DataFrame:
    """What the leaves that a row reaches say for its class, averaged over the trees of a forest."""
    named = model.copy().setLeafCol("_leaves").transform(asked)
    reached = (named.select("_row", "_class", vector_to_array("features").alias("_x"), F.posexplode(vector_to_array("_leaves")).alias("tree", "_leaf"))
               .withColumn("leaf", F.col("_leaf").cast("int")))
    gain = F.coalesce(F.get("gains", F.col("_class").cast("int") - 1), F.lit(0.0))
    return (reached.join(leaf_table(asked.sparkSession, model), ["tree", "leaf"])
            .groupBy("_row", "feature").agg((F.sum(gain) / F.lit(model.getNumTrees)).alias("credit"), F.first("_x").alias("_x")))


def ablation_credits(asked: DataFrame, model, baseline: list[float], width: int) -> DataFrame:
    """For any model: how much of the probability of its class a row loses when one entry is put back to the baseline."""
    usual = F.array(*[F.lit(float(v)) for v in (list(baseline) + [0.0] * width)[:width]])
    share = F.coalesce(F.get(vector_to_array("probability"), F.col("_class").cast("int") - 1), F.lit(0.0))
    whole = model.transform(asked).select("_row", "_class", "features", share.alias("_whole"))
    x = vector_to_array("features")
    # One row per entry that differs from the baseline, all of them scored in one pass
    without = (whole.select("_row", "_class", "_whole", x.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("feature"))
               .filter(F.get("_x", F.col("feature")) != F.get(usual, F.col("feature")))
               .withColumn("features", array_to_vector(F.transform("_x", lambda v, i: F.when(i == F.col("feature"), F.get(usual, i)).otherwise(v)))))
    return model.transform(without).select("_row", "feature", (F.col("_whole") - share).alias("credit"), "_x")


def with_explanation(rows: DataFrame, model, kind: str, classes: tuple[str, ...], target: str = "explain_class", top: int = 3,
                     name: str = "factors", baseline: list[float] | None = None) -> DataFrame:
    """Adds the strongest positive factors of the class in ``target`` for the vector in ``features``.

    Null where no class is asked for or it is unknown. A forest is explained by its leaves, any other model that
    reads the vector by putting one entry at a time back to the ``baseline``; one that reads other columns has no factors.
    """
    spark, labels = rows.sparkSession, list(LAYOUT[kind].values())
    # Rows are few next to what they were computed from, and need an identity that a second read keeps
    held = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    wanted = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target))
    asked = held.select("_row", "features", wanted.alias("_class")).filter("_class > 0 and features is not null")
    if isinstance(model, RandomForestClassificationModel):
        credit = leaf_credits(asked, model).filter("credit > 0")
    elif model.hasParam("featuresCol"):
        credit = ablation_credits(asked, model, baseline or [], len(labels)).filter("credit > 0")
    else:
        credit = spark.createDataFrame([], "_row long, feature int, credit double, _x array<double>")
    value = F.round(F.get("_x", F.col("feature")), 3)
    factor = F.struct((-F.col("credit")).alias("order"), "feature", value.alias("value"))
    texts = F.array(*[F.lit(x) for x in labels])
    best = (credit.groupBy("_row").agg(F.slice(F.sort_array(F.collect_list(factor)), 1, top).alias("_best"))
            .select("_row", F.transform("_best", lambda b: F.struct(
                F.get(texts, b["feature"]).alias("feature"), b["value"].alias("value"), F.round(-b["order"], 3).alias("contribution"),
                F.concat(F.get(texts, b["feature"]), F.lit(" = "), _short(b["value"])).alias("text"))).cast(_EXPLANATION).alias(name)))
    known = wanted > 0
    return (held.join(best, "_row", "left")
            .withColumn(name, F.when(known & F.col("features").isNotNull(), F.coalesce(name, F.expr(f"cast(array() as {_EXPLANATION})"))))
            .drop("_row"))


def _short(value: Column) -> Column:
    """A number with six significant digits and no trailing zeros."""
    size = F.greatest(F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-3)))), F.lit(0)).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(5) - size)
    plain = F.regexp_replace(F.format_string("%.3f", F.round(value * scale) / scale), r"\.?0+$", "")
    return F.when(F.abs(value) >= 1e6, F.format_string("%.5e", value)).otherwise(plain)
