import numpy as np
import random

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from helpers import T0
from wiretide.config import DetectionConfig
from wiretide.models import evaluation as ev
from wiretide.models import forest
from wiretide.operators.detectors import BEACON, EXFIL, FLOOD, SCAN
from wiretide.operators.flows import flows
from wiretide.operators.windows import fan_in, pane_counts
from wiretide.plans import detection
from wiretide.registry import learning

S = 1_000_000


def vectors(spark, kind, classes, n=40, seed=1):
    """Separable rows: entry i of the vector is high for class i."""
    rng, width = random.Random(seed), len(forest.LAYOUT[kind])
    rows = [([rng.random() + (5 if j == i else 0) for j in range(width)], cls)
            for cls in classes for i in [forest.CLASSES[kind].index(cls)] for _ in range(n)]
    return spark.createDataFrame(rows, "v array<double>, label string").select(array_to_vector("v").alias("features"), "label")


@pytest.fixture(scope="module")
def model(spark):
    return forest.train_both(vectors(spark, "flow", forest.CLASSES["flow"]), vectors(spark, "host", forest.CLASSES["host"]), trees=8, depth=5)


def test_predict(spark, model):
    rows = forest.predict(vectors(spark, "flow", (BEACON, EXFIL), 5, 9), model.flow, model.classes["flow"]).collect()
    assert all(sum(r.ml_probs.values()) == pytest.approx(1.0) and r.ml_prob == max(r.ml_probs.values()) == r.ml_probs[r.ml_class] for r in rows)
    assert sum(r.ml_class == r.label for r in rows) >= 8


def test_explanations(spark, model):
    rows = vectors(spark, "flow", (BEACON,), 5, 9).withColumn("explain_class", F.lit(BEACON))
    rows = rows.unionByName(vectors(spark, "flow", (EXFIL,), 1, 3).withColumn("explain_class", F.lit(None).cast("string")))
    got = forest.with_explanation(rows, model.flow, "flow", model.classes["flow"], name="f").select("label", "f").collect()
    for row in got:
        if row.label == EXFIL:
            assert row.f is None
        else:
            assert row.f and len(row.f) <= 3 and all(x.contribution > 0 and "_" not in x.feature for x in row.f)
            assert max(x.contribution for x in row.f) == row.f[0].contribution and row.f[0].text.startswith(row.f[0].feature + " = ")
    assert any(x.feature == "bytes in flow" for row in got if row.f for x in row.f)


def test_trees_that_never_split_have_no_factors(spark):
    rows = vectors(spark, "flow", (BEACON, EXFIL), 4).withColumn("features", array_to_vector(F.array_repeat(F.lit(1.0), len(forest.LAYOUT["flow"]))))
    alike = forest.train("flow", rows, trees=2, depth=2)
    assert forest.leaf_table(spark, alike).count() == 0
    got = forest.with_explanation(rows, alike, "flow", forest.CLASSES["flow"], target="label").collect()
    assert len(got) == 8 and all(row.factors == [] for row in got)


def test_leaves_add_up_to_the_probability(spark, model):
    """The root's share plus everything a leaf table says about the reached leaves is the forest's own probability."""
    from pyspark.ml.functions import vector_to_array
    row = model.flow.copy().setLeafCol("leaves").transform(vectors(spark, "flow", (BEACON,), 1, 4)).select(
        vector_to_array("leaves").alias("leaves"), vector_to_array("probability").alias("p")).first()
    said = forest.leaf_table(spark, model.flow).toPandas()
    reached = {(tree, int(leaf)) for tree, leaf in enumerate(row.leaves)}
    gains = sum((np.array(g) for t, leaf, g in zip(said.tree, said.leaf, said.gains) if (t, leaf) in reached), np.zeros(len(row.p)))
    path = f"{forest.checkpoint_dir(spark)}/forest-{model.flow.uid}/data"
    roots = [np.array(r.s) / sum(r.s) for r in spark.read.parquet(path).filter("nodeData.id = 0").selectExpr("nodeData.impurityStats s").collect()]
    assert np.allclose(np.mean(roots, axis=0) + gains / len(roots), row.p)


def test_persistence_and_layout_guard(spark, model, tmp_path):
    path = str(tmp_path / "m")
    model.thresholds["flow"] = 0.91
    forest.save(model, path)
    loaded = forest.load(path)
    assert loaded.thresholds["flow"] == 0.91 and loaded.flow.numFeatures == 35 and loaded.classes == model.classes
    assert forest.load(str(tmp_path / "missing")) is None
    forest.save(forest.ThreatModel(model.host, model.host), path)
    assert forest.load(path) is None
    model.thresholds["flow"] = 0.85


def test_other_classifiers_are_stored_loaded_explained_and_run(spark, make_packets, tmp_path):
    """A boosted model with two classes for flows, a logistic one for hosts."""
    def indexed(kind, classes, rows):
        return rows.withColumn("label_index", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1).cast("double"))
    two = (forest.BENIGN, BEACON)
    flow = GBTClassifier(labelCol="label_index", maxIter=4, maxDepth=3, seed=1).fit(indexed("flow", two, vectors(spark, "flow", two)))
    host = LogisticRegression(labelCol="label_index", regParam=0.01).fit(indexed("host", forest.CLASSES["host"], vectors(spark, "host", forest.CLASSES["host"])))
    model = forest.ThreatModel(flow, host, {"flow": 0.0, "host": 0.0}, {"flow": two, "host": forest.CLASSES["host"]}, {"flow": [5.5] + [0.5] * 34, "host": []})
    forest.save(model, str(tmp_path / "m"))
    loaded = forest.load(str(tmp_path / "m"))
    assert type(loaded.flow) is type(flow) and type(loaded.host) is type(host) and (loaded.classes, loaded.baseline) == (model.classes, model.baseline)
    for kind, cls in (("flow", BEACON), ("host", FLOOD)):
        rows = vectors(spark, kind, (cls,), 4, 9).withColumn("explain_class", F.lit(cls))
        got = forest.with_explanation(rows, loaded.of(kind), kind, loaded.classes[kind], name="f", baseline=loaded.baseline[kind]).collect()
        names = list(forest.LAYOUT[kind].values())  # entry i is high for class i, so a benign row has a high entry 0
        assert all(r.f and r.f[0].feature in names[:2] and r.f[0].contribution > 0.1 for r in got)
    alerts = {r.threat_class: r for r in detection.run(attack_packets(make_packets), DetectionConfig(), loaded).collect() if '"Rules' in r.evidence}
    assert {BEACON, EXFIL, SCAN, FLOOD} <= set(alerts) and all('"model_factors":[' in alerts[c].evidence for c in (BEACON, FLOOD, SCAN))


def test_run_statistics(spark, make_packets):
    packets = attack_packets(make_packets)
    alerts, seen = detection.run_with_statistics(packets)
    assert (seen.total_packets, seen.total_alerts) == (packets.count(), alerts.count()) and seen.total_bytes == packets.agg(F.sum("packet_length")).first()[0]
    assert seen.total_flows == flows(packets).count() and seen.total_windows == fan_in(pane_counts(packets)).select("window_start_us").distinct().count()
    row = seen.frame(spark).first()
    assert row.packets_per_second > 0 and row.mean_flow_ms > 0 and row.mean_window_ms > 0 and not row.with_model


def test_importance(model):
    rows = forest.feature_importance(model, "flow").collect()
    assert len(rows) == 35 and [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


@pytest.mark.parametrize("q", [0.0, 0.3, 0.9, 0.9995, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(4)
    values = [round(rng.random(), 3) for _ in range(501)] + [0.0, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert ev.exact_quantile(rows, "v", q).first().quantile == pytest.approx(rows.agg(F.percentile("v", F.lit(q))).first()[0], abs=1e-12)


def test_threshold_is_clamped(spark):
    def of(values):
        return ev.threshold(spark.createDataFrame([(v,) for v in values], "score double"), "flow").first().threshold
    assert of([0.1, 0.2]) == 0.85 and of([0.9] * 10) == 0.9 and of([1.0] * 10) == 0.995 and of([]) == 0.85


def test_interval_labels(spark):
    hosts = spark.createDataFrame([("a", T0 + k * S) for k in range(10)] + [("b", T0)], "host string, window_start_us long")
    labels = spark.createDataFrame([(1, "a", FLOOD, T0 + 4 * S, T0 + 5 * S), (2, "a", SCAN, T0 + 4 * S + 200_000, T0 + 6 * S), (3, "a", FLOOD, T0, T0 + 700_000)],
                                   "label_seq long, ip string, cls string, t_start_us long, t_end_us long")
    got = {(r.host, (r.window_start_us - T0) // S): r.label for r in ev.label_host_windows(hosts, labels).collect()}
    want = {("b", 0): "benign"}
    for k in range(10):
        label = "benign"
        for cls, t0, t1 in ((FLOOD, 40, 50), (SCAN, 42, 60), (FLOOD, 0, 7)):
            if min(10 * k + 30, t1) - max(10 * k, t0) >= 8:
                label = cls
        want[("a", k)] = label
    assert got == want


def attack_packets(make_packets):
    """A beacon, a flood, a scan and an upload among quiet traffic."""
    rows = [{"t": 2.0 * i, "src_ip": "10.0.0.7", "dst_ip": "203.0.113.5", "dst_port": 4444} for i in range(20)]
    rows += [{"t": 5 + i * 0.002, "src_ip": f"198.51.100.{i % 200}", "src_port": 1024 + i, "dst_ip": "10.0.0.80", "dst_port": 80, "syn": True, "ack": False,
              "payload_length": 0} for i in range(600)]
    rows += [{"t": 20 + i * 0.1, "src_ip": "10.0.0.66", "src_port": 50000 + i, "dst_ip": "10.0.0.5", "dst_port": 20 + i, "syn": True, "ack": False, "payload_length": 0}
             for i in range(13)]
    rows += [{"t": 30 + i * 0.002, "src_ip": "10.0.0.9", "dst_ip": "203.0.113.77", "packet_length": 1500, "payload_length": 1446} for i in range(600)]
    rows += [{"t": 3.3 * i * (1 + i % 3), "src_ip": f"10.0.1.{i}", "dst_ip": "203.0.113.9"} for i in range(30)]
    return make_packets(rows)


def test_each_attack_is_reported_as_its_own_class(make_packets):
    alerts = detection.run(attack_packets(make_packets)).collect()
    assert sorted(r.threat_class for r in alerts) == [BEACON, EXFIL, SCAN, FLOOD]
    assert [r.id for r in sorted(alerts, key=lambda r: (r.ts, r.flow_id))] == [1, 2, 3, 4]


def test_quiet_traffic_raises_nothing(make_packets):
    rows = [{"t": 3.3 * i * (1 + i % 3), "src_ip": f"10.0.1.{i % 9}", "src_port": 40000 + i} for i in range(60)]
    assert detection.run(make_packets(rows)).count() == 0


def test_model_annotates_alerts(make_packets, model):
    model = forest.ThreatModel(model.flow, model.host, {"flow": 0.0, "host": 0.0})
    alerts = {r.threat_class: r for r in detection.run(attack_packets(make_packets), DetectionConfig(), model).collect() if '"Rules' in r.evidence}
    assert {BEACON, EXFIL, SCAN, FLOOD} <= set(alerts)
    assert all('"model_factors":[' in r.evidence and '"model_probability":' in r.evidence for r in alerts.values())


def test_model_card(spark, model, tmp_path):
    rows = spark.createDataFrame([(BEACON, BEACON, "benign"), ("benign", "benign", "benign")], "label string, rule_label string, model_label string")
    metrics = ev.comparison(rows)
    counts = {kind: ev.class_counts(vectors(spark, kind, forest.CLASSES[kind])) for kind in ("flow", "host")}
    ev.write_model_card(ev.model_card(model, metrics, counts), str(tmp_path / "card"))
    card = spark.read.json(str(tmp_path / "card")).first()
    assert len(card.flow_model.features) == 35 and card.flow_model.trees == 8 and len(card.host_model.top_features) == 8
    assert {(m.variant, m.recall) for m in card.holdout} == {("rules", 1.0), ("model", 0.0), ("hybrid", 1.0)}


def test_flows_are_computed_once_for_a_fit(spark, monkeypatch):
    """Weights need counts of all rows; the flows are not computed again for them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(label):
        seen.add(1)
        return label
    rows = vectors(spark, "flow", (BEACON, EXFIL), 15).withColumn("label", F.udf(counted, "string").asNondeterministic()("label"))
    monkeypatch.setattr(learning, "_flow_rows", lambda spark, sf_dir, held: rows)
    assert learning._fit_flows(spark, "", trees=3, depth=2).getNumTrees == 3 and seen.value == 30
