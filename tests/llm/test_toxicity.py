import random

import numpy as np
import pytest

from wiretide.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rng = random.Random(12)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(1, len(words) // (20 if i % 12 else 8))):
                words[rng.randrange(len(words))] = rng.choice(["Vileword", "badterm", "grollig" + rng.choice(common)])
        docs.append((i, " ".join(words)))
        if i % 2 == 0 or i % 6 == 0 and i < 600:
            labels.append((i, 1, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "vileword"), (None, "badterm and badterm")]
    labels += [(7, 1, None), (None, 1, 1), (0, 1, 0)]
    return make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_held_out_documents_are_told_apart(labelled):
    docs, labels, rows = labelled
    got = toxicity.severity(docs, labels).toPandas()
    assert len(got) == len(rows)
    held = got[got.doc_id.between(600, 1199)]
    truth = held.doc_id % 6 == 0
    assert held.toxic[truth].mean() > 0.95 and held.toxic[~truth].mean() < 0.01
    assert np.allclose(got[["p_none", "p_mild", "p_severe"]].sum(axis=1), 1) and np.allclose(got.expected_severity, got.p_mild + 2 * got.p_severe)
    dense, thin = held[held.doc_id % 12 == 0], held[truth & (held.doc_id % 12 == 6)]
    assert dense.expected_severity.mean() > thin.expected_severity.mean()
    assert not got[got.doc_id.isin([5000, 5001])].toxic.any()


def test_the_filter_keeps_what_is_not_toxic(labelled):
    docs, labels, _ = labelled
    kept = toxicity.without_toxic(docs, labels)
    verdict = toxicity.severity(docs, labels)
    assert kept.schema == docs.schema and kept.count() == verdict.filter("not toxic").count()


def test_thresholds_stay_in_order_and_the_fit_is_a_minimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=600)
    grades = np.digitize(2 * x + rng.logistic(size=600), [-1.0, 1.5])
    rows, bins = np.arange(600), np.zeros(600, np.int64)
    weights, cuts = toxicity.fit_ordinal(rows, bins, x, grades, 1, rounds=1500, rate=0.05, ridge=0.0)
    assert abs(weights[0] - 2) < 0.4 and cuts[0] < cuts[1] and abs(cuts[0] + 1) < 0.35 and abs(cuts[1] - 1.5) < 0.35


def test_without_labels_nothing_is_toxic(spark, labelled, empty_docs):
    docs, labels, rows = labelled
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.severity(docs, none).filter("toxic or expected_severity > 0").count() == 0
    assert toxicity.severity(empty_docs, labels).count() == 0 and toxicity.without_toxic(docs, none).count() == len(rows)
