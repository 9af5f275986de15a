import itertools
import re

import numpy as np

from wiretide.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    """Targets by hand: cap, share the excess again, until nobody is above."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [k for k in sizes if k is None]
    weight = {k: weights[i % 3] for i, k in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        rest = total - sum(fixed.values())
        share = {k: rest * weight[k] / sum(weight[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 2 * sizes[k]]
        if not over:
            return {**fixed, **share}
        fixed.update({k: 2.0 * sizes[k] for k in over})


def test_targets_and_takings(make_docs, corpus):
    docs = make_docs(corpus)
    got = mixing.mixed_documents(docs).toPandas()
    sizes, sources = {}, {}
    for doc, text, source in (r if len(r) > 2 else (*r, None) for r in corpus):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        sources[(doc, n)] = source
    want = targets(sizes)
    assert len(got) == len(corpus)
    taken = {}
    for row in got.itertuples():
        doc = None if np.isnan(row.doc_id) else int(row.doc_id)
        assert row.taken in (0, row.size, 2 * row.size)
        if doc is not None and doc != 5:
            source = sources[(doc, row.size)]
            assert row.source_size == sizes[source] and abs(row.target - want[source]) < 1e-6
    for target, group in got.groupby("target"):
        taken[target] = group.taken.sum()
    for source, target in want.items():
        near = min(taken, key=lambda t: abs(t - target))
        assert abs(near - target) < 1e-6 and abs(taken[near] - target) <= max(3, 0.01 * target)
    again = mixing.mixed_documents(docs.repartition(7)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))


def test_fit_is_as_near_as_any_subset():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = np.unique(rng.integers(1, 40, 5))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        taken = mixing.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        best = min(abs(sum(a * b for a, b in zip(c, sizes)) - budget) for c in itertools.product(*(range(n + 1) for n in counts)))
        assert abs(int((taken * sizes).sum()) - budget) <= best + int(sizes[-1]) // 2


def test_one_large_group_is_ranked_in_buckets(spark):
    rows = spark.range(5000).selectExpr("id doc_id", "'a' source", "cast(10 as bigint) size").unionByName(
        spark.range(5000, 15000).selectExpr("id doc_id", "'b' source", "cast(7 as bigint) size"))
    got = mixing.mix(rows, share=0.5).toPandas()
    taken = (got["size"] * got.repeats).groupby(got.source).sum()
    want = got.groupby("source").target.first()
    assert abs(taken - want).max() <= 7


def test_no_rows_and_no_words(empty_docs, make_docs):
    assert mixing.mixed_documents(empty_docs).count() == 0
    assert mixing.mixed_documents(make_docs([(1, None), (2, "")])).toPandas().taken.sum() == 0
