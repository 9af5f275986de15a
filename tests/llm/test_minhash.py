import random

import numpy as np
import pytest

import corpus_pipeline
from wiretide.llm import minhash
from wiretide.llm.common import table

SF = "/root/testdata/sf0.001"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_hand(rows):
    sets, parent = [grams(text) for _, text in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return sorted({min(doc for k, (doc, _) in enumerate(rows) if find(k) == find(i)) for i in range(len(rows))})


def changed(text, rng, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("shingles", [minhash.SLICE, 4000])
def test_near_copies_leave_and_others_stay(make_docs, monkeypatch, shingles):
    monkeypatch.setattr(minhash, "SLICE", shingles)  # bands of several slices in the second case
    rng, rows = random.Random(3), []
    for _ in range(40):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300)))
        rows += [base, changed(base, rng, 1), changed(changed(base, rng, 1), rng, 1), changed(base, rng, len(base.split()) // 8)]
    big = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows += [changed(big, rng, 2) for _ in range(80)] + [changed(big, rng, 6) for _ in range(60)]
    rows += [None, "", " \n ", "one two", "One  TWO", "one two three", "a b c d e f", "a b c d e g"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = minhash.one_of_each_similar(make_docs(rows))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_hand(rows)


def test_the_pipeline_stage_finds_the_near_copies_of_the_table(spark):
    docs = table(spark, SF, "documents")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.schema == docs.schema
    assert sorted(r.doc_id for r in got.collect()) == kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_pairs_at_the_threshold_share_a_band():
    rng, met, n = random.Random(5), 0, 2000
    for _ in range(n):
        values = minhash.np.array([rng.getrandbits(64) for _ in range(110)], minhash.np.uint64)
        a, b = minhash.np.unique(values[:99]), minhash.np.unique(values[11:])  # 88 of 110: 0.8
        assert minhash.similar(a, b)
        met += bool((minhash.bands(a) == minhash.bands(b)).any())
    assert met >= 0.998 * n


def test_sets_meet_through_the_classes_of_their_fingerprints(spark):
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    texts = [base, changed(base, rng, 1), " ".join(f"w{rng.randrange(5000)}" for _ in range(300)), ""]
    a, b, c = (minhash.shingles(t) for t in texts[:3])
    mark = int(minhash.majority(a)) >> 2
    # No band at all; the fourth set shares a fingerprint and is another text
    rows = [(1, len(a), mark, [], texts[0]), (2, len(b), mark ^ 3, [], texts[1]), (3, len(c), mark, [], texts[2]), (0, 0, 0, [], texts[3])]
    found = minhash.links(spark.createDataFrame(rows, "fp long, size long, mark long, keys array<long>, text string"))
    assert {frozenset((r.a, r.b)) for r in found.collect()} == {frozenset((1, 2))}


def test_common_counts_and_forest():
    rng = random.Random(9)
    sets = [np.array(sorted({rng.randrange(60) for _ in range(rng.randint(1, 40))}), np.uint64) for _ in range(50)] + [np.arange(20, dtype=np.uint64)] * 3
    assert [c.tolist() for c in minhash.common_counts(sets)] == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    roots = np.arange(len(sets))
    found = minhash.forest(sets, roots, np.zeros(len(sets), int))
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if minhash.similar(sets[i], sets[j])}
    assert all((max(p), min(p)) in linked for p in found) and len(found) < len(sets)
    for pairs in (found, linked):
        label = list(range(len(sets)))
        for i, j in [tuple(p) for p in pairs] * len(sets):
            label[i] = label[j] = min(label[i], label[j])
        found = label if pairs is found else found
    assert found == label
    assert minhash.forest(sets, np.zeros(len(sets), int), np.zeros(len(sets), int)) == []


def test_no_rows(empty_docs):
    assert minhash.one_of_each_similar(empty_docs).count() == 0
