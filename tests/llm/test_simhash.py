import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wiretide.llm import simhash


def print_of(text):
    """The fingerprint bit by bit."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def by_hand(rows):
    prints = [print_of(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    small = {g: min((d for d in docs if d is not None), default=None) for g, docs in groups.items()}
    key = lambda x: tuple(str(v) for v in x)
    return sorted(((doc, f"{prints[i]:016x}", small[find(i)]) for i, (doc, _) in enumerate(rows)), key=key)


def test_matches_brute_force(make_docs, corpus):
    got = sorted((tuple(r) for r in simhash.fingerprint_components(make_docs(corpus)).collect()), key=lambda x: tuple(str(v) for v in x))
    assert got == by_hand([(r[0], r[1]) for r in corpus])


def test_shingle_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("drei kleine wörter")).alias("h")).first()
    assert simhash.fingerprint("drei kleine wörter") == row["h"] % (1 << 64)


def test_one_of_each_keeps_the_smallest_and_all_columns(make_docs):
    text = " ".join(f"word{i}" for i in range(50))
    docs = make_docs([(9, text), (3, text), (3, text), (4, "something else entirely " * 5), (7, None), (8, ""), (None, text)])
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]


def flipped(value, rng, most):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        value ^= 1 << bit
    return value


def test_trees_find_every_link(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(60):  # chains of near fingerprints, and one crowded ball
        at = rng.getrandbits(64)
        for _ in range(15):
            values.add(at)
            at = flipped(at, rng, 3)
    centre = rng.getrandbits(64)
    values |= {flipped(centre, rng, 2) for _ in range(300)}
    values = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    want = simhash.components(len(values), *np.nonzero(near))
    tree = simhash.fit_tree(values[::3], 16)
    leaf, fps, home = simhash.route(tree, values)
    place, pairs = {v: i for i, v in enumerate(values.tolist())}, []
    for number in np.unique(leaf):
        here = leaf == number
        found = simhash.leaf_links(fps[here], home[here])
        pairs += [(place[a], place[b]) for a, b in fps[here][found].tolist()]
    assert home.sum() == len(values) and len(np.unique(leaf)) > 4
    assert all(near[a, b] or want[a] == want[b] for a, b in pairs)
    assert (simhash.components(len(values), *np.array(pairs).T) == want).all()
    stars = simhash.stars(spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long"))
    got = {r.node: r.root for r in stars.collect()}
    assert all(got.get(i, i) == want[i] for i in range(len(values)))


def test_no_rows(empty_docs):
    assert simhash.fingerprint_components(empty_docs).count() == 0
