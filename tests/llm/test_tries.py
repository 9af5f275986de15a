import hashlib
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wiretide.llm import tries
from wiretide.llm.tries import prefix_trie, subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if whole[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "parent", "p", "length", "bytes", "depth")}))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_shared_openings_nulls_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(40), -3, -5, 10**12, 10**12 + 1]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello", "ünï", "", None])))
    rows += [(41, None, None, None), (41, None, "user", "x"), (41, 2, "user", "b"), (41, 2, "user", "a"), (41, 2, "user", "a"), (41, 2, None, "z"),
             (None, 0, "user", "nobody"), (42, 0, "us", "er"), (43, 0, "user", "")]
    check(spark, rows + rows[:3])


def test_one_text_for_all_and_hot_openings(spark):
    check(spark, [(c, t, "user", "same") for c in range(60) for t in range(4)] + [(c, t, "user", f"own {c}") for c in range(60, 90) for t in range(2)])


def test_pieces_and_their_digests(monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 3)
    ids = pd.DataFrame({"a1": [1] * 7 + [1] * 2 + [5], "a2": [2] * 7 + [3] * 2 + [3], "conv_id": [1, 2, 30, 4000, 5000, 60000, 70000, -5, 9, 8]})
    pieces = pd.concat(tries._pieces([ids[:4], ids[4:]]))
    assert pieces.ids.tolist() == ["1,2,30", "4000", "5000,60000,70000", "-5,9", "8"] and pieces["first"].tolist() == [1, 4000, 5000, -5, 8]
    got = pd.concat(tries._digests([pieces[:2], pieces[2:]]))
    assert got.ends_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in ("1,2,30,4000,5000,60000,70000", "-5,9", "8")]


def test_long_conversation_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 16)
    check(spark, [(5, t, "user", f"t{t % 7}") for t in range(150)] + [(6, t, "user", f"t{t % 7}") for t in range(130)] + [(8, 0, "user", "t0")])


def test_no_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("kind", ["chain", "star", "random", "forest"])
def test_totals_of_any_shape(spark, kind):
    rng, n = random.Random(kind), 120
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i), "forest": lambda i: None if i % 40 == 0 else rng.randrange(i - i % 40, i)}[kind]
    up = {i: parent(i) if i else None for i in range(n)}
    total = {i: i * i for i in range(n)}
    for i in reversed(range(n)):
        if up[i] is not None:
            total[up[i]] += total[i]
    got = subtree_totals(spark.createDataFrame([(i, up[i], i * i) for i in range(n)], "id long, parent long, x long"), "x")
    assert {r.id: r.x for r in got.collect()} == total
