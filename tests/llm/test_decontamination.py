import hashlib
import re

import duckdb
import numpy as np
import pytest

from tools.check_oracles import compare
from wiretide.llm import decontamination, queries
from wiretide.llm.fmindex import FMIndex, suffix_order

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_hand(docs, bench, width=10):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i:i + n])]
        names = sorted(str(x) for x in items if x is not None)
        out.append((-1 if doc is None else doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def bench(corpus):
    texts = [t for _, t, *_ in corpus if t and len(t.split()) > 30]
    items = [(i, " ".join(texts[i].split()[5:25])) for i in range(8)]
    return items + [(50, texts[9].split()[2] + " " + texts[9].split()[3]), (51, ""), (52, None), (None, " ".join(texts[10].split()[:12])), (3, items[3][1]), (53, items[3][1].upper())]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_matches_brute_force(spark, make_docs, corpus, bench, block_bytes):
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.contamination(make_docs(corpus), items, block_bytes=block_bytes).toPandas()
    assert sorted(got.fillna(-1).astype({"doc_id": int}).itertuples(index=False, name=None)) == by_hand([(r[0], r[1]) for r in corpus], bench)


def test_empty_tables(spark, make_docs, corpus, empty_docs, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontamination.contamination(make_docs(corpus), none).filter("contaminated").count()
    assert decontamination.contamination(empty_docs, spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_cleaned_texts_hold_no_window_and_clean_ones_stay(spark, make_docs, corpus, bench):
    docs, items = make_docs(corpus), spark.createDataFrame([b for b in bench if b[0] != 50], "item_id long, text string")
    got = decontamination.decontaminated(docs, items)
    assert got.schema == docs.schema and not decontamination.contamination(got, items).filter("contaminated").count()
    flags = {r.doc_id: r.contaminated for r in decontamination.contamination(docs, items).collect() if r.doc_id is not None}
    after = {r.doc_id: r.text for r in got.collect()}
    assert any(flags.values()) and all(after[i] == t for i, t, *_ in corpus if i is not None and not flags[i])


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    assert compare(queries.op2(spark, SF).toPandas(), con.execute(queries.ORACLES["op2_decontamination"]).df()) == ""


def test_index_finds_every_place():
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 5, 400)
    symbols[[60, 61, 200, 399]] = 0
    order = suffix_order(symbols)
    stops = {int(p): k for k, p in enumerate(np.flatnonzero(symbols == 0))}
    key = [(-100 + stops[i] if s == 0 else s) for i, s in enumerate(symbols.tolist())]
    assert order.tolist() == sorted(range(400), key=lambda i: key[i:])
    index = FMIndex(symbols, 4)
    phrases = rng.integers(1, 5, (60, 4))
    lengths = rng.integers(1, 5, 60)
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(400) if symbols[i:i + n].tolist() == p[:n].tolist()]


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_blocks_of_the_benchmark_do_not_change_what_is_cut(spark, make_docs, block_bytes):
    w = [f"w{i}" for i in range(60)]
    shared = " ".join(w[:12])
    bench = [(i, f"{shared} question {w[20 + i]} of item {i}") for i in range(8)]
    bench += [(20 + i, " ".join(f"x{i}y{j}" for j in range(10))) for i in range(8)]
    docs = [(i, f"before, {text}; after") for i, (_, text) in enumerate(bench[:8])]
    # Cutting one item joins the words of another
    docs += [(100 + 8 * i + j, " ".join([*b.split()[:4], a, *b.split()[4:], "end"])) for i, (_, a) in enumerate(bench[8:]) for j, (_, b) in enumerate(bench[8:]) if i != j]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.decontaminated(make_docs(docs), items, block_bytes=block_bytes)
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert texts.keys() == {i for i, _ in docs}
    assert all(n == len(t) and words(t) == (["before", "after"] if i < 100 else ["end"]) for i, (t, n) in texts.items())
