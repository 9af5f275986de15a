import math
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from wiretide.llm.common import table
from wiretide.llm.quality import BUCKETS, THRESHOLD, quality

SF = "/root/testdata/sf0.001"
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \t\n\x0b\f\r]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def grams(text):
    tokens = [t.encode() for t in TOKEN.findall(text or "")]
    hashed = [xxhash.xxh64_intdigest(t, 42) for t in tokens]
    return [h % BUCKETS for h in hashed] + [xxhash.xxh64_intdigest(b, a) % BUCKETS for a, b in zip(hashed, tokens[1:])]


def expected(rows, trusted):
    """(doc_id, measures, kept, score) of rows (doc_id, text)."""
    every, good = Counter(), Counter()
    for doc, text in rows:
        found = grams(text)
        every.update(found)
        if doc in trusted:
            good.update(found)
    n, t = sum(every.values()), sum(good.values())
    ratio = [round(1e6 * (math.log((good[b] + 1) / (t + BUCKETS)) - math.log((every[b] + 1) / (n + BUCKETS)))) if t else 0 for b in range(BUCKETS)]
    out = []
    for doc, text in rows:
        found, measures = grams(text), base(text)
        score = sum(ratio[b] for b in found) / len(found) / 1e6 if found else 0.0
        out.append((doc, *measures, not measures[-1] and score >= THRESHOLD, round(score, 5)))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((*r[:-1], round(r[-1], 5)) for r in frame.collect()), key=str)


def test_equals_plain_counting(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    got = rows_of(quality(docs, labels))
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()], trusted)
    assert any(not r[6] and not r[7] for r in got) and any(r[7] for r in got)


def test_nulls_ties_repeats_and_clashing_names(spark, make_docs, corpus):
    rows = [(r[0], r[1]) for r in corpus] + [(500, "a b c\na b c\n \x0b\n a b c\n" * 30), (501, "# * $\r\n" * 60), (502, "x"), (503, "a b c a b c"), (504, "ñ # | é"),
                                             (505, "one two three\n\n\none two three")]
    docs = make_docs([(*r[:2], "s") for r in rows]).withColumns({c: F.lit("clash") for c in ("n_words", "llr", "_tokens", "_buckets", "ratios", "kept", "bucket")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(3, 0, 0), (7, 1, 0), (None, 1, 0), (600, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert rows_of(quality(docs, labels)) == expected(rows, set(range(40)) - {3})


@pytest.mark.parametrize("labelled", [False, True])
def test_empty_tables(spark, make_docs, empty_docs, labelled):
    labels = spark.createDataFrame([(1, 0, 0)] if labelled else [], "doc_id long, quality int, toxic int")
    assert quality(empty_docs, labels).collect() == []
    kept = {r.doc_id: (r.kept, r.llr) for r in quality(make_docs([(1, " ".join(f"w{i}" for i in range(60))), (2, "short")]), labels).collect()}
    assert kept == {1: (True, 0.0), 2: (False, 0.0)}


def test_junk_goes_and_prose_stays(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    half = labels.filter("doc_id % 2 = 0")
    judged = quality(docs, half).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.05
