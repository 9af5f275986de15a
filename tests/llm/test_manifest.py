import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wiretide.llm.manifest import PROOF, butterfly, depth, document_manifest, fold, manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """The root and, per leaf, its siblings left and right by level."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(where):
            run = nodes[at // 3 * 3: at // 3 * 3 + 3]
            proofs[leaf].append(("".join(run[:at % 3]), "".join(run[at % 3 + 1:])))
        nodes, where = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)], [at // 3 for at in where]
    return nodes[0], proofs


def expected(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of rows (doc_id, text, lang, source, n_chars)."""
    def leaf(i, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        inner[name] = climb([x[2] for x in trees[name]])
    root, outer = climb([inner[name][0] for name in names])
    out = []
    for name, top in zip(names, outer):
        for (_, _, own, row), low in zip(trees[name], inner[name][1]):
            proof, start = low + top, own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None:
                start = leaf(row[0], row[1].replace("\n", ""), *row[2:])
            for left, right in proof:
                start = sha(left + start + right)
            out.append((row[0], own, inner[name][0], root, sha("".join(a + b for a, b in proof)), start, start == root))
    return sorted(out, key=str)


def documents(sizes):
    rows = []
    for name, size in sizes.items():
        rows += [(1000 * len(rows) + i, f"text {i}\nof ä {name}\n" if i % 3 else f"one line {i}", "en", name, i) for i in range(size)]
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3}, {"a": 4, "b": 1}, {None: 2, "": 3, "b": 10, "Z": 1, "ä": 9, "-": 2},
                                   {"hot": 243 * 4 + 7, "x": 243, "y": 244, "z": 243 * 3 + 1}])
def test_equals_plain_hashing(spark, sizes):
    rows = documents(sizes)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in document_manifest(docs).collect()), key=str)
    assert got == expected(rows)
    broken = [r for r in got if not r[-1]]
    assert len(rows) < 20 or broken and len(broken) < len(rows)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a\nb", None, "s", None), (None, None, "en", "s", 3), (7, "x\n" * 5000, "en", "s", 4), (7, "x\n" * 5000, "en", "s", 4), (7, "", "de", "s", 0),
            (8, None, "fr", None, 1), (-5, "minus\n", "fr", None, 1)]
    docs = (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
            .withColumns({c: F.lit("clash") for c in ("leaf", "root", "tree", "key", "proof", "_place", "place", "_i")}))
    assert sorted((tuple(r) for r in document_manifest(docs).collect()), key=str) == expected(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert document_manifest(docs).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 10, 13, 27, 31, 80])
def test_every_node_meets_all_sisters(spark, n):
    nodes = [sha(str(i)) for i in range(n)]
    got = butterfly(spark.createDataFrame([("t", i, n, h) for i, h in enumerate(nodes)], "tree string, place long, n long, root string"), depth(n))
    root, proofs = climb(nodes)
    for r in got.collect():
        assert r.root == root and [(p.left, p.right) for p in r.path] == proofs[r.place]


def test_proofs_lead_to_the_root(spark):
    leaves = spark.range(600).select((F.col("id") % 7).cast("string").alias("tree"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    proved = manifest(leaves)
    assert dict(proved.dtypes)["proof"] == PROOF and proved.filter(fold(F.col("leaf"), "proof") != F.col("root")).count() == 0
    assert proved.select("root").distinct().count() == 1 and proved.select("subroot").distinct().count() == 7
