"""SimHash near-duplicates, found through vantage-point trees over Hamming distance.

Distinct fingerprints go down one tree, fitted on a bounded sample. A fingerprint lives in one leaf; where its distance
to a vantage point lies so near beyond the radius that a neighbour may lie within, it also visits the inner branch.
Every leaf, a Spark group, goes on splitting its members the same way and compares the rest exactly. Leaves return
spanning forests instead of all pairs, and stars joined across leaves give the components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretide.llm.common import stored, text_batches

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Distinct fingerprints a leaf should hold, most leaves of the shared tree, and sampled fingerprints per leaf.
LEAF_ROWS, MAX_LEAVES, SAMPLE_PER_LEAF = 4096, 4096, 64
#: Members below which a branch is compared pair by pair.
SMALL = 48
BATCH_BYTES = 2 << 20


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the XXH64 values of all word shingles; no words give 0."""
    import xxhash
    words = b" ".join((text or "").encode().lower().split())
    if not words:
        return 0
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(words)]
    width, digest = min(SHINGLE, len(starts)), xxhash.xxh64_intdigest
    return majority(np.array([digest(words[a:b], SEED) for a, b in zip(starts, ends[width - 1:])], np.uint64))


def majority(hashed: np.ndarray) -> int:
    """A bit for every bit that more than half of the hash values have."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        part = hashed[at:at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashed), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for part in text_batches(batches, BATCH_BYTES):
        texts = part.column("text").to_pylist()
        known = {text: fingerprint(text) for text in set(texts)}
        values = np.array([known[t] for t in texts], np.uint64).view(np.int64)
        others = [name for name in part.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in others), pa.array(values)], names=[*others, "fp"])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def _split(members: np.ndarray, rng) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius near the median with the fewest members just beyond it; None if they can't be parted."""
    best = None
    for vantage in rng.choice(members, min(4, len(members)), replace=False):
        counts = np.bincount(distance(members, vantage), minlength=68)
        inside = np.cumsum(counts)
        for radius in range(64):
            if 0.25 * len(members) <= inside[radius] <= 0.75 * len(members):
                beyond = inside[radius + MAX_BITS] - inside[radius]
                if best is None or beyond < best[0]:
                    best = (beyond, vantage, radius)
    return best and best[1:]


def fit_tree(sample: np.ndarray, leaves: int):
    """Nested (vantage, radius, inner, outer); a leaf is its number."""
    rng, numbers = np.random.default_rng(7), iter(range(1 << 30))

    def grow(members: np.ndarray, wanted: int):
        cut = _split(members, rng) if wanted > 1 and len(members) >= 8 else None
        if cut is None:
            return next(numbers)
        within = distance(members, cut[0]) <= cut[1]
        inner = round(wanted * within.mean())
        return (*cut, grow(members[within], inner), grow(members[~within], wanted - inner))
    return grow(sample, leaves)


def branches(fps: np.ndarray, at_home: np.ndarray, vantage, radius: int):
    """Index arrays of the inner and outer branch. A home goes to one side, and visits the inner one from just beyond it."""
    d = distance(fps, vantage)
    inner = d <= np.where(at_home, radius, radius + MAX_BITS)
    outer = d > np.where(at_home, radius, radius - MAX_BITS)
    visits = at_home & outer & (d <= radius + MAX_BITS)
    return np.flatnonzero(inner | visits), np.flatnonzero(outer), visits


def route(tree, fps: np.ndarray):
    """(leaf, fingerprint, at home) arrays for every leaf a fingerprint belongs to or has to visit."""
    found = []

    def walk(node, fps, home):
        if not len(fps):
            return
        if not isinstance(node, tuple):
            found.append((np.full(len(fps), node, np.int64), fps, home))
            return
        vantage, radius, inner, outer = node
        inside, outside, visits = branches(fps, home, vantage, radius)
        walk(inner, fps[inside], home[inside] & ~visits[inside])
        walk(outer, fps[outside], home[outside])
    walk(tree, fps, np.ones(len(fps), bool))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` nodes is linked to."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == labels).all():
            return labels
        labels = new


def leaf_links(fps: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Pairs of positions that span the same components as all pairs within MAX_BITS that have at least one home member."""
    rng, n = np.random.default_rng(11), len(fps)
    held = [np.zeros((0, 2), np.int64)]
    size = 0

    def star() -> np.ndarray:
        pairs = np.concatenate(held)
        labels = components(n, pairs[:, 0], pairs[:, 1])
        other = np.flatnonzero(labels != np.arange(n))
        return np.stack([labels[other], other], axis=1)

    def keep(pairs: np.ndarray) -> None:
        nonlocal held, size
        held.append(pairs)
        size += len(pairs)
        if size > 1 << 19:
            held, size = [star()], 0

    def compare(index, at_home):
        homes = index[at_home]
        for first in range(0, len(homes), 64):
            block = homes[first:first + 64]
            for at in range(0, len(index), 1 << 15):
                part = index[at:at + (1 << 15)]
                i, j = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[part][None, :]) <= MAX_BITS)
                i, j = block[i], part[j]
                if (i != j).any():
                    keep(np.stack([i[i != j], j[i != j]], axis=1))

    def walk(index, at_home):
        homes = int(at_home.sum())
        if not homes or len(index) < 2:
            return
        cut = _split(fps[index[at_home]], rng) if homes > SMALL else None
        if cut is None:
            compare(index, at_home)
            return
        inside, outside, visits = branches(fps[index], at_home, *cut)
        if len(inside) + len(outside) > 1.7 * len(index):  # the triangle bound parts too little here
            compare(index, at_home)
            return
        walk(index[inside], at_home[inside] & ~visits[inside])
        walk(index[outside], at_home[outside])
    walk(np.arange(n), home)
    return star()


def _route_all(tree):
    def run(frames):
        for frame in frames:
            leaf, fps, home = route(tree, frame["fp"].to_numpy().astype(np.int64).view(np.uint64))
            yield pd.DataFrame({"leaf": leaf, "fp": fps.view(np.int64), "home": home})
    return run


def _leaf(group: pd.DataFrame) -> pd.DataFrame:
    fps = group["fp"].to_numpy().astype(np.int64)
    pairs = leaf_links(fps.view(np.uint64), group["home"].to_numpy().astype(bool))
    return pd.DataFrame({"a": fps[pairs[:, 0]], "b": fps[pairs[:, 1]]})


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that connect exactly those within MAX_BITS of each other."""
    spark, n = fps.sparkSession, fps.count()
    leaves = max(1, min(MAX_LEAVES, -(-n // LEAF_ROWS)))
    sample = [row[0] for row in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_LEAF * leaves).collect()]
    tree = fit_tree(np.array(sample, np.int64).view(np.uint64), leaves)
    routed = fps.mapInPandas(_route_all(tree), "leaf long, fp long, home boolean").repartition(max(leaves * 2, 8), "leaf")
    return routed.groupBy("leaf").applyInPandas(_leaf, "a long, b long")


def stars(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the smallest node of its component.

    Large and small stars in turn: each node hands its larger neighbours, then its smaller ones, to the smallest it sees,
    until nothing changes. Rounds grow with the logarithm of the longest chain.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        edges = stored(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def near_duplicates(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, fp (long), root (a fingerprint), component_id for every document, and the columns of ``extra``.

    component_id is the smallest doc_id that links reach, the document's own included, null if none there has one. Texts
    without words, null ones too, have fingerprint zero and link like any other; equal texts always link. Documents
    without doc_id or with repeated ones are rows of their own. No documents give no rows.
    """
    rows = docs.select("doc_id", *extra, "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in ("doc_id", *extra)), "fp long"])
    return rooted_classes(stored(rows.mapInArrow(_fingerprints, schema)), links)


def rooted_classes(fps: DataFrame, linked) -> DataFrame:
    """The rows of ``fps`` (doc_id, fp, others) with root and component_id, from the links that ``linked`` finds among distinct fp."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    roots = stars(linked(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = stored(rooted.join(smallest, "root").select("fp", "root", "component_id"))
    return fps.join(classes, "fp")


def fingerprint_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, near=near_duplicates) -> DataFrame:
    """The documents with one of each component that ``near`` finds: the one with the smallest doc_id. All columns stay as they are."""
    text = F.xxhash64("text")
    found = near(docs.withColumn("_text", text), "_text")
    kept = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
            .agg(F.min(F.struct("doc_id", "_text")).alias("kept")).select("kept.doc_id", "kept._text").withColumnRenamed("doc_id", "_id"))
    rows = docs.withColumn("_text", text)
    return (rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["_text"] == kept["_text"]), "left_semi")
            .dropDuplicates(["doc_id", "_text"]).drop("_text"))
