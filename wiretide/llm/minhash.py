"""Near-duplicates by Jaccard similarity of word shingles, found through SimHash and MinHash and confirmed exactly.

Texts with the same set of shingles are one set. Each set has a SimHash fingerprint of its shingles; the vantage-point
trees of ``simhash`` find the classes of fingerprints that few differing bits link, and the sets of a class meet. Pairs
at the threshold mostly differ in more bits, so sets that agree on all values of a MinHash band meet as well; a class is
handled like a band. Sets that meet link if the exact similarity of their shingles is high enough. A pair at the threshold
shares a band with probability 1 - (1 - SIMILARITY ** BAND_ROWS) ** BANDS. First every member of a band is compared with
the band's first one, which joins most groups of copies at once. Bands whose members that leaves apart become groups of sets: a task counts the shingles
that members share from posting lists and returns a spanning forest, so that no candidate pair is ever a row. Bands with
the same members are one group, and a band of more than SLICE shingles meets slice by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretide.llm import simhash
from wiretide.llm.common import stored, text_batches
from wiretide.llm.simhash import majority, one_of_each, rooted_classes, stars

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, BAND_ROWS = 26, 6
BATCH_BYTES = 2 << 20
#: Shingles of the members of a band that one slice should hold; a task holds two slices.
SLICE = 1 << 20

_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)[:, None]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; a text of fewer words is one shingle, one without words none."""
    import xxhash
    words = b" ".join((text or "").encode().lower().split())
    if not words:
        return np.zeros(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(words)]
    width, digest = min(SHINGLE, len(starts)), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(words[a:b], SEED) for a, b in zip(starts, ends[width - 1:])], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of SIMILARITY or more; two empty ones have."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILARITY * (len(a) + len(b) - common)


def bands(hashed: np.ndarray) -> np.ndarray:
    """One key per band for a set that is not empty."""
    import xxhash
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashed), 2048):
        least = np.minimum(least, (_FACTORS * hashed[at:at + 2048] + _SHIFTS).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


def _sets(batches):
    import xxhash
    for part in text_batches(batches, BATCH_BYTES):
        texts, known = part.column("text").to_pylist(), {}
        for text in set(texts):
            hashed = shingles(text)
            name = xxhash.xxh64_intdigest(hashed.tobytes(), SEED) if len(hashed) else 0
            mark = np.uint64(majority(hashed)).astype(np.int64).item()
            known[text] = np.uint64(name).astype(np.int64).item(), len(hashed), mark, bands(hashed).tolist() if len(hashed) else []
        fp, size, marks, keys = zip(*(known[t] for t in texts))
        yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in (fp, size, marks)), pa.array(keys, pa.list_(pa.int64()))],
                                         names=[*part.schema.names, "fp", "size", "mark", "keys"])


def _confirmed(batches):
    for batch in batches:
        known: dict[str, np.ndarray] = {}
        held = 0

        def of(text):
            nonlocal held
            if text not in known:
                if held > BATCH_BYTES:
                    known.clear()
                    held = 0
                known[text] = shingles(text)
                held += len(known[text]) * 8
            return known[text]
        keep = [similar(of(a), of(b)) for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingled(batches):
    for part in text_batches(batches, BATCH_BYTES):
        hashed = [shingles(text).tobytes() for text in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("fp"), pa.array(hashed, pa.binary())], names=["fp", "hashed"])


def common_counts(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set in turn, how many values it shares with every set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(value, kind="stable")
    postings, length = owner[order], np.bincount(value)
    start = np.cumsum(length) - length
    at = 0
    for s in sets:
        mine = value[at:at + len(s)]
        at += len(s)
        n = length[mine]
        places = np.arange(n.sum()) + np.repeat(start[mine] - (np.cumsum(n) - n), n)
        yield np.bincount(postings[places], minlength=len(sets))


def forest(sets: list[np.ndarray], roots: np.ndarray, slices: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what similar pairs of members join, beyond what has the same root already; of two slices, pairs
    within one are left to the group of that slice."""
    sizes, found = np.array([len(s) for s in sets]), []
    _, label = np.unique(roots, return_inverse=True)
    two = slices.min() != slices.max()
    for i, common in enumerate(common_counts(sets)):
        if (label == label[0]).all():
            break
        if two and slices[i] != slices.min():
            continue
        near = (common >= SIMILARITY * (sizes[i] + sizes - common)) & (label != label[i])
        for j in np.flatnonzero(near & (slices != slices[i]) if two else near):
            if label[j] != label[i]:
                found.append((i, int(j)))
                label[label == label[j]] = label[i]
    return found


def _group(frame: pd.DataFrame) -> pd.DataFrame:
    fps = frame["fp"].to_numpy(np.int64)
    pairs = np.array(forest([np.frombuffer(h, np.uint64) for h in frame["hashed"]], frame["root"].to_numpy(np.int64), frame["slice"].to_numpy(np.int64)),
                     np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": fps[pairs[:, 0]], "b": fps[pairs[:, 1]]})


def classes(sets: DataFrame) -> DataFrame:
    """(mark, key): one key per class of the fingerprints ``mark`` that are linked through the vantage-point trees."""
    marks = stored(sets.select(F.col("mark").alias("fp")).distinct())
    roots = stars(simhash.links(marks)).withColumnRenamed("node", "fp")
    return marks.join(roots, "fp", "left").select(F.col("fp").alias("mark"), F.xxhash64(F.lit(BANDS), F.coalesce("root", "fp")).alias("key"))


def links(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets in ``rows`` (fp, size, mark, keys, text) that connect exactly the similar ones that share
    a class of fingerprints or a band."""
    sets = rows.filter("size > 0").select("fp", "size", "mark", "keys").dropDuplicates(["fp"])
    each = (sets.select("fp", "size", F.explode("keys").alias("key"))
            .unionByName(sets.select("fp", "size", "mark").join(classes(sets), "mark").drop("mark")))
    shared = each.groupBy("key").agg(F.min_by(F.struct(F.col("fp").alias("a"), F.col("size").alias("size_a")), "fp").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(each.join(shared.select("key", "first.*"), "key"))
    texts = stored(rows.select("fp", "text").join(members.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text")))
    pairs = members.filter("fp <> a").filter(F.least("size", "size_a") >= SIMILARITY * F.greatest("size", "size_a")).select("a", F.col("fp").alias("b")).distinct()
    found = stored(pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
                   .join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
                   .select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long"))
    roots = stars(found).withColumnRenamed("node", "fp")
    rooted = members.select("key", "fp", "size").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Of bands with the same members, told by their number and 128 bits, one is enough
    open_ = (rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"),
                                       *(F.bit_xor(F.xxhash64(F.lit(i), "fp")).alias(f"m{i}") for i in (1, 2)))
             .filter("low <> high").groupBy("n", "m1", "m2").agg(F.min("key").alias("key"), F.first("total").alias("total"))
             .select("key", F.ceil(F.col("total") / SLICE).cast("int").alias("slices")))
    groups = rooted.join(open_, "key").withColumn("slice", F.pmod(F.xxhash64("fp"), "slices").cast("int"))
    groups = groups.select("key", "fp", "root", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    sets = texts.mapInArrow(_shingled, "fp long, hashed binary")
    apart = (groups.join(sets, "fp").withColumns({"i": F.least("slice", "other"), "j": F.greatest("slice", "other")})
             .groupBy("key", "i", "j").applyInPandas(_group, "a long, b long"))
    return found.unionByName(stored(apart))


def near_duplicates(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, fp (long, names a set of shingles), root, component_id and the columns of ``extra``, as in simhash."""
    rows = docs.select("doc_id", *extra, "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in rows.columns), "fp long", "size long", "mark long", "keys array<long>"])
    sets = stored(rows.mapInArrow(_sets, schema))
    return rooted_classes(sets.select("doc_id", *extra, "fp"), lambda _: links(sets))


def one_of_each_similar(docs: DataFrame) -> DataFrame:
    """The documents with one of each component of similar texts: the one with the smallest doc_id."""
    return one_of_each(docs, near_duplicates)
