"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

A huge text is cut into overlapping chunks, encoded anywhere. Two neighbours are spliced inside their overlap at a
border that both encodings have and that is proven stable: no piece of the vocabulary holds the two characters around
it in this order, so no merge can ever cross it, whatever stands further left or right. Where an overlap has no such
border the text is tried again with wider chunks and overlaps, in the end as one chunk.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wiretide.llm.common import stored, text_batches

#: Characters of a chunk and of the overlap with the next one; longer texts are chunked.
CHUNK, OVERLAP = 32_768, 512
#: Factor by which both grow when an overlap has no stable common border.
WIDEN = 16
BATCH_BYTES = 4 << 20


@functools.lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def joined_pairs(path: str) -> frozenset[str]:
    """Every two adjacent characters inside any piece that merges can make."""
    model = processor(path)
    found = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            found.update(piece[k:k + 2] for k in range(len(piece) - 1))
    return frozenset(found)


def chunk_borders(path: str, chunk: str, start: int, zones: list[tuple[int, int]]) -> tuple[int, list[list[int]], list[list[int]]]:
    """Tokens of a chunk; for each zone of absolute positions its stable borders and the chunk's tokens before each."""
    model, pairs = processor(path), joined_pairs(path)
    spans = np.array([(p.begin, p.end) for p in model.encode(chunk, return_type="proto").pieces], np.int64).reshape(-1, 2)
    # The library counts in bytes
    first = (np.frombuffer(chunk.encode(), np.uint8) & 0xC0) != 0x80
    spans = np.concatenate([[0], np.cumsum(first)])[spans]
    begins, ends = spans[:, 0], set(spans[:, 1].tolist())
    shown = chunk.replace(" ", "▁")
    at, tokens = [], []
    for low, high in zones:
        found = [p for p in range(max(low - start, 1), min(high - start, len(chunk))) if p in ends and shown[p - 1:p + 1] not in pairs]
        at.append([p + start for p in found])
        tokens.append([int(x) for x in np.searchsorted(begins, found, side="left")])
    return len(spans), at, tokens


def _counts(path: str):
    def count(batches):
        model = processor(path)
        for batch in batches:
            for part in text_batches([batch], BATCH_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                known = dict.fromkeys(texts)
                for text, ids in zip(known, model.encode(list(known), num_threads=1)):
                    known[text] = len(ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                                                  pa.array([known[t] for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
    return count


def _chunks(size: int, overlap: int):
    def cut(frames):
        for frame in frames:
            for a, b, n, text in zip(frame["h1"], frame["h2"], frame["n_bytes"], frame["text"]):
                starts = range(0, max(1, len(text) - overlap), size - overlap)
                for index, start in enumerate(starts):
                    yield pd.DataFrame({"h1": [a], "h2": [b], "n_bytes": [n], "part": [index], "parts": [len(starts)], "start": [start],
                                        "chunk": [text[start:start + size]]})
    return cut


def _encoded(path: str, size: int, overlap: int):
    def encode(frames):
        for frame in frames:
            rows = []
            for a, b, n, part, parts, start, chunk in frame.itertuples(index=False, name=None):
                zones = [(start, start + overlap), (start + size - overlap, start + size)]
                total, at, tokens = chunk_borders(path, chunk, start, zones)
                rows.append((a, b, n, part, parts, total, at[0], tokens[0], at[1], tokens[1]))
            yield pd.DataFrame(rows, columns=["h1", "h2", "n_bytes", "part", "parts", "total", "left_at", "left_tokens", "right_at", "right_tokens"])
    return encode


_KEY = "h1 long, h2 long, n_bytes long"


def _spliced(texts: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(h1, h2, n_bytes, n_tokens) of distinct texts; n_tokens is null where two neighbours have no stable common border."""
    chunks = (texts.mapInPandas(_chunks(size, overlap), f"{_KEY}, part int, parts int, start long, chunk string")
              .repartition("h1", "part"))
    encoded = chunks.mapInPandas(_encoded(path, size, overlap), f"{_KEY}, part int, parts int, total long, left_at array<long>, "
                                 "left_tokens array<long>, right_at array<long>, right_tokens array<long>")
    order = Window.partitionBy("h1", "h2", "n_bytes").orderBy("part")
    nearest = encoded.withColumns({
        "_next": F.lead("left_at").over(order),
        "_next_tokens": F.lead("left_tokens").over(order)}).withColumn(
        # The middle one of the common borders
        "_common", F.array_intersect("right_at", "_next")).withColumn(
        "_cut", F.expr("get(_common, cast(size(_common) div 2 as int))"))
    tokens = nearest.select(
        "h1", "h2", "n_bytes",
        (F.col("part") < F.col("parts") - 1).alias("_inner"),
        "_cut", "total",
        F.expr("get(right_tokens, cast(array_position(right_at, _cut) as int) - 1)").alias("_kept"),
        F.expr("get(_next_tokens, cast(array_position(_next, _cut) as int) - 1)").alias("_skipped"))
    failed = F.max((F.col("_inner") & F.col("_cut").isNull()).cast("int"))
    return tokens.groupBy("h1", "h2", "n_bytes").agg(
        F.when(failed == 0, F.sum(F.when(F.col("_inner"), F.col("_kept") - F.col("_skipped")).otherwise(F.col("total")))).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, as the library counts the whole text.

    ``path`` is a sentencepiece model that every executor can read. A null text counts as empty, with no bytes and no
    tokens. Repeated and missing doc_ids keep their rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    small = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(_counts(path), "doc_id long, n_bytes long, n_tokens long")
    huge = (rows.filter(F.length("text") > chunk)
            .select("doc_id", F.xxhash64("text").alias("h1"), F.crc32("text").alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"), "text"))
    pending, done = huge.drop("doc_id").dropDuplicates(["h1", "h2", "n_bytes"]), None
    while True:
        counted = stored(_spliced(pending, path, chunk, overlap))
        fine = counted.filter(F.col("n_tokens").isNotNull())
        done = fine if done is None else done.unionByName(fine)
        failed = counted.filter(F.col("n_tokens").isNull())
        if failed.isEmpty():
            break
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        pending = pending.join(failed.select("h1", "h2", "n_bytes"), ["h1", "h2", "n_bytes"], "left_semi")
    large = huge.select("doc_id", "h1", "h2", "n_bytes").join(done, ["h1", "h2", "n_bytes"]).select("doc_id", "n_bytes", "n_tokens")
    return small.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)
