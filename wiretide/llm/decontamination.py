"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded slice of the documents a task reads. Its words are numbered by the vocabulary of the benchmark;
only runs of such words that are as long as the shortest phrase can hold an occurrence, and only these are indexed.
All phrases are searched backwards at once, their places located from sampled suffix positions, and the places merged
into spans of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from wiretide.llm import bytewords
from wiretide.llm.common import bounded_batches, stored, text_batches, utf8
from wiretide.llm.fmindex import FMIndex

WINDOW = 10
#: Text bytes of one training shard, and of the benchmark texts that go through the documents in one pass.
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 1 << 20


class Phrases:
    """The windows of one block of benchmark items, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        lower, letters = bytewords.lower_table(), bytewords.alnum_table()
        buffer, offsets = utf8(pa.array([text for _, text in items], pa.string()))
        buffer = lower[buffer]
        starts, ends, rows = bytewords.words(buffer, offsets, letters)
        hashed = bytewords.hashes(buffer, starts, ends)
        self.vocabulary, first = np.unique(hashed, return_index=True)
        self.spelled = [buffer[starts[i]:ends[i]].tobytes() for i in first]
        ids = np.searchsorted(self.vocabulary, hashed) + 1
        if any(buffer[s:e].tobytes() != self.spelled[i - 1] for s, e, i in zip(starts, ends, ids)):
            raise ValueError("two benchmark words have the same hash")
        holders: dict[tuple[int, ...], set[str]] = {}
        borders = np.searchsorted(rows, np.arange(len(items) + 1))
        for row, (name, _) in enumerate(items):
            words = ids[borders[row]:borders[row + 1]].tolist()
            for at in range(max(1, len(words) - width + 1) if words else 0):
                holders.setdefault(tuple(words[at:at + width]), set()).add(name)
        self.phrases = np.zeros((len(holders), width), np.int64)
        self.lengths = np.array([len(p) for p in holders], np.int64)
        for row, phrase in enumerate(holders):
            self.phrases[row, :len(phrase)] = phrase
        self.holders = [[name for name in names if name is not None] for names in holders.values()]

    def find(self, buffer: np.ndarray, offsets: np.ndarray):
        """Words of the texts (start, end, row), which of them are hit, and the (row, phrase) pairs that occur."""
        lowered = bytewords.lower_table()[buffer]
        starts, ends, rows = bytewords.words(lowered, offsets, bytewords.alnum_table())
        hit, none = np.zeros(len(starts), bool), np.zeros((0, 2), np.int64)
        if not len(self.lengths) or not len(starts):
            return starts, ends, rows, hit, none
        hashed = bytewords.hashes(lowered, starts, ends)
        ids = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashed
        ids += 1
        # Runs of known words inside one text
        joined = np.zeros(len(starts), bool)
        joined[1:] = known[1:] & known[:-1] & (rows[1:] == rows[:-1])
        run_starts = np.flatnonzero(known & ~joined)
        run_ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = run_ends - run_starts >= int(self.lengths.min())
        run_starts, sizes = run_starts[long], (run_ends - run_starts)[long]
        if not len(sizes):
            return starts, ends, rows, hit, none
        # Index text: the runs, a 0 after each
        total = int(sizes.sum()) + len(sizes)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        place = np.arange(total) - np.repeat(begins, sizes + 1) + np.repeat(run_starts, sizes + 1)
        stops = begins + sizes
        symbols = ids[np.minimum(place, len(ids) - 1)]
        symbols[stops] = 0
        index = FMIndex(symbols, len(self.vocabulary))
        low, high = index.search(self.phrases, self.lengths)
        found = high - low
        phrase = np.repeat(np.arange(len(found)), found)
        at = np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(len(phrase))
        word = place[index.locate(at)]
        # Equal hashes are not yet equal words: spell out each word that is hit once
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, word, 1)
        np.add.at(change, word + self.lengths[phrase], -1)
        hit = np.cumsum(change)[:-1] > 0
        wrong = [w for w in np.flatnonzero(hit) if lowered[starts[w]:ends[w]].tobytes() != self.spelled[ids[w] - 1]]
        if wrong:
            bad = np.zeros(len(starts) + 1, np.int64)
            bad[1:][wrong] = 1
            bad = np.cumsum(bad)
            fine = bad[word + self.lengths[phrase]] == bad[word]
            word, phrase = word[fine], phrase[fine]
            change[:] = 0
            np.add.at(change, word, 1)
            np.add.at(change, word + self.lengths[phrase], -1)
            hit = np.cumsum(change)[:-1] > 0
        pairs = np.unique(np.stack([rows[word], phrase], axis=1), axis=0)
        return starts, ends, rows, hit, pairs


def phrase_blocks(bench: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of bounded size. An item without id can be hit but is never named."""
    bounded_batches(bench.sparkSession)
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    if blocks == 1:
        yield Phrases([tuple(row) for row in items.collect()], width)
        return
    numbered = stored(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))) if blocks else None
    for block in range(blocks):
        yield Phrases([tuple(row) for row in numbered.filter(F.col("block") == block).select("item_id", "text").collect()], width)


def _report(phrases: Phrases | None, last: bool):
    """A pass of one block over rows (doc_id, text, spans, items): adds its hit words and items, or sums up if it is the last."""
    def scan(batches):
        for part in text_batches(batches, SHARD_BYTES):
            buffer, offsets = utf8(part.column("text"))
            held = part.column("spans").to_pylist()
            names = [set(x) for x in part.column("items").to_pylist()]
            if phrases is None:
                lowered = buffer
                starts, ends, rows = bytewords.words(lowered, offsets, bytewords.alnum_table())
                hit, pairs = np.zeros(len(starts), bool), ()
            else:
                starts, ends, rows, hit, pairs = phrases.find(buffer, offsets)
            first = np.searchsorted(rows, np.arange(part.num_rows + 1))
            for row, phrase in pairs:
                names[row].update(phrases.holders[phrase])
            for row, spans in enumerate(held):  # what earlier blocks hit, as word numbers of the text
                for a, b in zip(spans[::2], spans[1::2]):
                    hit[first[row] + a:first[row] + b] = True
            if last:
                per_row = np.concatenate([[0], np.cumsum(hit)])[first]
                n_hit = per_row[1:] - per_row[:-1]
                digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(first[1:] - first[:-1], pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array([len(x) for x in names], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0, pa.bool_())],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            else:
                spans = []
                for row in range(part.num_rows):
                    mask = np.concatenate([[False], hit[first[row]:first[row + 1]], [False]])
                    spans.append(np.flatnonzero(mask[1:] != mask[:-1]).tolist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(spans, pa.list_(pa.int64())),
                                                  pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
                                                 names=["doc_id", "text", "spans", "items"])
    return scan


def contamination(docs: DataFrame, bench: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words inside an occurrence of a benchmark window, items with one, their digest, and a flag.

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII; a window is ``width`` consecutive
    words of an item, or the whole item if it is shorter. Null texts have no words; an empty benchmark hits nothing;
    repeated items count once; documents without doc_id or with repeated ones are reported each. Other columns are ignored.
    """
    state = docs.select("doc_id", "text", F.expr("cast(array() as array<bigint>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    result = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    waiting = None
    for phrases in phrase_blocks(bench, width, block_bytes):
        if waiting is not None:
            state = state.mapInArrow(_report(waiting, False), "doc_id long, text string, spans array<long>, items array<string>")
        waiting = phrases
    return state.mapInArrow(_report(waiting, True), result)


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without the spans of words that are hit."""
    mask = np.concatenate([[False], hit, [False]])
    borders = np.flatnonzero(mask[1:] != mask[:-1])
    at, kept = 0, []
    for a, b in zip(borders[::2], borders[1::2]):
        kept.append(text[at:starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, text[at:]])


def without_spans(phrases: Phrases, texts: list[bytes]) -> list[bytes]:
    """The texts after removing every hit span, again until none is left: cutting may bring words together."""
    todo = list(range(len(texts)))
    texts = list(texts)
    while todo:
        joined = b"".join(texts[i] for i in todo)
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in todo])]).astype(np.int64)
        starts, ends, rows, hit, _ = phrases.find(np.frombuffer(joined, np.uint8), offsets)
        changed = []
        for row in np.unique(rows[hit]):
            first, after = np.searchsorted(rows, [row, row + 1])
            texts[todo[row]] = _cut(texts[todo[row]], starts[first:after] - offsets[row], ends[first:after] - offsets[row], hit[first:after])
            changed.append(todo[row])
        todo = changed
    return texts


def _replaced(part, before: list[bytes], after: list[bytes], at: int, count: int | None) -> list:
    """The columns of a batch with new texts, and their lengths where they changed."""
    new = [t if a == b else a.decode() for t, a, b in zip(part.column(at).to_pylist(), after, before)]
    columns = part.columns
    columns[at] = pa.array(new, pa.string())
    if count is not None:
        columns[count] = pa.array([n if a == b else len(t) for n, t, a, b in zip(part.column(count).to_pylist(), new, after, before)],
                                  part.schema.field(count).type)
    return columns


def _cleaner(phrases: Phrases, at: int, count: int | None):
    def clean(batches):
        for part in text_batches(batches, SHARD_BYTES):
            before = [t.encode() if t is not None else b"" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(_replaced(part, before, without_spans(phrases, before), at, count), names=part.schema.names)
    return clean


def _spanned(phrases: Phrases, last: bool, at: int, count: int | None):
    """A pass of one block over rows with ``_spans``: adds its hit words on the unchanged text; the last one cuts and tells whether it did."""
    def scan(batches):
        for part in text_batches(batches, SHARD_BYTES):
            buffer, offsets = utf8(part.column("text"))
            starts, ends, rows, hit, _ = phrases.find(buffer, offsets)
            first = np.searchsorted(rows, np.arange(part.num_rows + 1))
            for row, spans in enumerate(part.column("_spans").to_pylist()):
                for a, b in zip(spans[::2], spans[1::2]):
                    hit[first[row] + a:first[row] + b] = True
            each = [slice(first[row], first[row + 1]) for row in range(part.num_rows)]
            if last:
                before = [buffer[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                after = [_cut(text, starts[s] - offset, ends[s] - offset, hit[s]) for text, s, offset in zip(before, each, offsets)]
                columns = _replaced(part, before, after, at, count)
                flags = pa.array([bool(hit[s].any()) for s in each], pa.bool_())
            else:
                columns = part.columns
                masks = [np.concatenate([[False], hit[s], [False]]) for s in each]
                flags = pa.array([np.flatnonzero(m[1:] != m[:-1]).tolist() for m in masks], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns[:-1], flags], names=[*part.schema.names[:-1], "_cut" if last else "_spans"])
    return scan


def decontaminated(docs: DataFrame, bench: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the spans of words that occur in the benchmark; all else, n_chars apart, stays as it is.

    Nulls, repeated rows and further columns are kept. A document that consists of spans only keeps what lies between.
    Spans are cut at once for the whole benchmark, whatever its blocks, and again in what was cut until none is left.
    """
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    blocks = phrase_blocks(bench, width, block_bytes)
    phrases, more = next(blocks, None), next(blocks, None)
    if phrases is None:
        return docs
    if more is None:
        return docs.mapInArrow(_cleaner(phrases, at, count), docs.schema)
    done, todo = None, docs
    while True:
        state = todo.withColumn("_spans", F.expr("cast(array() as array<bigint>)"))
        spanned, waiting = state.schema, None
        for phrases in phrase_blocks(bench, width, block_bytes):
            if waiting is not None:
                state = state.mapInArrow(_spanned(waiting, False, at, count), spanned)
            waiting = phrases
        state = stored(state.mapInArrow(_spanned(waiting, True, at, count), StructType([*docs.schema.fields, StructField("_cut", BooleanType())])))
        rest = state.filter("not _cut").drop("_cut")
        done = rest if done is None else done.unionByName(rest)
        todo = state.filter("_cut").drop("_cut")
        if todo.isEmpty():
            return done
