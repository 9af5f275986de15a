"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = logistic(threshold_k - score): one weight vector for all grades, thresholds in order. Labels only say
toxic or not; the toxic rows of the training sample are graded by how many features they hold that toxic rows favour, so
that 0 is none, 1 mild and 2 severe. The expected grade is the expected severity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretide.llm import bytewords
from wiretide.llm.common import stored, text_batches, utf8

BINS_LOG2 = 20
#: Besides whole words, their first so many bytes are features: insults are inflected and compounded.
PREFIXES = (4, 5, 6, 7, 8)
#: Most labelled documents the model is fitted on, chosen by a hash of their ids.
MAX_TRAINING_ROWS = 8000
#: A feature is used where the likelihood ratio of its presence in toxic and clean rows is as large, in so many rows.
MIN_RATIO, MIN_ROWS = 14.0, 4
ROUNDS, RATE, RIDGE = 200, 0.15, 3e-5
BATCH_BYTES = 2 << 20
GRADES = 3


def feature_bins(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and row of every word and word prefix."""
    lowered = bytewords.lower_table()[buffer]
    starts, ends, rows = bytewords.words(lowered, offsets, bytewords.alnum_table())
    ends_of, rows_of, starts_of = [ends], [rows], [starts]
    for size in PREFIXES:
        longer = ends - starts > size
        starts_of.append(starts[longer])
        ends_of.append(starts[longer] + size)
        rows_of.append(rows[longer])
    hashed = bytewords.hashes(lowered, np.concatenate(starts_of), np.concatenate(ends_of))
    return (hashed >> np.uint64(64 - BINS_LOG2)).astype(np.int64), np.concatenate(rows_of)


def counted(bins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of every feature of every row, in order."""
    pairs, counts = np.unique((rows << BINS_LOG2) | bins, return_counts=True)
    return pairs >> BINS_LOG2, pairs & ((1 << BINS_LOG2) - 1), counts


def _features(batches):
    for part in text_batches(batches, BATCH_BYTES):
        rows, bins, counts = counted(*feature_bins(*utf8(part.column("text"))))
        borders = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column("toxic"), pa.ListArray.from_arrays(borders, pa.array(bins, pa.int32())),
             pa.ListArray.from_arrays(borders, pa.array(counts, pa.int32()))], names=["toxic", "bins", "counts"])


def telling_features(toxic: np.ndarray, rows: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features whose presence tells toxic rows from clean ones, and whether each speaks for toxic."""
    size, n = 1 << BINS_LOG2, len(toxic)
    n_toxic = int(toxic.sum())
    in_toxic = np.bincount(bins[toxic[rows]], minlength=size)
    in_clean = np.bincount(bins[~toxic[rows]], minlength=size)
    seen = np.flatnonzero(in_toxic + in_clean >= MIN_ROWS)
    a, b = in_toxic[seen], in_clean[seen]

    def part(count, expected):
        return count * np.log(np.maximum(count, 1e-9) / np.maximum(expected, 1e-9))
    share = (a + b) / n
    ratio = 2 * (part(a, n_toxic * share) + part(n_toxic - a, n_toxic * (1 - share))
                 + part(b, (n - n_toxic) * share) + part(n - n_toxic - b, (n - n_toxic) * (1 - share)))
    told = ratio > MIN_RATIO
    return seen[told], (a * (n - n_toxic) > b * n_toxic)[told]


def severity_grades(toxic: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic; toxic rows split at their median count of features that speak for toxic."""
    held = np.bincount(rows, counts, minlength=len(toxic))
    grades = toxic.astype(np.int64)
    grades[toxic & (held > np.median(held[toxic]))] = 2
    return grades


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_ordinal(row: np.ndarray, bins: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int,
                rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that minimise the mean negative log likelihood plus a ridge, by Adam."""
    n = len(grades)
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    start = np.log(shares / (1 - shares))
    # Thresholds are the first one and the logarithms of the steps between them, and so stay in order
    params = np.concatenate([np.zeros(width), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        weights, cuts = params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1:]))])
        score = np.bincount(row, values * weights[bins], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = edges[grades + 1] - score, edges[grades] - score
        p_high, p_low = logistic(high), logistic(low)
        chance = np.maximum(p_high - p_low, 1e-12)
        d_high, d_low = p_high * (1 - p_high) / chance, p_low * (1 - p_low) / chance
        d_score = (d_high - d_low) / n
        gradient = np.empty_like(params)
        gradient[:width] = np.bincount(bins, values * d_score[row], minlength=width) + ridge * weights
        d_cut = np.array([(-d_high[grades == k].sum() + d_low[grades == k + 1].sum()) / n for k in range(GRADES - 1)])
        gradient[width] = d_cut.sum()
        gradient[width + 1:] = np.exp(params[width + 1:]) * np.cumsum(d_cut[::-1])[::-1][1:]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        params -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1:]))])


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    toxic = group["toxic"].to_numpy().astype(bool)
    sizes = group["bins"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(group)), sizes)
    bins = np.concatenate([*group["bins"], np.zeros(0, np.int64)]).astype(np.int64)
    counts = np.concatenate([*group["counts"], np.zeros(0, np.int64)]).astype(np.float64)
    told, for_toxic = telling_features(toxic, rows, bins)
    place = np.full(1 << BINS_LOG2, -1)
    place[told] = np.arange(len(told))
    used = place[bins] >= 0
    rows, bins, counts = rows[used], place[bins[used]], counts[used]
    speaks = for_toxic[bins] if len(told) else np.zeros(0, bool)
    grades = severity_grades(toxic, rows[speaks], counts[speaks])
    weights, cuts = fit_ordinal(rows, bins, np.log1p(counts), grades, len(told))
    return pd.DataFrame({"bins": [told.tolist()], "weights": [weights.tolist()], "cuts": [cuts.tolist()]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Features, their weights and the thresholds, fitted in one task on at most ``rows`` labelled documents; None without toxic or clean ones.

    A document labelled several times is toxic if any label says so; labels without doc_id or verdict are ignored.
    """
    chosen = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    chosen = stored(chosen)
    # At most ``rows`` ids: small enough to send everywhere at any size of the input
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
                    .mapInArrow(_features, "toxic int, bins array<int>, counts array<int>"))
    if sample.agg(F.count_distinct("toxic")).first()[0] < 2:
        return None
    model = stored(sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        lambda group: _fit(group), "bins array<int>, weights array<double>, cuts array<double>")).first()
    return np.array(model["bins"], np.int64), np.array(model["weights"]), np.array(model["cuts"])


def chances(model, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chance of each grade, one line per text; texts without words score 0, and without a model nothing is toxic."""
    n = len(offsets) - 1
    if model is None:
        return np.tile([1.0, 0.0, 0.0], (n, 1))
    told, weights, cuts = model
    place = np.full(1 << BINS_LOG2, -1, np.int32)
    place[told] = np.arange(len(told))
    bins, rows = feature_bins(buffer, offsets)
    bins = place[bins]
    rows, bins, counts = counted(bins[bins >= 0].astype(np.int64), rows[bins >= 0])
    score = np.bincount(rows, np.log1p(counts) * weights[bins], minlength=n) if len(told) else np.zeros(n)
    below = np.concatenate([np.zeros((n, 1)), logistic(cuts[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
    return np.diff(below, axis=1)


def _scored(model):
    def run(batches):
        for part in text_batches(batches, BATCH_BYTES):
            p = chances(model, *utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(p[:, k]) for k in range(GRADES)), pa.array(p @ np.arange(GRADES)),
                 pa.array(np.argmax(p, axis=1).astype(np.int32)), pa.array(p[:, 0] < 0.5)],
                names=["doc_id", "p_none", "p_mild", "p_severe", "expected_severity", "grade", "toxic"])
    return run


def severity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Chances of the grades, expected severity, likeliest grade and verdict of every document.

    A document is toxic where any grade above none is likelier than none. Null and empty texts have no features.
    Documents without doc_id or with repeated ones are scored each; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scored(fit(docs, labels)), "doc_id long, p_none double, p_mild double, p_severe double, expected_severity double, grade int, toxic boolean")


def _passing(model):
    def run(batches):
        for part in text_batches(batches, BATCH_BYTES):
            yield part.filter(pa.array(chances(model, *utf8(part.column("text")))[:, 0] >= 0.5))
    return run


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    return docs.mapInArrow(_passing(fit(docs, labels)), docs.schema)
