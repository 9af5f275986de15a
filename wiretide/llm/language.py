"""Language of pages by Bayesian evidence fusion.

Text likelihoods of a byte-trigram model meet three priors that grouped aggregation learns from all pages: how languages
are declared in markup, which address suffixes they use, and what their hosts publish. Host priors are smoothed towards
the site, site priors towards all pages, and a page's own vote is left out of its host and site.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretide.llm.common import stored, text_batches, utf8
from wiretide.llm.pages import main_text

BINS_LOG2 = 16
#: Most documents the text model is fitted on, chosen by a hash of their ids.
MAX_TRAINING_ROWS = 4000
#: A text counts as at most so many independent trigrams: neighbours overlap.
TEXT_WEIGHT = 30
#: Pseudo-counts of a host towards its site, of a site towards all pages, and of declarations and suffixes.
SMOOTHING = 2.0
BATCH_BYTES = 4 << 20

_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]+)", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)


def trigram_bins(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lower-case byte trigrams inside each text, and the row of each."""
    data = buffer.astype(np.uint32)
    data[(data >= 65) & (data <= 90)] += 32
    data[data < 65] = 32  # digits, marks and white space all part words
    if len(data) < 3:
        none = np.zeros(0, np.int64)
        return none, none
    grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = rows[2:] == rows[:-2]
    return ((grams * np.uint32(2654435761)) >> np.uint32(32 - BINS_LOG2)).astype(np.int64)[inside], rows[2:][inside]


def _trained(group: pd.DataFrame) -> pd.DataFrame:
    names = sorted(set(group["lang"]))
    codes = {name: k for k, name in enumerate(names)}
    buffer, offsets = utf8(pa.array(group["text"], pa.string()))
    bins, rows = trigram_bins(buffer, offsets)
    lang = group["lang"].map(codes).to_numpy()[rows]
    counts = np.bincount((lang << BINS_LOG2) | bins, minlength=len(names) << BINS_LOG2).reshape(len(names), -1) + 0.1
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return pd.DataFrame({"lang": names, "logs": [row.tobytes() for row in logs]})


def fit(docs: DataFrame, rows: int = MAX_TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of each trigram in each, from at most ``rows`` documents with lang and text."""
    usable = docs.filter("doc_id is not null and lang is not null and text is not null")
    chosen = stored(usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # At most ``rows`` ids: small enough to send everywhere at any size of the input
    model = stored(usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select(F.lit(1).alias("one"), "lang", "text")
                   .groupBy("one").applyInPandas(_trained, "lang string, logs binary")).orderBy("lang").collect()
    return [row["lang"] for row in model], np.array([np.frombuffer(bytes(row["logs"]), np.float32) for row in model]).reshape(len(model), 1 << BINS_LOG2)


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, site (its last two names) and suffix (its last name) of an address; numeric hosts have no suffix."""
    found = _HOST.match(url or "")
    if not found:
        return None, None, None
    host = found[1].lower().rstrip(".")
    names = host.split(".")
    return host, ".".join(names[-2:]), names[-1] if not names[-1].isdigit() and len(names) > 1 else None


def _evidence(languages: list[str], logs: np.ndarray):
    def run(batches):
        for part in text_batches(batches, BATCH_BYTES, "html"):
            pages, urls = part.column("html").to_pylist(), part.column("url").to_pylist()
            bins, rows = trigram_bins(*utf8(pa.array([main_text(p) for p in pages], pa.string())))
            count = np.bincount(rows, minlength=len(pages))
            weight = np.minimum(count, TEXT_WEIGHT) / np.maximum(count, 1)
            text = np.stack([np.bincount(rows, line[bins], minlength=len(pages)) * weight for line in logs], axis=1)
            votes = np.exp(text - text.max(axis=1, keepdims=True))
            votes /= votes.sum(axis=1, keepdims=True)
            votes[count == 0] = 0  # no text, no vote
            declared = [m[1].lower() if (m := _DECLARED.search(p or "")) else None for p in pages]
            host, site, suffix = zip(*map(address, urls))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), *(pa.array(x, pa.string()) for x in (declared, host, site, suffix)),
                 pa.array(text.tolist(), pa.list_(pa.float64())), pa.array(votes.tolist(), pa.list_(pa.float64()))],
                names=["page_id", "url", "declared", "host", "site", "suffix", "text", "votes"])
    return run


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, lang, confidence, text_lang, declared and host of every page.

    Evidence that a page lacks (no text, declaration or address) says nothing; a page with none at all gets the commonest
    language. Without any training document lang and confidence are null. Repeated page_ids are rows of their own; other
    columns are ignored.
    """
    languages, logs = fit(docs)
    if not languages:
        return pages.select("page_id", "url", *(F.lit(None).cast(kind).alias(name) for name, kind in
                            (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))))
    k = len(languages)
    rows = stored(pages.select("page_id", "url", "html").mapInArrow(
        _evidence(languages, logs), "page_id long, url string, declared string, host string, site string, suffix string, text array<double>, votes array<double>"))

    def counted(name: str) -> DataFrame:
        return (rows.filter(F.col(name).isNotNull()).groupBy(name)
                .agg(F.array(*(F.sum(F.col("votes")[i]) for i in range(k))).alias(f"{name}_votes")))
    whole = rows.agg(F.array(*(F.coalesce(F.sum(F.col("votes")[i]), F.lit(0.0)) for i in range(k)))).first()[0]
    total = sum(whole) + k
    overall = F.array(*(F.lit((v + 1) / total) for v in whole))
    per_language = F.array(*(F.lit(float(v)) for v in whole))
    joined = rows
    for name in ("declared", "suffix", "site", "host"):
        joined = joined.join(counted(name), name, "left")

    def smoothed(votes, prior):
        """(votes of the others + pseudo-counts of the prior) / their sum; the prior alone where there are no votes."""
        others = F.zip_with(votes, "votes", lambda v, own: F.greatest(v - own, F.lit(0.0)))
        mass = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
        return F.coalesce(F.transform(F.zip_with(others, prior, lambda v, p: v + SMOOTHING * p), lambda x: x / (mass + SMOOTHING)), prior)

    def told(name):
        """log P(value | language), up to what is the same for every language."""
        votes = F.col(f"{name}_votes")
        mass = F.aggregate(votes, F.lit(0.0), lambda a, b: a + b)
        share = (mass + 1) / F.lit(total)
        logs_of = F.zip_with(votes, per_language, lambda v, n: F.log((v + SMOOTHING * share) / (n + SMOOTHING)))
        return F.coalesce(logs_of, F.array(*[F.lit(0.0)] * k))
    prior = smoothed(F.col("host_votes"), F.col("site_prior"))
    fused = (joined.withColumn("site_prior", smoothed(F.col("site_votes"), overall))
             .withColumn("score", F.transform(prior, lambda p: F.log(p)))
             .withColumn("score", F.zip_with("score", "text", lambda a, b: a + b))
             .withColumn("score", F.zip_with("score", told("declared"), lambda a, b: a + b))
             .withColumn("score", F.zip_with("score", told("suffix"), lambda a, b: a + b))
             .withColumn("best", F.array_max("score")))
    names = F.array(*(F.lit(x) for x in languages))
    first = lambda values, best: F.get(names, F.array_position(values, best).cast("int") - 1)
    return fused.select(
        "page_id", "url", first(F.col("score"), F.col("best")).alias("lang"),
        (1 / F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("best")))).alias("confidence"),
        F.when(F.array_max("votes") > 0, first(F.col("votes"), F.array_max("votes"))).alias("text_lang"), "declared", "host")
