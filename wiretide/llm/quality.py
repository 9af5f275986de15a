"""Quality by hashed n-gram log-likelihood ratio between trusted and all documents, in DataFrame operations only.

Tokens (runs of letters and digits, runs of other signs) and pairs of neighbouring tokens are hashed to buckets. Two
multinomials are counted over the buckets: one over every document that a label trusts, one over every document. The score
of a text is the mean over its n-grams of the logarithm of the ratio of both, and is compared with a fixed threshold, so
that a decision depends on the text and the counts alone. The model is one row of as many whole numbers as buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import stored
from wiretide.llm.ranks import held

BUCKETS = 1 << 14
#: Log ratios are kept in millionths, whose sums do not depend on the order.
SCALE = 1_000_000
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.3
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
_GAP, _TOKEN = r"[\x20\x09-\x0D]+", r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"


def buckets(tokens: str) -> Column:
    """The bucket of every token and of every pair of neighbours."""
    bucket = lambda *key: F.xxhash64(*key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    pairs = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.concat(F.transform(tokens, lambda t: bucket(t)), F.transform(pairs, lambda t, i: bucket(t, F.col(tokens)[i + 1])))


def _with_buckets(docs: DataFrame, *columns: str) -> DataFrame:
    tokens = docs.withColumn("_tokens", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_TOKEN), F.lit(0)))
    return held(held(tokens, *columns, "_tokens").withColumn("_buckets", buckets("_tokens")), *columns, "_buckets")


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``ratios``, the log ratio of each bucket in millionths.

    Trusted is a document whose doc_id has the label quality 1 and no other. Both multinomials are smoothed by one count a
    bucket. Without trusted documents all ratios are 0.
    """
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).filter("_quality = 1").select("doc_id", F.lit(1).alias("_trusted"))
    # Labels have no proven size bound, so they are not broadcast at any size
    grams = _with_buckets(docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left"), "_trusted").select("_trusted", F.explode("_buckets").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("_trusted").alias("t"))
    # As many entries as buckets at most
    model = held(counts.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("n", "t")))).alias("by_bucket"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"),
                            F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")), "by_bucket", "all_n", "all_t")
    each = (model.select("all_n", "all_t", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket")).join(counts, "bucket", "left"))
    ratio = (F.log((F.coalesce("t", F.lit(0)) + 1) / (F.col("all_t") + BUCKETS)) - F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("all_n") + BUCKETS)))
    ratio = F.when(F.col("all_t") > 0, F.round(ratio * SCALE)).otherwise(0).cast("int")
    return each.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", ratio.alias("ratio")))), lambda x: x["ratio"]).alias("ratios"))


def _neighbours(name: str, alike) -> Column:
    """The entries of a sorted array that are like the one before or after."""
    last, none = F.size(name) - 1, F.lit(False)
    return F.filter(name, lambda x, k: F.when(k > 0, alike(F.col(name)[k - 1], x)).otherwise(none)
                    | F.when(k < last, alike(F.col(name)[k + 1], x)).otherwise(none))


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text has no words."""
    columns = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = held(docs.select(*columns, F.filter(F.split(text, _GAP), lambda w: w != "").alias("_words"), lines.alias("_lines")), *columns, "_words", "_lines")
    window = lambda w, i: F.xxhash64(w, F.col("_words")[i + 1], F.col("_words")[i + 2])
    # A window as one number: the upper bits of its hash, then its place in as many bits as the text needs. Sorted, windows
    # that may be equal are neighbours; those few are sorted once more by the whole hash
    starts = F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0)))
    mask = F.expr("shiftleft(cast(1 as bigint), length(bin(size(_words)))) - 1")
    rows = held(rows.withColumns({"_n": F.size("_words"), "_dup": F.size("_lines") - F.size(F.array_distinct("_lines")), "_mask": mask, "_starts": starts}),
                *columns, "_words", "_n", "_dup", "_mask", "_starts")
    packed = F.transform("_starts", lambda w, i: window(w, i).bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long")))
    rows = held(rows.withColumn("_packed", F.sort_array(packed)), *columns, "_words", "_n", "_dup", "_mask", "_packed")
    places = F.transform(_neighbours("_packed", lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.bitwise_not("_mask")) == 0),
                         lambda x: x.bitwiseAND(F.col("_mask")).cast("int"))
    rows = held(rows.withColumn("_places", places), *columns, "_words", "_n", "_dup", "_places")
    exact = F.sort_array(F.transform("_places", lambda i: F.struct(window(F.col("_words")[i], i).alias("h"), i.alias("i"))))
    rows = held(rows.withColumns({"_exact": exact, "_chars": F.length(F.array_join("_words", ""))}), *columns, "_n", "_chars", "_dup", "_exact")
    twice = _neighbours("_exact", lambda a, b: a["h"] == b["h"])
    repeated = F.aggregate(F.sort_array(F.transform(twice, lambda w: w["i"])), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                           lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])
    rows = held(rows.withColumn("_repeated", repeated), *columns, "_n", "_chars", "_dup", "_repeated")
    return (rows.select(*columns, F.col("_n").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"),
                        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.col("_dup").cast("long").alias("n_dup_lines"),
                        F.col("_repeated").cast("long").alias("n_repeat_words"))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))))


def scored(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """``docs`` with ``llr``, the mean log ratio of the n-grams of each text; 0 for a text without any."""
    columns = [c for c in docs.columns if c != "llr"]
    rows = _with_buckets(docs, *columns).withColumn("_ratios", ratios.scalar())
    total = F.aggregate("_buckets", F.lit(0).cast("long"), lambda total, b: total + F.col("_ratios")[b])
    mean = F.when(F.size("_buckets") > 0, total / F.size("_buckets") / SCALE).otherwise(F.lit(0.0))
    return held(held(rows, *columns, "_buckets", "_ratios").withColumn("llr", mean), *columns, "llr")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base measures, ``llr`` and the verdict ``kept`` of every document.

    Kept is a document that passes the base rules and whose llr is at least ``threshold``. Null and empty texts fail the
    base rules. Documents with a null or repeated doc_id are judged like any other; a null one is never trusted. Other
    columns are ignored, no documents give no rows.
    """
    model = stored(log_ratios(docs, labels))
    rows = base_rules(scored(docs.select("doc_id", "text"), model))
    return (rows.drop("text").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"))
