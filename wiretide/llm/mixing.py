"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size. Where a source's target is not a whole number of copies, the rest of its
budget is fitted on these counts: an even share of every size first, then bounded-knapsack dynamic programming for what
is left. Documents are picked by size count in the order of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wiretide.llm.common import stored

#: Words are runs of anything but the space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest budget of the dynamic programme; a larger rest is first filled with the longest documents that fit.
DP_LIMIT = 1 << 21
#: Documents of one source and size are ranked in buckets of about so many.
BUCKET_ROWS = 1000


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size make a total as near to ``budget`` as the programme finds; ``sizes`` ascend."""
    taken = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.copy()
    share = max(0.0, (budget - int(sizes[-1])) / total)
    taken[:] = np.diff(np.floor(np.cumsum(counts) * share).astype(np.int64), prepend=0)
    np.minimum(taken, counts, out=taken)
    rest = budget - int((taken * sizes).sum())
    for k in range(len(sizes) - 1, -1, -1):
        if rest < 0 and sizes[k] > 0:  # the even share was rounded up too often
            back = min(int(taken[k]), -(rest // int(sizes[k])))
            taken[k] -= back
            rest += back * int(sizes[k])
        if rest > DP_LIMIT and sizes[k] > 0:
            more = min(int(counts[k] - taken[k]), rest // int(sizes[k]))
            taken[k] += more
            rest -= more * int(sizes[k])
    limit = min(rest, DP_LIMIT)
    top = limit + int(sizes[sizes > 0][0])  # a little more than the budget may be nearer to it
    by = np.full(top + 1, -1, np.int64)  # the item through which a sum was first reached
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k in np.random.default_rng(int(budget)).permutation(len(sizes)):
        left, step, size = int(counts[k] - taken[k]), 1, int(sizes[k])
        if size == 0 or size > top:
            continue
        left = min(left, top // size)
        while left > 0 and not reached[limit]:
            step = min(step, left)
            weight = step * size
            if weight <= top:
                new = np.flatnonzero(reached[:-weight] & ~reached[weight:]) + weight
                by[new] = len(items)
                reached[new] = True
                items.append((int(k), step))
            left -= step
            step *= 2
        if reached[limit]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - limit))])
    while at > 0:
        k, step = items[by[at]]
        taken[k] += step
        at -= step * int(sizes[k])
    return taken


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """``_key``, ``_source_size``, ``_target`` from rows (_key, _size, _n).

    Sources take ``weights`` in turn in code-point order. All share ``share`` of the words; no target is above ``limit``
    times the words of its source, and what such sources leave is shared by the others in proportion to their weights.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("_key").agg(F.sum(F.col("_size") * F.col("_n")).cast("long").alias("_source_size"))
    ranked = (sums.orderBy("_key").rdd.zipWithIndex()
              .map(lambda pair: (pair[0][0], pair[0][1], float(weights[pair[1] % len(weights)]))))
    sources = stored(spark.createDataFrame(ranked, "_key string, _source_size long, _weight double"))
    total, all_weights = sources.agg(F.sum("_source_size"), F.sum("_weight")).first()
    budget, level = share * (total or 0), 0.0
    if total:
        level = budget / all_weights
        while True:  # each round caps at least one more source
            full = F.col("_source_size") * limit <= F.col("_weight") * level
            capped, free = sources.agg(F.sum(F.when(full, F.col("_source_size") * limit)), F.sum(F.when(~full, F.col("_weight")))).first()
            if not free:
                break
            new = (budget - (capped or 0.0)) / free
            if new <= level:
                break
            level = new
    return sources.select("_key", "_source_size",
                          F.least(F.col("_source_size") * F.lit(limit), F.col("_weight") * F.lit(level)).alias("_target"))


def _fitted(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("_size", ignore_index=True)
    words, target = int(group["_source_size"][0]), float(group["_target"][0])
    base = int(target // words) if words else 0
    picked = fit(group["_size"].to_numpy(), group["_n"].to_numpy(), round(target) - base * words) if words else np.zeros(len(group), np.int64)
    return group.assign(_base=base, _picked=picked)[["_key", "_size", "_n", "_source_size", "_target", "_base", "_picked"]]


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2, seed: int = 42) -> DataFrame:
    """The rows with ``size``, ``source_size``, ``target`` and ``repeats`` (how often the mix takes the row, 0 to ``limit``).

    ``df`` has doc_id, source, text or a ready ``size``, and any other columns; those named like a result are replaced.
    A null text has size 0; a null source is a source, the last one. Rows of one source and size are taken in the order
    of a hash of seed, doc_id and size; equal rows are interchangeable. No rows give no rows.
    """
    size = F.col("size") if "text" not in df.columns else F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    rows = (df.drop("source_size", "target", "repeats")
            .withColumns({"size": size.cast("long"), "_key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")),
                          "_order": F.xxhash64(F.lit(seed), "doc_id", size.cast("long"))}))
    sizes = stored(rows.groupBy("_key", F.col("size").alias("_size")).agg(F.count(F.lit(1)).alias("_n")))
    plan = stored(sizes.join(source_targets(sizes, weights, share, float(limit)), "_key").groupBy("_key")
                  .applyInPandas(_fitted, "_key string, _size long, _n long, _source_size long, _target double, _base int, _picked long"))
    planned = (rows.join(plan.withColumnRenamed("_size", "size"), ["_key", "size"])
               .withColumn("_bucket", F.pmod("_order", F.ceil(F.col("_n") / BUCKET_ROWS).cast("long"))))
    # Ranks across the buckets of one source and size: rows in earlier buckets, then the order inside the bucket
    large = plan.filter((F.col("_n") > BUCKET_ROWS) & (F.col("_picked") > 0) & (F.col("_picked") < F.col("_n"))).select("_key", F.col("_size").alias("size"))
    held = rows.select("_key", "size", "_order").join(plan.filter(F.col("_n") > BUCKET_ROWS).select("_key", F.col("_size").alias("size"), "_n"), ["_key", "size"])
    earlier = Window.partitionBy("_key", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (held.join(large, ["_key", "size"], "left_semi")
              .groupBy("_key", "size", F.pmod("_order", F.ceil(F.col("_n") / BUCKET_ROWS).cast("long")).alias("_bucket"))
              .agg(F.count(F.lit(1)).alias("_in"))
              .select("_key", "size", "_bucket", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_key", "size", "_bucket").orderBy("_order", "doc_id")
    partly = (F.col("_picked") > 0) & (F.col("_picked") < F.col("_n"))
    ranked = (planned.join(before, ["_key", "size", "_bucket"], "left")
              .withColumn("_rank", F.row_number().over(inside) - 1 + F.coalesce("_before", F.lit(0))))
    extra = F.when(partly, F.col("_rank") < F.col("_picked")).otherwise(F.col("_picked") > 0).cast("int")
    return (ranked.withColumns({"source_size": F.col("_source_size"), "target": F.col("_target"), "repeats": F.col("_base") + extra})
            .drop("_key", "_order", "_n", "_source_size", "_target", "_base", "_picked", "_bucket", "_before", "_rank"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Per document its size, the size and target of its source, and the words the mix takes of it."""
    facts = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    return mix(facts).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "repeats")
