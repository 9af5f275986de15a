"""Prefix trie of conversations whose subtree totals come from parallel tree contraction.

A prefix is named by 128 bits: the exclusive or of hashes of (place, role, text) over its turns, so that prefixes add up in
any grouping and no conversation has to be walked in one task. Nodes are then contracted in rounds of joins. Rake: leaves
give their totals to their parents and go. Compress: in unary chains a node that drew tails goes into a parent that drew
heads, which takes over its child. Chains shorten by a constant share a round, so rounds grow with the logarithm of the
nodes. Going back through the rounds, each node that was compressed gets the total of the parent it went into, less what
the parent itself held then.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wiretide.llm.common import stored
from wiretide.llm.ranks import in_order, numbered

#: Neighbouring conversations that share a base, and the bound of the turns they take from it.
FAMILY, HEADS = 5, 9
#: Turns of one conversation that one window adds up.
CHUNK = 4096
#: Conversation ids that are joined to one piece of text.
PIECE = 4096


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, p from 0, length, k1, k2, bytes) and all conversations (conv_id, length).

    Turns are ordered by turn, null first, then role, then SHA-256 of the text; a null role or text is empty. Conversation
    c takes the first h turns of conversation c - c % 5 (the remainder has the sign of c), then its own from the h-th on.
    Rows without conv_id belong to no conversation.
    """
    text = F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(text, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    turns = stored(numbered(in_order(turns, "conv_id", "turn", "role", "digest"), "conv_id"))
    convs = turns.groupBy("conv_id").agg(F.max("_size").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
                         (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long").alias("h"))
    bases = convs.filter("conv_id = base").select("base", F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = stored(convs.join(bases, "base", "left").select("conv_id", "base", "h", taken.cast("long").alias("taken"),
                                                            (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")))
    first = (turns.filter(f"conv_id % {FAMILY} = 0 and _place < {HEADS - 1}").withColumnRenamed("conv_id", "base").join(convs, "base")
             .filter("_place < taken").select("conv_id", F.col("_place").alias("p"), "length", "role", "digest", "bytes"))
    own = (turns.join(convs, "conv_id").filter("_place >= h")
           .select("conv_id", (F.col("_place") - F.col("h") + F.col("taken")).alias("p"), "length", "role", "digest", "bytes"))
    keys = {f"k{i}": F.xxhash64(F.lit(i), "p", "role", "digest") for i in (1, 2)}
    return stored(first.unionByName(own).withColumns(keys).drop("role", "digest")), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the names (a1, a2) of the prefix that ends there and (b1, b2) of the one before."""
    turns = turns.withColumn("chunk", F.expr(f"p div {CHUNK}"))
    along = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several chunks have anything before one
    before = (turns.filter(f"length > {CHUNK}").groupBy("conv_id", "chunk").agg(F.bit_xor("k1").alias("t1"), F.bit_xor("k2").alias("t2"))
              .select("conv_id", "chunk", F.bit_xor("t1").over(along).alias("c1"), F.bit_xor("t2").over(along).alias("c2")))
    within = Window.partitionBy("conv_id", "chunk").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = turns.select("*", F.bit_xor("k1").over(within).alias("w1"), F.bit_xor("k2").over(within).alias("w2")).join(before, ["conv_id", "chunk"], "left")
    whole = {f"a{i}": F.col(f"w{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)}
    return summed.withColumns(whole).select("conv_id", "p", "length", "bytes", "a1", "a2", *(F.col(f"a{i}").bitwiseXOR(F.col(f"k{i}")).alias(f"b{i}") for i in (1, 2)))


def _pieces(frames):
    for frame in frames:
        a1, a2, ids = frame["a1"].to_numpy(), frame["a2"].to_numpy(), frame["conv_id"].astype(str).tolist()
        fresh = np.flatnonzero((a1[1:] != a1[:-1]) | (a2[1:] != a2[:-1])) + 1
        starts = [at for run, end in zip([0, *fresh], [*fresh, len(ids)]) for at in range(run, end, PIECE)]
        texts = [",".join(ids[at:end]) for at, end in zip(starts, [*starts[1:], len(ids)])]
        yield pd.DataFrame({"a1": a1[starts], "a2": a2[starts], "first": frame["conv_id"].to_numpy()[starts], "ids": texts})


def _digests(frames):
    key, running = None, None
    for frame in frames:
        done = []
        for a1, a2, ids in zip(frame["a1"], frame["a2"], frame["ids"]):
            if (a1, a2) != key:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (a1, a2), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["a1", "a2", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, running.hexdigest())], columns=["a1", "a2", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 per node (a1, a2) of its conversation ids in order, joined by commas. A digest is made piece by piece, so
    that the ids of a node that very many conversations end in are never held together."""
    sort = ("a1", "a2", "conv_id")
    pieces = (ends.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort)
              .mapInPandas(_pieces, "a1 long, a2 long, first long, ids string"))
    return (pieces.repartition("a1", "a2").sortWithinPartitions("a1", "a2", "first")
            .mapInPandas(_digests, "a1 long, a2 long, ends_sha256 string"))


def subtree_totals(nodes: DataFrame, *sums: str) -> DataFrame:
    """``nodes`` (id, parent, null at the roots, and long columns ``sums``) with each sum taken over the subtree of a node.

    The trees need not be balanced: a node may have any number of children and a chain any length.
    """
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"), F.bit_xor("id").alias("child"))
    none = F.lit(0).cast("long")
    # Of an only child, the exclusive or of the children's ids is the id
    state = stored(nodes.select("id", "parent", *sums).join(kids, "id", "left").withColumns({"kids": F.coalesce("kids", none), "child": F.coalesce("child", none)}))
    rounds = []
    while not state.filter("parent is not null").isEmpty():
        leaves = state.filter("kids = 0 and parent is not null")
        given = leaves.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("_lost"), F.bit_xor("id").alias("_gone"),
                                                                *(F.sum(s).alias(f"_{s}") for s in sums))
        raked = stored(state.filter("kids > 0 or parent is null").join(given, "id", "left")
                       .select("id", "parent", *((F.col(s) + F.coalesce(f"_{s}", none)).alias(s) for s in sums),
                               (F.col("kids") - F.coalesce("_lost", none)).alias("kids"),
                               F.col("child").bitwiseXOR(F.coalesce("_gone", none)).alias("child")))
        heads = F.xxhash64("id", F.lit(len(rounds))).bitwiseAND(F.lit(1)) == 1
        chain = raked.filter("kids = 1")
        above = chain.filter(heads).select(F.col("child").alias("id"), F.col("id").alias("into"), *(F.col(s).alias(f"base_{s}") for s in sums))
        merged = stored(chain.filter(~heads & F.col("parent").isNotNull()).join(above, "id").drop("parent", "kids"))
        rounds.append((leaves.select("id", *sums), merged))
        news = (merged.select(F.col("into").alias("id"), F.col("child").alias("_child"), F.lit(None).cast("long").alias("_parent"), F.lit(False).alias("_out"),
                              *(F.col(s).alias(f"_{s}") for s in sums))
                .unionByName(merged.select(F.col("child").alias("id"), F.col("into").alias("_parent")), allowMissingColumns=True)
                .unionByName(merged.select("id", F.lit(True).alias("_out")), allowMissingColumns=True)
                .groupBy("id").agg(*(F.max(c).alias(c) for c in ("_child", "_parent", "_out")), *(F.max(f"_{s}").alias(f"_{s}") for s in sums)))
        state = stored(raked.join(news, "id", "left").filter(~F.coalesce("_out", F.lit(False)))
                       .select("id", F.when(F.col("parent").isNotNull(), F.coalesce("_parent", "parent")).alias("parent"),
                               *((F.col(s) + F.coalesce(f"_{s}", none)).alias(s) for s in sums), "kids",
                               F.coalesce("_child", "child").alias("child")))
    totals = state.select("id", *sums)
    for leaves, merged in reversed(rounds):
        back = merged.select("id", "into", *(f"base_{s}" for s in sums)).join(totals.select(F.col("id").alias("into"), *sums), "into")
        back = back.select("id", *((F.col(s) - F.col(f"base_{s}")).alias(s) for s in sums))
        totals = stored(totals.unionByName(leaves).unionByName(back))
    return nodes.drop(*sums).join(totals, "id")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations, from the empty one (depth 0): conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (over its subtree) and ends_sha256.

    Conversations without turns are members of the root only. Repeated rows are turns of their own. Other columns are
    ignored. No conversations give no rows.
    """
    turns, convs = rebuilt(conversations)
    steps = stored(prefixes(turns))
    zero = F.lit(0).cast("long")
    nodes = steps.groupBy("a1", "a2").agg(F.min("conv_id").alias("conv_id"), F.max(F.col("p") + 1).alias("depth"), F.count(F.lit(1)).alias("n_convs"),
                                          F.max("bytes").alias("bytes"), F.max("b1").alias("b1"), F.max("b2").alias("b2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("a1"), zero.alias("a2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"),
        F.lit(None).cast("long").alias("b1"), F.lit(None).cast("long").alias("b2"))
    nodes = stored(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    parents = nodes.select(F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(parents, ["b1", "b2"], "left").select("id", "parent", "a1", "a2", "conv_id", "depth", "parent_conv_id", "n_convs", "bytes")
    children = linked.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = stored(linked.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    totals = subtree_totals(linked.select("id", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                                          ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "n_leaves", "saved_tokens").drop("parent")
    ends = ends_digests(steps.filter("p + 1 = length").select("a1", "a2", "conv_id")
                        .unionByName(convs.filter("length = 0").select(zero.alias("a1"), zero.alias("a2"), "conv_id")))
    return (linked.join(totals, "id").join(ends, ["a1", "a2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
