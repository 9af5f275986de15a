"""Merkle manifest of a dataset, with the upper proofs exchanged between blocks in a butterfly.

Leaves are ordered in their tree and cut into aligned blocks of FANOUT ** LEVELS. A block hashes its own subtree. Then, in
round r, aligned groups of FANOUT subtrees of FANOUT ** r blocks each meet: a block exchanges its subtree root with the
blocks at the same offset of the sister subtrees, and each of them hashes the common ancestor for itself. After the last
round every block holds the root and all siblings above it, so nothing has to be handed down again. The roots of all
trees are the leaves of one more tree, which goes through the same rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.llm.common import stored
from wiretide.llm.ranks import held, in_order, numbered

FANOUT = 3
#: Levels that a block hashes by itself: blocks of 243 leaves.
LEVELS = 5
BLOCK = FANOUT ** LEVELS
PROOF = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def field(column: str | Column) -> Column:
    """A value that can't be confused with its neighbours: its UTF-8 byte count, a colon and the value; ``-`` for null."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: str | Column) -> Column:
    return digest(F.concat(*map(field, columns)))


def fold(start: Column, proof: str) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def depth(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while FANOUT ** levels < n:
        levels += 1
    return levels


def butterfly(nodes: DataFrame, rounds: int) -> DataFrame:
    """``nodes`` (tree, place, n, root; places 0 to n - 1 in each tree) with the root of their tree and the ``path`` to it.

    Where the last subtree of a group has fewer nodes than its sisters, its nodes stand in for the missing ones in turn,
    so that every offset meets every sister exactly once. A group that meets has FANOUT members at most.
    """
    state = nodes.select("tree", "n", "place", "root", F.array().cast(PROOF).alias("path"))
    for r in range(rounds):
        span = FANOUT ** r
        index = F.expr(f"place div {span}")
        state = held(state.withColumns({"_group": F.expr(f"place div {span * FANOUT}"), "_digit": (index % FANOUT).cast("int"),
                                        "_offset": F.col("place") % span,
                                        "_own": F.least(F.lit(span), F.col("n") - index * span)}),
                     "tree", "n", "place", "root", "path", "_group", "_digit", "_offset", "_own")
        offsets = F.when((F.col("n") > span) & (F.col("_digit") > 0), F.sequence("_offset", F.lit(span - 1), "_own")).otherwise(F.array("_offset"))
        sent = (state.withColumn("_meet", F.explode(offsets))
                .withColumn("_home", F.when(F.col("_meet") == F.col("_offset"), F.struct("_digit", "place", "path"))))
        met = sent.groupBy("tree", "n", "_group", "_meet").agg(F.sort_array(F.collect_list(F.struct("_digit", "root"))).alias("run"),
                                                             F.collect_list("_home").alias("homes"))
        met = met.select("tree", "n", "run", F.explode("homes").alias("home")).select("tree", "n", "run", "home.*")
        side = lambda keep: joined(F.transform(F.filter("run", keep), lambda x: x["root"]))
        alive = F.col("n") > span
        state = met.select(
            "tree", "n", "place",
            F.when(alive, digest(side(lambda x: x["_digit"] >= 0))).otherwise(F.col("run")[0]["root"]).alias("root"),
            F.when(alive, F.concat("path", F.array(F.struct(side(lambda x: x["_digit"] < F.col("_digit")).alias("left"),
                                                            side(lambda x: x["_digit"] > F.col("_digit")).alias("right"))))
                   ).otherwise(F.col("path")).alias("path"))
    return state


def _hashed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the nodes of every level, ``l0`` (the leaves) to the block's root; above a lone node nothing is added."""
    columns = blocks.columns
    for level in range(LEVELS):
        below = f"l{level}"
        runs = F.expr(f"transform(sequence(0, (size({below}) - 1) div {FANOUT}), k -> sha2(array_join(slice({below}, {FANOUT} * k + 1, {FANOUT}), ''), 256))")
        above = F.when(F.col("_size") > FANOUT ** level, runs).otherwise(F.col(below))
        blocks = held(blocks.withColumn(f"l{level + 1}", above), *columns, *(f"l{i}" for i in range(1, level + 2)))
    return blocks


def manifest(leaves: DataFrame, *extra: str) -> DataFrame:
    """The rows of ``leaves`` (tree, key, leaf and the columns of ``extra``) with ``subroot``, ``root`` and ``proof``.

    Every tree orders its leaves by key, null first, then leaf, and hashes runs of FANOUT nodes, the last one shorter, until
    one node is left; a lone leaf is its tree's root. Trees are ordered by name, null first, else bytewise. ``proof`` has a
    pair per level up to ``root``: the siblings to the left, joined, and those to the right. Rows alike in all are
    interchangeable, and each has its own place. No rows give no rows.
    """
    spark = leaves.sparkSession
    name = F.when(F.col("tree").isNull(), "-").otherwise(F.concat(F.lit("="), "tree"))  # "-" sorts before "="
    rows = in_order(leaves.select(name.alias("_tree"), "key", "leaf", *extra), "_tree", "key", "leaf")
    blocks = (numbered(rows, "_tree").withColumn("_block", F.expr(f"_place div {BLOCK}")).groupBy("_tree", "_size", "_block")
              .agg(F.sort_array(F.collect_list(F.struct("_place", "key", "leaf", *extra))).alias("rows")))
    blocks = stored(_hashed(held(blocks.withColumn("l0", F.col("rows")["leaf"]), "_tree", "_size", "_block", "rows", "l0")))
    largest = blocks.agg(F.max(F.expr(f"(_size - 1) div {BLOCK} + 1")), F.count_distinct("_tree")).first()
    nodes = blocks.select(F.col("_tree").alias("tree"), F.col("_block").alias("place"), F.expr(f"(_size - 1) div {BLOCK} + 1").alias("n"),
                          F.col(f"l{LEVELS}")[0].alias("root"))
    paths = stored(butterfly(nodes, depth(largest[0] or 0)))
    trees = numbered(in_order(paths.filter("place = 0").select("tree", "root"), "tree"))
    tops = butterfly(trees.select(F.lit(0).alias("tree"), F.col("_place").alias("place"), F.col("_size").alias("n"), "root"), depth(largest[1] or 0))
    tops = trees.select(F.col("tree").alias("_tree"), "_place").join(tops.select(F.col("place").alias("_place"), F.col("root").alias("_root"), F.col("path").alias("_top")), "_place")
    paths = paths.withColumnRenamed("tree", "_tree").join(tops, "_tree").select(
        "_tree", F.col("place").alias("_block"), F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("path", "_top").alias("_path"))
    each = blocks.join(paths, ["_tree", "_block"]).select("*", F.posexplode("rows").alias("_i", "_row"))
    steps = []
    for level in range(LEVELS):
        step = FANOUT ** level
        first, digit = f"{FANOUT} * (_i div {step * FANOUT}) + 1", f"((_i div {step}) % {FANOUT})"
        sibling = (f"struct(array_join(slice(l{level}, {first}, {digit}), '') as left, "
                   f"array_join(slice(l{level}, {first} + {digit} + 1, {FANOUT - 1} - {digit}), '') as right)")
        steps.append(F.when(F.col("_size") > step, F.array(F.expr(sibling))).otherwise(F.array().cast(PROOF)))
    tree = F.when(F.col("_tree") != "-", F.substring("_tree", 2, 1 << 30))
    return each.select(tree.alias("tree"), *(F.col(f"_row.{c}").alias(c) for c in ("key", "leaf", *extra)), "subroot", "root",
                       F.concat(*steps, "_path").alias("proof"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, digest of the proof and a check of it for every document, trees by source and leaves by doc_id.

    Where 2 divides the unsigned CRC-32 of the decimal doc_id, the check is made with a text that has lost its line breaks;
    a null doc_id or text is left as it is. Documents with a null or repeated doc_id are leaves like any other. Other
    columns are ignored, no documents give no rows.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    broken = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    leaves = stored(docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").alias("key"), leaf(*fields, "text").alias("leaf"),
                                F.when(broken, leaf(*fields, F.replace("text", F.lit("\n"), F.lit("")))).alias("forged")))
    proved = manifest(leaves, "forged")
    folded = fold(F.coalesce("forged", "leaf"), "proof")
    return (held(proved.withColumns({"proof_sha256": digest(joined(F.transform("proof", lambda p: F.concat(p["left"], p["right"])))), "folded_root": folded}),
                 F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root")
            .withColumn("verified", F.col("folded_root") == F.col("root")))
