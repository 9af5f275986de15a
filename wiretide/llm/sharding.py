"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of slots. Every shard owns virtual nodes on it; a row goes to the next node clockwise from
its own slot. Each shard has a quota; where it is reached, rows continue clockwise to the next other shard. Rows that
meet the same node see the same order of shards, so that the walk is decided on counts per node, a table whose size
depends on the ring alone, and every row then finds its shard from its rank at its node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Slots of the ring, a power of two.
SLOTS = 1 << 16


def _slot(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - (SLOTS - 1).bit_length()).cast("int")


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """The same columns, from a generator: what a projection computes is computed anew at each use, its rows are not."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def nodes(spark, shards: int, virtual_nodes: int) -> DataFrame:
    """One row with the virtual nodes in ring order: their slots, and for each the order in which its rows meet the shards."""
    placed = (spark.range(shards * virtual_nodes)
              .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("replica"))
              .select(_slot(F.lit("node"), "shard", "replica").alias("slot"), "shard", "replica"))
    ring = placed.agg(F.sort_array(F.collect_list(F.struct("slot", "shard", "replica"))).alias("ring"))
    last = shards * virtual_nodes - 1
    return _once(_once(ring, "ring").select(F.expr("transform(ring, n -> n.slot)").alias("node_slots"), F.expr(
        "transform(ring, (n, i) -> array_distinct(concat("
        f"transform(slice(ring, i + 1, {last + 1}), x -> x.shard), transform(slice(ring, 1, i), x -> x.shard))))").alias("orders")), "node_slots", "orders")


# Walks the nodes in ring order; each gives its rows to the shards of its order until their quotas are reached.
# The state is copied at every step, so the inner walk carries the parts of its own node only.
_WALK = """
aggregate(
  sequence(0, size(counts) - 1),
  named_struct('loads', transform(quotas, q -> cast(0 as bigint)),
               'parts', cast(array() as array<struct<node:int,shard:int,first:bigint,n:bigint,slot:bigint>>)),
  (state, i) -> aggregate(
    orders[i],
    named_struct('loads', state.loads, 'parts', cast(array() as array<struct<node:int,shard:int,first:bigint,n:bigint,slot:bigint>>),
                 'given', cast(0 as bigint)),
    (s, shard) -> if(s.given >= counts[i] or s.loads[shard] >= quotas[shard], s, named_struct(
      'loads', transform(s.loads, (l, k) -> l + if(k = shard, least(counts[i] - s.given, quotas[shard] - s.loads[shard]), cast(0 as bigint))),
      'parts', concat(s.parts, array(named_struct('node', i, 'shard', shard, 'first', s.given,
                      'n', least(counts[i] - s.given, quotas[shard] - s.loads[shard]), 'slot', s.loads[shard]))),
      'given', s.given + least(counts[i] - s.given, quotas[shard] - s.loads[shard]))),
    s -> named_struct('loads', s.loads, 'parts', concat(state.parts, s.parts))),
  state -> state.parts)
"""


def ring_shards(df: DataFrame, key: Column, shards: int, virtual_nodes: int = 32, slack: float = 0.0, order: tuple = ()) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard) to every row.

    ``slack`` 0 gives quotas at most one apart, so that the row counts of the shards are; above 0 every shard may hold
    (1 + slack) times the mean, and fewer rows move when shards are added. Rows rank at their node by key hash and the
    columns of ``order``. A null key is a key like any other; equal keys share a slot, equal rows are interchangeable.
    No rows give no rows. Columns named shard or slot are replaced.
    """
    spark = df.sparkSession
    rows = df.drop("shard", "slot").withColumns({"_hash": F.xxhash64(key), "_ring": _slot(key)})
    counted = rows.groupBy("_ring").agg(F.count(F.lit(1)).alias("_n"))
    ring = nodes(spark, shards, virtual_nodes)
    # The slot table: the node that serves each slot, and how many of the node's rows lie in earlier slots
    serving = (ring.select(F.posexplode("node_slots").alias("_at", "_end"))
               .groupBy("_end").agg(F.min("_at").alias("_at")))
    ahead = Window.orderBy(F.desc("_ring")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = (spark.range(SLOTS).select(F.col("id").cast("int").alias("_ring"))
             .join(serving, F.col("_ring") == F.col("_end"), "left")
             .select("_ring", F.coalesce(F.min("_at").over(ahead), F.lit(0)).alias("_node"))
             .join(counted, "_ring"))
    within = Window.partitionBy("_node").orderBy("_ring").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("_ring", "_node", "_n", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_before"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    per_node = slots.groupBy("_node").agg(F.sum("_n").alias("_n"))
    counts = _once(per_node.agg(F.map_from_entries(F.collect_list(F.struct("_node", "_n"))).alias("by_node"))
                   .withColumn("one", F.lit(1)).join(ring.withColumn("one", F.lit(1)), "one")  # one row each
                   .select("orders", F.expr("transform(orders, (o, i) -> coalesce(by_node[i], cast(0 as bigint)))").alias("counts")),
                   "orders", "counts")
    counts = _once(counts.withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)), "orders", "counts", "total")
    quota = (f"cast(ceil(total * {1 + slack} / {shards}) as bigint)" if slack > 0
             else f"total div {shards} + if(i < total % {shards}, 1, 0)")
    walk = (_once(counts.withColumn("quotas", F.expr(f"transform(sequence(0, {shards - 1}), i -> {quota})")), "orders", "counts", "quotas")
            .select(F.explode(F.expr(_WALK)).alias("_part")))
    parts = walk.groupBy(F.col("_part.node").alias("_node")).agg(F.collect_list("_part").alias("_parts"))
    slots = slots.join(parts, "_node").select("_ring", "_before", "_parts")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_ring").orderBy("_hash", *order)) - 1)
    placed = (ranked.join(slots, "_ring")
              .withColumn("_rank", F.col("_rank") + F.col("_before"))
              .withColumn("_part", F.expr("filter(_parts, p -> _rank >= p.first and _rank < p.first + p.n)[0]")))
    return (placed.withColumns({"shard": F.col("_part.shard"), "slot": F.col("_part.slot") + F.col("_rank") - F.col("_part.first")})
            .drop("_ring", "_hash", "_rank", "_before", "_parts", "_part"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard and slot of every document under the law ``rows``: the row counts of the shards are at most one apart.

    Size is the UTF-8 bytes of the text, none for null, plus 16; the CRC-32 of a null text is that of no bytes.
    Documents without doc_id or with repeated ones are placed too. Other columns are ignored.
    """
    facts = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    placed = ring_shards(facts, F.col("doc_id"), shards, order=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
