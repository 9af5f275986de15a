import zlib

from pyspark.sql import functions as F

from wiretide.llm import sharding


def placed(df, key, shards, **options):
    return sharding.ring_shards(df, F.col(key), shards, **options).toPandas()


def walk(spark, ids, shards, virtual_nodes):
    """The ring by hand: rows in the order of node, slot, hash; each goes to the first shard clockwise with room."""
    ring = sorted((r.s, r.shard) for r in spark.range(shards * virtual_nodes).selectExpr(f"cast(id % {shards} as int) shard", f"cast(id div {shards} as int) replica")
                  .select(sharding._slot(F.lit("node"), "shard", "replica").alias("s"), "shard", "replica").collect())
    rows = spark.createDataFrame([(i,) for i in ids], "k long").select("k", F.xxhash64("k").alias("h"), sharding._slot(F.col("k")).alias("s")).collect()
    first = {}
    for at, (s, _) in enumerate(ring):
        first.setdefault(s, at)
    starts = sorted(first)

    def node(s):
        return first[next((x for x in starts if x >= s), starts[0])]
    quota = [len(ids) // shards + (i < len(ids) % shards) for i in range(shards)]
    load, out = [0] * shards, {}
    for r in sorted(rows, key=lambda r: (node(r.s), r.s, r.h)):
        at = node(r.s)
        for k in range(len(ring)):
            shard = ring[(at + k) % len(ring)][1]
            if load[shard] < quota[shard]:
                out[r.k] = (shard, load[shard])
                load[shard] += 1
                break
    return out


def test_matches_a_walk_by_hand(spark):
    ids = list(range(1000, 1403))
    got = placed(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 7, virtual_nodes=8)
    assert {r.k: (r.shard, r.slot) for r in got.itertuples()} == walk(spark, ids, 7, 8)


def test_rows_law_with_nulls_copies_and_clashing_columns(make_docs, corpus):
    got = sharding.shard_documents(make_docs(corpus), 7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(corpus) and sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in (r if len(r) > 2 else (*r, None) for r in corpus))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32)) == want
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()


def test_one_key_may_hold_a_third_of_all_rows(spark):
    got = placed(spark.createDataFrame([(7 if i % 3 == 0 else i,) for i in range(300)], "k long"), "k", 5)
    assert set(got.groupby("shard").size()) == {60}


def test_few_rows_move_when_a_shard_is_added(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    before, after = placed(df, "k", 10, slack=0.25), placed(df, "k", 11, slack=0.25)
    assert before.groupby("shard").size().max() <= 500
    both = before.merge(after, on="k")
    assert 0.03 < (both.shard_x != both.shard_y).mean() < 0.3


def test_no_rows(empty_docs):
    assert sharding.shard_documents(empty_docs).count() == 0
