"""A training corpus from raw documents: each stage works on what its predecessor kept.

Toxic documents go; of every group of near-duplicates (Jaccard similarity of
five-word shingles of 0.8 or more) the document with the smallest doc_id stays; spans of words that
occur in the benchmark are cut out of the texts; sources are mixed to their target weights, which may repeat or leave
out documents; the mix is dealt to shards of equal row counts. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.llm.common import stored, table
from wiretide.llm.decontamination import decontaminated
from wiretide.llm.minhash import one_of_each_similar
from wiretide.llm.mixing import mix
from wiretide.llm.sharding import ring_shards
from wiretide.llm.toxicity import without_toxic

SHARDS = 40


def toxicity(spark, docs, sf_dir):
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    return one_of_each_similar(docs)


def decontamination(spark, docs, sf_dir):
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    mixed = mix(docs).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("repeats"))))
    return mixed.select(*docs.columns)


def sharding(spark, docs, sf_dir):
    return ring_shards(docs, F.col("doc_id"), SHARDS, order=("doc_id", F.crc32("text")))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing),
          ("sharding", sharding)]

#: The stages train a model, hash with XXH64 and search an index, which DuckDB's SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The documents after all stages, each stage written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
