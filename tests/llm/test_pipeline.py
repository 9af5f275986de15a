import corpus_pipeline
from wiretide.llm import decontamination, queries
from wiretide.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def one_of_each(docs):
    """The smallest doc_id of every group that five-word shingles with a Jaccard similarity of 0.8 or more link, by all pairs."""
    sets = {}
    for doc, text in sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        words = [w for w in text.lower().split()]
        sets[doc] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    smallest = {doc: doc for doc in sets}
    for _ in sets:
        before = dict(smallest)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    smallest[a] = smallest[b] = min(smallest[a], smallest[b])
        if before == smallest:
            return {doc for doc in sets if smallest[doc] == doc}


def test_every_stage_does_its_part(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        seen[name] = before, docs
        if name != "sharding":
            assert docs.columns == columns
    before, after = (df.toPandas() for df in seen["toxicity"])
    assert set(after.doc_id) < set(before.doc_id) and after.merge(before).shape[0] == len(after)
    before, after = seen["near_duplicates"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == one_of_each(before)
    before, after = seen["decontamination"]
    bench = table(spark, SF, "benchmark")
    assert before.count() == after.count() and not decontamination.contamination(after, bench).filter("contaminated").count()
    before, after = (df.toPandas() for df in seen["mixing"])
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() == 2
    before, after = (df.toPandas() for df in seen["sharding"])
    sizes = after.groupby("shard").size()
    assert len(before) == len(after) and sizes.max() - sizes.min() <= 1
    assert sorted(before.doc_id) == sorted(after.doc_id)


def test_the_queries_and_the_pipeline_are_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and set(queries.QUERIES) <= names and {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
