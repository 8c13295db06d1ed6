"""The corpus pipeline against the stages' contracts on a small corpus."""

import corpus_pipeline as C
from cyclewise.llm import queries as Q


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, docs, sf).persist()
        assert after.columns == columns, name
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after
    out = C.STAGES[-1][1](spark, docs, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(texts) > 100
    assert all(r.decoded == texts[r.doc_id].replace("▁", " ") and r.n_tokens == len(r.ids) for r in out)


def test_stage_edges(spark):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "the king and the house of it", None, "s", 5), (1, "the king and the house of it", None, "s", 5), (2, "der hund und das haus ist nicht", "de", None, None), (3, "the king and the house of that", "en", "s", 1)], schema)
    docs = odd
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 3]
    none = odd.limit(0)
    for _, stage in C.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as E

    assert set(Q.QUERIES) | {"pipeline"} <= set(E.queries())
    assert {int(k[2:].split("_")[0]) for k in Q.QUERIES} == set(range(1, 1 + len(Q.QUERIES)))
