import corpus_pipeline
import __spark_entry__ as entry
from reviewlode.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_feed_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        if i < 4:
            assert docs.columns == columns
        if name in ("quality_rules", "quality_classifier"):
            lost = [d for d in ids - left if labels.get(d) == 1]
            assert len(lost) <= 0.04 * sum(q == 1 for q in labels.values())
        if name == "ngram_jaccard_join":
            assert docs.count() == len(left) < len(ids)
        ids = left
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()


def test_all_eleven_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.SQL) <= set(entry.oracle_sql())
