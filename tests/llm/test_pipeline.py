import corpus_pipeline
from paperloom.llm.jaccard_join import jaccard_components
from paperloom.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= before
    groups = jaccard_components(docs).filter("component_id <> doc_id").count()
    assert groups == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_registry():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "packing"]


def test_odd_documents_pass_all_stages(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, extra columns with clashing names, and an empty table."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "x", 0), (900003, " \n \n ", None, "x", 5), (900003, " \n \n ", None, "x", 5), (None, "some words of text here", "en", "x", 23)], plain.schema)
    docs = plain.unionByName(odd).selectExpr("*", "doc_id AS rep", "'q' AS label", "1 AS a", "'z' AS spans")
    for rows in (docs, docs.limit(0)):
        own, columns = rows, rows.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, SF)
            assert own.columns == columns
            at = str(tmp_path / f"{name}{rows is docs}")
            own.write.parquet(at)
            own = spark.read.parquet(at)
        kept = own.count()
        assert kept >= (5 if rows is docs else 0) and own.filter("doc_id IS NULL").count() == (rows is docs)
        packed = corpus_pipeline.STAGES[-1][1](spark, own, SF).collect()
        assert sum(r.piece == 0 for r in packed) == kept


def test_run_keeps_each_stage_once(spark, monkeypatch):
    written = []
    durable = corpus_pipeline.durable
    monkeypatch.setattr(corpus_pipeline, "durable", lambda df: written.append(1) or durable(df))
    assert corpus_pipeline.run(spark, SF).count() > 0 and len(written) == len(corpus_pipeline.STAGES) - 1
