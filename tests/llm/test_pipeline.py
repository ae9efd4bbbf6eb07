import corpus_pipeline
import pandas as pd
from pyspark.sql import functions as F


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(before.columns)
        kept = docs.toPandas()
        assert set(kept["doc_id"]) <= set(before["doc_id"]), name
        docs = spark.createDataFrame(kept, docs.schema)
        before = kept
    packed = corpus_pipeline.packing(spark, docs, sf_dir).toPandas()
    assert set(packed["doc_id"]) == set(before["doc_id"])


def test_empty_and_nulls(spark):
    sf_dir = "/root/testdata/sf0.001"
    good = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0)], good.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, good.limit(0), sf_dir).count() == 0
        assert isinstance(stage(spark, odd, sf_dir).toPandas(), pd.DataFrame)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_repeated_ids_lose_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (3, a + " x"), (None, b + " y"), (None, "z " * 9), (5, "")]
    odd = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], docs.schema).withColumn("_row", F.lit("r"))
    kept = corpus_pipeline.near_duplicate(spark, odd, "")
    texts = sorted(r["text"][:1] for r in kept.collect())
    assert texts == ["", "a", "b", "z"] and kept.columns == odd.columns


def test_extra_columns_pass_through(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    odd = {c: -5 for c in ("n_words", "kept", "margin", "rejected", "_row", "lang_pred")} | {"score": "own"}
    for c, v in odd.items():
        docs = docs.withColumn(c, F.lit(v))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {tuple(r) for r in out.select(*odd).distinct().collect()} <= {tuple(odd.values())}, name
