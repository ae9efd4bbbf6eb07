from pyspark.sql import functions as F

from glossaria.operators import search


def test_clauses_that_forms_share_are_answered_once(spark, monkeypatch):
    tables, plain = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: (lambda out: (tables.append(out), out)[1])(plain(df)))
    posted = spark.createDataFrame([("a", "_title", "x"), ("b", "_title", "x"), ("a", "_title", "y")], "token string, field string, key string")
    forms = spark.range(50).select(F.concat(F.lit("f"), F.col("id")).alias("form_id"), F.lit("_title").alias("field"), F.lit("all").alias("mode"), F.array(F.lit("a b")).alias("words"))
    more = [("two", "_title", "any", ["a"]), ("two", "_title", "all", ["a b"]), ("twice", "_title", "any", ["a"]), ("twice", "_title", "any", ["a"]), ("no", "_title", "any", ["a"]), ("no", "_title", "any", None)]
    forms = forms.unionByName(spark.createDataFrame(more, "form_id string, field string, mode string, words array<string>"))
    got = sorted(tuple(r) for r in search.search_tokens(posted, forms).collect())
    assert got == sorted([(f"f{k}", "x") for k in range(50)] + [("two", "x"), ("twice", "x"), ("twice", "y")])
    assert [t.count() for t in tables if "words" in t.columns] == [3]
