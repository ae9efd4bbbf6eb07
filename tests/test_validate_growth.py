from pyspark.sql import functions as F

from glossaria.operators import validate


def test_names_in_many_rows_meet_only_the_terms_that_occur(spark, monkeypatch):
    written, plain = [], validate.cut
    monkeypatch.setattr(validate, "cut", lambda df: (written.append(df) if "_known" in df.columns else None, plain(df))[1])
    terms = spark.range(500).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"), F.lit(True).alias("is_descriptor"))
    rules = validate.descriptor_rules(spark.sql("""SELECT 't1' AS descriptor, parse_json('{"_scalar": {"_type": "_type_number"}}') AS definition"""))
    rows = spark.range(60).select(F.col("id").alias("row_id"), F.parse_json(F.lit('{"t1": 1, "t2": 2, "x": 3}')).alias("object"))
    got = validate.validate_objects(None, rules, rows, descriptors=terms, levels=1, expect_terms=True).select("row_id", "code").collect()
    assert len(got) == 60 and {r["code"] for r in got} == {29}
    assert [df.count() for df in written] == [2]


def test_rules_are_written_once_a_level(spark, monkeypatch):
    tables, plain = [], validate.cut
    monkeypatch.setattr(validate, "cut", lambda df: (lambda out: (tables.append(out), out)[1])(plain(df)))
    deep = '{"_dict": {"_dict_key": {"_type_key": "_type_string"}, "_dict_value": {"_array": {"_set": {"_set_scalar": {"_set_type": "_type_number"}}}}}}'
    rules = validate.descriptor_rules(spark.sql(f"SELECT 'd' AS descriptor, parse_json('{deep}') AS definition"))
    got = {(r["path"], r["container"], r["type"]) for r in rules.collect()}
    assert got == {("", "_dict", None), ("/k", "_dict_key", "_type_string"), ("/v", "_array", None), ("/v/e", "_set", None), ("/v/e/e", "_set_scalar", "_type_number")}
    assert sum(t.count() for t in tables) == len(got)


def test_records_of_one_small_file_are_dealt_over_tasks(spark, monkeypatch):
    spread, plain = [], validate.cut

    def counted(df):
        if {"shape", "json"} <= set(df.columns):
            spread.append(df.select(F.spark_partition_id().alias("p")).distinct().count())
        return plain(df)

    monkeypatch.setattr(validate, "cut", counted)
    rules = validate.descriptor_rules(spark.sql("""SELECT 'd' AS descriptor, parse_json('{"_array": {"_scalar": {"_type": "_type_number"}}}') AS definition"""))
    names = spark.sql("SELECT 'd' AS term, true AS is_descriptor")
    rows = spark.range(400).coalesce(1).select(F.col("id").alias("row_id"), F.lit("d").alias("descriptor"), F.parse_json(F.lit('[1, "x"]')).alias("value"))
    got = validate.validate(None, rules, rows, descriptors=names, structures=spark.sql("SELECT 's' AS structure, null AS definition").limit(0)).select("row_id", "code").collect()
    assert len(got) == 400 and {r["code"] for r in got} == {10}
    assert spread and min(spread) > 1


def test_texts_in_many_rows_and_missing_ones_do_not_gather(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        known = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2), ('', 3) AS t(_ref, n)")
        rows = spark.range(1000).withColumnRenamed("id", "row_id")
        out = validate._met(rows, known, "_ref", F.when(F.col("row_id") == 7, "a").when(F.col("row_id") == 8, ""))
        got = out.select("row_id", "n", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(got) == 1000 and {(r["row_id"], r["n"]) for r in got if r["n"]} == {(7, 1), (8, 3)}
    share = max(sum(r["p"] == p for r in got) for p in {r["p"] for r in got})
    assert share < 500
