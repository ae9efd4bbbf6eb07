import json

import pytest
from pyspark.sql import functions as F

from glossaria.operators import updates


@pytest.mark.parametrize(
    ("doc", "new", "paths", "strict", "expected"),
    [
        ({"a": {"b": 1}}, {"a": {"b": 2}}, ["a.b"], False, {"a": {"b": 2}}),
        ({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}, ["a.b"], False, {"a": {"c": 2}}),
        ({"a": [1, 2, 3]}, {"a": [None, 9]}, ["a[0]"], False, {"a": [2, 3]}),
        ({"a": [1]}, {"a": [0, 0, 5]}, ["a[2]"], False, {"a": [1, None, 5]}),
        ({"a": [1]}, {"a": [0, 0, 5]}, ["a[2]"], True, None),
        ({"x": 1}, {"a": {"b": 1, "c": 2}}, ["a.b"], False, {"x": 1, "a": {"b": 1, "c": 2}}),
        ({"a": 1}, {"a": {"b": 1}}, ["a.b"], False, {"a": 1}),
        ({"a": 1}, {"a": {"b": 1}}, ["a.b"], True, None),
        ({"a": 1}, {"b": 1}, ["a"], False, None),
        ({"a": 1}, {"a": None}, ["a", "a"], False, {}),
        ({"a": [{"b": [1, 2]}]}, {"a": [{"b": [7, None]}]}, ["a[0].b[0]", "a[0].b[1]"], True, {"a": [{"b": [7]}]}),
        ({"a": 1}, {}, [], False, {"a": 1}),
    ],
)
def test_merged_document(spark, doc, new, paths, strict, expected):
    row = spark.createDataFrame([(json.dumps(doc), json.dumps(new), paths)], "d string, n string, p array<string>")
    out = row.select(updates.merged_document(F.col("d"), F.col("n"), F.col("p"), strict).alias("m")).first().m
    assert (json.loads(out.doc) if out.doc else None) == expected
    assert (out.error is None) == (expected is not None)


def test_null_documents_and_empty_tables(spark):
    row = spark.createDataFrame([(None, "{}", ["a"])], "d string, n string, p array<string>")
    merge = updates.merged_document(F.col("d"), F.col("n"), F.col("p")).alias("m")
    assert row.select(merge).first().m.asDict() == {"doc": None, "error": None}
    assert row.limit(0).select(merge).collect() == []


def test_requests_for_one_term_follow_each_other(spark, sf_dir):
    from glossaria.queries import _part_terms
    from glossaria.plans.fixture import dictionary

    terms = _part_terms(spark, sf_dir).drop("p_size", "m")
    d = dictionary(spark, sf_dir)
    body = '{"_data": {"_remarks": ["%s"]}}'
    rows = [("part_1", body % k, ["_data._remarks[0]"], k) for k in (3, 1, 2, 2)] + [("part_2", body % "z", ["_data._nothing"], 1), ("part_2", body % "z", ["_data._remarks[0]"], 1)]
    rows += [("nobody", body % 1, ["_data"], 1), (None, body % 1, ["_data"], 1)]
    asked = spark.createDataFrame(rows, "_key string, text string, references array<string>, position long").withColumn("updates", F.parse_json("text")).drop("text")
    plan = updates.plan_updates(type(d)(terms, d.edges, d.links), asked)
    first = F.try_variant_get("term._data", "$._remarks[0]", "string")
    got = sorted((r["_key"] or "", r["position"], r["action"], r["v"]) for r in plan.withColumn("v", first).collect())
    assert got == [
        ("", 1, "unknown", None), ("nobody", 1, "unknown", None), ("part_1", 1, "updated", "1"), ("part_1", 2, "updated", "2"), ("part_1", 3, "same", "2"), ("part_1", 4, "updated", "3"),
        ("part_2", 1, "failed", None), ("part_2", 2, "updated", "z"),
    ]
    after = updates.apply_updates(terms, plan)
    assert after.count() == terms.count() == after.select("_key").distinct().count()
    assert {r["_key"]: r["v"] for r in after.select("_key", F.try_variant_get("_data", "$._remarks[0]", "string").alias("v")).where("v <> 'a'").collect()} == {"part_1": "3", "part_2": "z"}


def _asked(spark, rows):
    return spark.createDataFrame(rows, "_key string, text string, references array<string>, position long").withColumn("updates", F.parse_json("text")).drop("text")


def test_many_requests_and_null_ones(spark, sf_dir):
    from glossaria.queries import _part_terms
    from glossaria.plans.fixture import dictionary

    terms, d = _part_terms(spark, sf_dir).drop("p_size", "m"), dictionary(spark, sf_dir)
    bound = "_data._array._scalar._valid-range._min-range-inclusive"
    low = lambda v: '{"_data":{"_array":{"_scalar":{"_valid-range":{"_min-range-inclusive":%d}}}}}' % v
    rows = [("part_1", low(9 if k % 4 == 3 else -k), [bound], k) for k in range(11)] + [("part_2", None, [bound], 1), ("part_2", low(-7), [bound], 2), ("part_2", low(-8), None, 3)]
    plan = updates.plan_updates(type(d)(terms, d.edges, d.links), _asked(spark, rows))
    value = F.try_variant_get("term._data", "$._array._scalar['_valid-range']['_min-range-inclusive']", "int")
    got = {(r["_key"], r["position"]): (r["action"], r["v"]) for r in plan.withColumn("v", value).collect()}
    assert len(got) == len(rows)
    assert [got["part_1", k + 1] for k in range(11)] == [("refused", None) if k % 4 == 3 else ("updated", -k) for k in range(11)]
    assert [got["part_2", k][0] for k in (1, 2, 3)] == ["same", "updated", "same"] and got["part_2", 3][1] == -7
    assert all(r["_code"] is not None for r in updates.apply_updates(terms, plan).collect())


_DEFINITIONS = [
    ('{"_scalar":{"_type":"_type_number"}}', '{"_scalar":{"_type":"_type_string"}}'),
    ('{"_array":{"_scalar":{}}}', '{"_set":{"_set_scalar":{}}}'),
    ('{"_array":{"_elements":{"_min-items":1},"_scalar":{}}}', '{"_array":{"_elements":{"_min-items":2},"_scalar":{"_type":"x"}}}'),
    ('{"_set":{"_set_scalar":{"_set_type":"a"}}}', '{"_set":{"_set_scalar":{"_set_type":"b"}}}'),
    ('{"_set":{"_set_scalar":{"_set_type":"a"}}}', '{"_set":{}}'),
    ('{"_dict":{"_dict_key":{"_type_key":"a"},"_dict_value":{"_scalar":{"_type":"a"}}}}', '{"_dict":{"_dict_key":{"_type_key":"b"},"_dict_value":{"_array":{}}}}'),
    ('{"_dict":{"_dict_key":{"_type_key":"a"},"_dict_value":{"_scalar":{"_regexp":"a"}}}}', '{"_dict":{"_dict_key":{"_type_key":"a"},"_dict_value":{"_scalar":{"_regexp":"b"}}}}'),
    ('{"_dict":{"_dict_value":{"_array":{"_dict":{"_dict_key":{"_kind":["a"]}}}}}}', '{"_dict":{"_dict_value":{"_array":{"_dict":{"_dict_key":{"_kind":["b"]}}}}}}'),
    ('{"_array":{"_array":{"_array":{"_array":{"_scalar":{"_valid-range":{"_max-range-inclusive":3}}}}}}}', '{"_array":{"_array":{"_array":{"_array":{"_scalar":{"_valid-range":{"_max-range-exclusive":3}}}}}}}'),
    ('{"_array":{"_array":{"_array":{"_set":{"_set_scalar":{}}}}}}', '{"_array":{"_array":{"_array":{"_set":{"_set_scalar":null}}}}}'),
    ('{"_scalar":{"_valid-range":{"_min-range-inclusive":3,"_min-range-exclusive":3}}}', '{"_scalar":{"_valid-range":{"_min-range-inclusive":3,"_min-range-exclusive":3}}}'),
    ('{"_tuple":{"_tuple_types":["a"]}}', '{"_tuple":{"_tuple_types":["b"]}}'),
    ('{"_array":5}', '{"_array":{"_scalar":{"_type":"a"}}}'),
    ("[]", '{"_scalar":{}}'),
    ("{}", '{"x":1}'),
]


@pytest.mark.parametrize("levels", [None, 1, 2, 3])
def test_versions_are_compared_in_their_rows(spark, levels):
    from glossaria.operators import evolve, validate

    pairs = spark.createDataFrame([(str(k), *p) for k, p in enumerate(_DEFINITIONS)], "_key string, old string, new string").withColumn("old", F.parse_json("old")).withColumn("new", F.parse_json("new"))
    code = F.struct(F.lit("n").alias("_nid"), F.lit("l").alias("_lid"), F.lit("g").alias("_gid"), F.array(F.lit("l")).alias("_aid"))
    section = lambda v: F.struct("_key", code.alias("_code"), F.col(v).alias("_data"), F.lit(None).cast("variant").alias("_rule"))
    rows = evolve.first_violations(pairs.select("_key", section("old").alias("o"), section("new").alias("n")), levels)
    rules = lambda v: validate.descriptor_rules(pairs.select(F.col("_key").alias("descriptor"), F.col(v).alias("definition")), levels)
    expected = {r["descriptor"]: r["violation"] for r in evolve.rule_violations(rules("old"), rules("new")).collect()}
    assert {r["_key"]: r["violation"] for r in rows.collect() if r["violation"]} == expected
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
