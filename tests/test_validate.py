import json

import pytest
from pyspark.sql import functions as F

from glossaria import model
from glossaria.operators import evolve, validate
from glossaria.plans.fixture import dictionary

RULES = {
    "flag": {"_scalar": {"_type": "_type_boolean"}},
    "int": {"_scalar": {"_type": "_type_number_integer", "_valid-range": {"_min-range-inclusive": 0, "_max-range-exclusive": 10}}},
    "text": {"_scalar": {"_type": "_type_string", "_regexp": "^[a-c]+$", "_valid-range_string": {"_min-range-inclusive_string": "b"}}},
    "key": {"_scalar": {"_type": "_type_string_key", "_kind": ["_any-term"]}},
    "enumkey": {"_scalar": {"_type": "_type_string_key", "_kind": ["_any-enum"]}},
    "handle": {"_scalar": {"_type": "_type_string_handle"}},
    "enum": {"_scalar": {"_type": "_type_string_enum", "_kind": ["catalog", "geo"]}},
    "date": {"_scalar": {"_type": "_type_string_date"}},
    "stamp": {"_scalar": {"_type": "_type_number_timestamp"}},
    "struct": {"_scalar": {"_type": "_type_struct"}},
    "geo": {"_scalar": {"_type": "_type_object_geojson"}},
    "odd": {"_scalar": {"_type": "_type_unheard"}},
    "list": {"_array": {"_scalar": {"_type": "_type_number"}, "_elements": {"_min-items": 1, "_max-items": 2}}},
    "set": {"_set": {"_set_scalar": {"_set_type": "_type_number"}}},
    "pair": {"_tuple": {"_tuple_types": ["int", "text"]}},
    "dict": {"_dict": {"_dict_key": {"_type_key": "_type_string"}, "_dict_value": {"_scalar": {"_type": "_type_number"}}}},
}

CASES = [
    ("flag", True, 0), ("flag", "x", 8), ("int", 3, 0), ("int", 3.0, 0), ("int", 3.5, 9), ("int", -1, 12), ("int", 10, 13), ("int", "5", 9), ("int", None, 9),
    ("int", [1], 6), ("text", "bc", 0), ("text", 1, 16), ("text", "x", 17), ("text", "a", 12), ("key", "nation_1", 0), ("key", "", 18), ("key", ";", 21), ("key", "a b", 23),
    ("key", "none", 30), ("enumkey", "nation_1", 0), ("enumkey", "geo", 19), ("handle", "terms/nation_1", 0), ("handle", "terms", 24), ("handle", "a b/c", 25),
    ("handle", "users/c", 26), ("handle", "terms/a b", 23), ("handle", "terms/none", 22), ("enum", "nation_1", 0), ("enum", "geo", 19), ("enum", "supplier_1", 27), ("enum", "1000000", 30),
    ("date", "2020", 0), ("date", "202013", 0), ("date", "20", 33), ("date", 2020, 16), ("stamp", 5, 0), ("stamp", "1970-01-01T00:00:01Z", 0), ("stamp", "soon", 14),
    ("struct", {"a": 1}, 0), ("struct", 1, 31), ("geo", {"type": "Point", "coordinates": [1]}, 0), ("geo", {"coordinates": [1]}, 38), ("geo", {"type": "Point"}, 39),
    ("geo", {"type": "Point", "coordinates": 1}, 40), ("odd", 1, 15), ("list", [1], 0), ("list", [], 36), ("list", [1, 2, 3], 37), ("list", 1, 35), ("list", [1, "x"], 10),
    ("set", [1, 1, 2], 0), ("pair", [1, "b"], 0), ("pair", [1], 49), ("pair", [1, 2], 16), ("pair", 1, 44), ("dict", {"a": 1}, 0), ("dict", {"a": "x"}, 10), ("dict", 1, 31), ("missing", 1, 28),
]


@pytest.fixture(scope="module")
def report(spark, sf_dir):
    definitions = spark.createDataFrame([(k, json.dumps(v)) for k, v in RULES.items()], "descriptor string, text string").select("descriptor", F.parse_json("text").alias("definition"))
    rows = spark.createDataFrame([(k, d, json.dumps(v)) for k, (d, v, _) in enumerate(CASES)], "row_id int, descriptor string, text string")
    rows = rows.select("row_id", "descriptor", F.parse_json("text").alias("value"))
    out = validate.validate(dictionary(spark, sf_dir), validate.descriptor_rules(definitions, 3), rows, resolve_field="_lid", levels=3)
    return {r["row_id"]: r for r in out.drop("value").collect()}


def test_codes(report):
    wrong = [(d, v, code, report[k]["code"]) for k, (d, v, code) in enumerate(CASES) if report[k]["code"] != code]
    assert not wrong
    assert {c for *_, c in CASES} <= set(model.STATUS)


def test_corrections(report):
    by = {(d, json.dumps(v)): report[k] for k, (d, v, _) in enumerate(CASES)}
    assert by["stamp", '"1970-01-01T00:00:01Z"']["resolved"] == "1000" and len(by["stamp", '"1970-01-01T00:00:01Z"']["changes"]) == 1
    assert by["set", "[1, 1, 2]"]["resolved"] == "[1,2]" and by["list", "[1]"]["resolved"] == "[1]"
    assert not by["int", "3"]["changes"]


def test_elements_beyond_levels_are_not_called_valid(spark, sf_dir):
    text = '{"_array": {"_array": {"_array": {"_scalar": {"_type": "_type_number"}}}}}'
    rules = validate.descriptor_rules(spark.sql(f"SELECT 'deep' AS descriptor, parse_json('{text}') AS definition"), 2)
    rows = spark.sql("SELECT id AS row_id, 'deep' AS descriptor, parse_json(text) AS value FROM VALUES (1, '[]'), (2, '[[]]'), (3, '[[[\"x\"]]]'), (4, '[1]') AS t(id, text)")
    got = {r["row_id"]: r["code"] for r in validate.validate(dictionary(spark, sf_dir), rules, rows, levels=2).select("row_id", "code").collect()}
    assert got == {1: 0, 2: 0, 3: 53, 4: 35}


def test_empty(spark, sf_dir):
    definitions = spark.createDataFrame([("flag", json.dumps(RULES["flag"]))], "descriptor string, text string").select("descriptor", F.parse_json("text").alias("definition"))
    rows = spark.sql("SELECT 1 AS row_id, 'flag' AS descriptor, parse_json('true') AS value WHERE false")
    assert validate.validate(dictionary(spark, sf_dir), validate.descriptor_rules(definitions, 1), rows).count() == 0


def test_structures(spark):
    text = '{"_required": {"_selection-descriptors_one-none-of": [["a", "b"], ["c", "d"]], "_selection-descriptors_any": ["a", "c", "e"]}, "_banned": ["z"]}'
    rule = validate.structure_rules(spark.sql(f"SELECT 's' AS structure, parse_json('{text}') AS definition"))
    rows = spark.createDataFrame([(["a", "c"],), (["a", "b"],), (["b"],), (["a", "z"],)], "keys array<string>")
    got = [r["ok"] for r in rows.crossJoin(rule).select("keys", validate.structure_holds(F.col("keys")).alias("ok")).collect()]
    assert got == [True, False, False, False]


def test_ranges_may_only_widen(spark):
    def rules(low, kind="_min-range-inclusive"):
        text = json.dumps({"_scalar": {"_type": "_type_number", "_valid-range": {kind: low} if low is not None else {}}})
        return validate.descriptor_rules(spark.sql(f"SELECT 'd' AS descriptor, parse_json('{text}') AS definition"), 1)

    verdict = lambda a, b: [r["violation"] for r in evolve.rule_violations(a, b).collect()]
    assert verdict(rules(3), rules(2)) == [] and verdict(rules(3), rules(None)) == []
    assert verdict(rules(3), rules(4)) == ["num lower bound raised"]
    assert verdict(rules(3), rules(3, "_min-range-exclusive")) == ["num lower bound raised"]
    assert verdict(rules(3, "_min-range-exclusive"), rules(3)) == []
    assert verdict(rules(None), rules(3)) == ["num range added"]
