import json

import pytest
from pyspark.sql import functions as F

from glossaria.operators import definitions, validate
from glossaria.plans.fixture import dictionary

RULES = {
    "anysize": {"_scalar": {"_type": "_type_number_integer", "_valid-range": {"_max-range-inclusive": 40}}},
    "pair": {"_tuple": {"_tuple_types": ["anysize", "missing"]}},
    "rows": {"_array": {"_scalar": {"_type": "_type_object", "_kind": ["boxed"]}}},
    "box": {"_scalar": {"_type": "_type_object", "_kind": ["boxed"]}},
    "any": {"_scalar": {"_type": "_type_object", "_kind": ["_any-object"]}},
    "made": {"_scalar": {"_type": "_type_number_timestamp"}},
    "named": {"_dict": {"_dict_key": {"_type_key": "_type_string_enum", "_kind": ["geo"]}, "_dict_value": {}}},
    "broken": {"_dict": {"_dict_key": {"_type_key": "_type_string"}, "_dict_value": 3}},
    "free": {},
    "deep": {"_array": {"_array": {"_set": {"_set_scalar": {"_set_type": "_type_number_timestamp"}}}}},
}
STAMP = "1970-01-01T00:00:01Z"


def _json(spark, rows, columns):
    frame = spark.createDataFrame([(*r[:-1], json.dumps(r[-1])) for r in rows], ", ".join(f"{c} string" for c in [*columns[:-1], "text"]))
    return frame.select(*columns[:-1], F.parse_json("text").alias(columns[-1]))


@pytest.fixture(scope="module")
def setting(spark, sf_dir):
    rules = validate.descriptor_rules(_json(spark, list(RULES.items()), ["descriptor", "definition"]))
    structures = validate.structure_rules(_json(spark, [("boxed", {"_required": {"_selection-descriptors_all": ["anysize"]}})], ["structure", "definition"]))
    known = spark.createDataFrame([(k, True) for k in RULES], "term string, is_descriptor boolean")
    return dictionary(spark, sf_dir), rules, {"structures": structures, "descriptors": known}


def test_values_at_any_place(spark, setting):
    cases = [
        ("pair", [1, "x"], 30, None), ("rows", [{"other": 1}], 34, None), ("box", {"other": 1}, 34, None), ("any", {"anysize": 1}, 0, None), ("any", {"anysize": 41}, 13, None), ("rows", [{"anysize": 1}, {"anysize": "x"}], 9, None),
        ("rows", [{"anysize": 1, "rows": [{"anysize": 1, "rows": [{"anysize": 99}]}]}], 13, None), ("named", {"1": STAMP, "nation_1": 5}, 0, {"nation_1": 5}), ("named", {"nobody": 1}, 30, None), ("broken", {"a": 1}, -7, None),
        ("broken", {}, -7, None), ("broken", 1, 31, None), ("free", [1, {"a": None}], 0, None), ("rows", [], 0, None), ("deep", [[], [[STAMP, 1000, 5]]], 0, [[], [[1000, 5]]]), ("any", {}, 0, None), ("any", {"made": STAMP, "free": {"b": 1, "a": [None, "\n"]}}, 0, {"free": {"a": [None, "\n"], "b": 1}, "made": 1000}),
        ("box", None, 31, None), ("deep", None, 35, None),
    ]
    d, rules, options = setting
    rows = _json(spark, [(str(k), n, v) for k, (n, v, _, _) in enumerate(cases)], ["row_id", "descriptor", "value"])
    got = {int(r["row_id"]): r for r in validate.validate(d, rules, rows, resolve_field="_lid", **options).drop("value").collect()}
    assert [(n, v, got[k]["code"]) for k, (n, v, _, _) in enumerate(cases)] == [(n, v, c) for n, v, c, _ in cases]
    for k, (_, value, _, fixed) in enumerate(cases):
        assert json.loads(got[k]["resolved"]) == (value if fixed is None else fixed)
        assert bool(got[k]["changes"]) == (fixed is not None)


def test_objects(spark, setting):
    d, rules, options = setting
    rows = _json(spark, [("1", {"anysize": 1, "rows": [{"anysize": 50}]}), ("2", [1]), ("3", {"x": 1}), ("4", {"any": {"made": STAMP}}), ("5", {"any": {"made": STAMP}, "pair": [1, 2]}), ("6", {})], ["row_id", "object"])
    got = {r["row_id"]: (r["code"], r["property"], len(r["changes"]), json.loads(r["resolved"])) for r in validate.validate_objects(d, rules, rows, **options).collect()}
    assert got["1"][:3] == (13, "rows", 0) and got["2"][:3] == (31, None, 0) and got["3"][:3] == (32, "x", 0) and got["6"] == (0, None, 0, {})
    assert got["4"] == (0, None, 1, {"any": {"made": 1000}})
    assert got["5"] == (30, "pair", 1, {"any": {"made": STAMP}, "pair": [1, 2]})
    assert validate.validate_objects(d, rules, rows.limit(0), **options).count() == 0


def test_idempotent(spark, setting):
    d, rules, options = setting
    rows = _json(spark, [("1", "deep", [[[STAMP, STAMP, 3]]]), ("2", "any", {"made": STAMP, "named": {"1": 1, "nation_1": 2}})], ["row_id", "descriptor", "value"])
    once = validate.validate(d, rules, rows, resolve_field="_lid", **options)
    again = once.select("row_id", "descriptor", F.parse_json("resolved").alias("value"))
    twice = {r["row_id"]: (r["resolved"], len(r["changes"])) for r in validate.validate(d, rules, again, resolve_field="_lid", **options).collect()}
    assert twice == {r["row_id"]: (r["resolved"], 0) for r in once.select("row_id", "resolved").collect()}


def test_sound_definitions_have_no_fault(spark):
    rows = _json(spark, [(k, v) for k, v in RULES.items() if k != "broken"], ["descriptor", "definition"])
    assert definitions.definition_faults(rows).count() == 0
    terms = spark.createDataFrame([(k, True) for k in RULES], "term string, is_descriptor boolean")
    assert [tuple(r) for r in definitions.definition_faults(rows, terms).collect()] == [("pair", "_tuple", 30)]
    assert definitions.definition_faults(rows.limit(0)).count() == 0
