"""Checking definitions before any value is read.

The grammar of data sections is a table: which child a section may or must have, of what shape, what section the child opens, and
the status code of each fault. Definitions are walked section by section, all at once, and joined with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.functions.columns import status_name
from glossaria.plans.cut import cut

# Types of scalars, of elements of sets and of keys of dictionaries (fixed values).
_ELEMENTS = ("_type_boolean", "_type_number", "_type_number_integer", "_type_number_timestamp", "_type_string", "_type_string_key", "_type_string_handle", "_type_string_enum", "_type_string_date")
TYPES = {
    "_scalar": (*_ELEMENTS, "_type_struct", "_type_object", "_type_object_geojson"),
    "_set_scalar": _ELEMENTS,
    "_dict_key": ("_type_string", "_type_string_key", "_type_string_handle", "_type_string_enum", "_type_string_date"),
}

_DIMENSIONS = [("_scalar", "OBJECT", "_scalar", -2), ("_array", "OBJECT", "_array", -1), ("_set", "OBJECT", "_set", -3), ("_tuple", "OBJECT", "_tuple", 48), ("_dict", "OBJECT", "_dict", -4)]
_LIMITS = ("_elements", "OBJECT", None, None, 52)
#: (section, child, shape, section that it opens, code if it is missing, code if it has another shape, whether an empty section may lack it)
GRAMMAR = [
    *[(s, child, shape, opens, None, wrong, True) for s in ("data", "_array") for child, shape, opens, wrong in _DIMENSIONS],
    *[(s, *_LIMITS, True) for s in ("_array", "_set", "_tuple")],
    ("_set", "_set_scalar", "OBJECT", "_set_scalar", -3, -3, False),
    ("_tuple", "_tuple_types", "ARRAY", None, 48, 47, False),
    ("_dict", "_dict_key", "OBJECT", "_dict_key", -4, -6, False),
    ("_dict", "_dict_value", "OBJECT", "data", -5, -7, False),
    ("_scalar", "_type", "STRING", None, -2, 15, True),
    ("_set_scalar", "_set_type", "STRING", None, -2, 15, True),
    ("_dict_key", "_type_key", "STRING", None, -6, 15, True),
]
_COLUMNS = "section string, child string, shape string, opens string, missing int, wrong int, lax boolean"


def definition_faults(definitions: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(descriptor, path, code) for each fault of (descriptor, definition VARIANT); a sound definition has no row.

    ``path`` is that of the section, with dots, from the outermost in. Codes are those that a value would meet there, if it got so far: -7 to -3, 47, 48,
    52 for parts that are missing or of another shape, -2 for a section without its type, -1 for one without a dimension, 15 for
    an unsupported type, 50 and 51 for limits beyond a tuple's types. With ``terms`` (term, is_descriptor), a type of a tuple that is no term
    has code 30, one that is no descriptor 5. Empty sections hold no type and ask for nothing, as values pass them. A definition that is null or no
    object has code -1. Children that the grammar does not name are not looked at.
    """
    spark = definitions.sparkSession
    grammar = cut(spark.createDataFrame(GRAMMAR, _COLUMNS))
    types = cut(spark.createDataFrame([(s, t) for s, names in TYPES.items() for t in names], "section string, type string"))
    fault = lambda df, code: df.select("descriptor", "path", code.cast("int").alias("code"))
    is_object = F.coalesce(F.schema_of_variant("v"), F.lit("VOID")).startswith("OBJECT")
    start = definitions.select("descriptor", F.lit("").alias("path"), F.lit("data").alias("section"), F.col("definition").alias("v"))
    faults = [fault(start.where(~is_object), F.lit(-1))]
    here = cut(start.where(is_object))
    while not here.isEmpty():
        fields = here.select("descriptor", "path", "section", F.explode_outer(F.expr("try_cast(v AS map<string, variant>)")).alias("child", "v"))
        fields = cut(fields.withColumn("is", F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))))
        known = fields.join(grammar, ["section", "child"])
        faults.append(fault(known.where(~F.col("is").startswith(F.col("shape"))), F.col("wrong")))

        # what must be there: each required child of a section, where no field bears its name
        filled = fields.groupBy("descriptor", "path", "section").agg(F.count("child").alias("n"))
        asked = filled.join(grammar.where("missing IS NOT NULL"), "section").where("n > 0 OR NOT lax")
        present = fields.select("descriptor", "path", "section", "child")
        faults.append(fault(asked.join(present, ["descriptor", "path", "section", "child"], "left_anti"), F.col("missing")))
        dimensions = [name for name, *_ in _DIMENSIONS]
        bare = fields.where("section IN ('data', '_array')").groupBy("descriptor", "path").agg(F.count("child").alias("n"), F.count_if(F.col("child").isin(dimensions)).alias("m"))
        faults.append(fault(bare.where("n > 0 AND m = 0"), F.lit(-1)))

        typed = known.where("child IN ('_type', '_set_type', '_type_key')").where(F.col("is") == "STRING").withColumn("type", F.try_variant_get("v", "$", "string"))
        faults.append(fault(typed.join(types, ["section", "type"], "left_anti"), F.lit(15)))

        tuples = here.where("section = '_tuple'").withColumn("names", F.try_variant_get("v", "$._tuple_types", "array<string>")).where("names IS NOT NULL")
        limit = lambda name: F.try_variant_get("v", f"$._elements['{name}']", "long")
        faults.append(fault(tuples.where(limit("_min-items") > F.size("names")), F.lit(50)))
        faults.append(fault(tuples.where(limit("_max-items") > F.size("names")), F.lit(51)))
        if terms is not None:
            named = tuples.select("descriptor", "path", F.explode(F.array_distinct("names")).alias("term")).join(terms, "term", "left")
            faults.append(fault(named.where("is_descriptor IS NULL OR NOT is_descriptor"), F.when(F.col("is_descriptor").isNull(), 30).otherwise(5)))
        opened = known.where("opens IS NOT NULL").where(F.col("is").startswith("OBJECT"))
        step = F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), "child")
        here = cut(opened.select("descriptor", step.alias("path"), F.col("opens").alias("section"), "v"))
    return reduce(DataFrame.unionByName, faults).distinct()


def first_fault(faults: DataFrame) -> DataFrame:
    """(descriptor, path, code, status) of the outermost fault of each definition; of several there, the one with the least code."""
    order = F.struct(F.size(F.split("path", r"\.")).alias("depth"), "path", "code")
    least = faults.groupBy("descriptor").agg(F.min(order).alias("first"))
    return least.select("descriptor", F.col("first.path").alias("path"), F.col("first.code").alias("code"), status_name(F.col("first.code")).alias("status"))
