"""Bulk validation of values and objects against rules stored as data.

Input rows hold a ``VARIANT``; rules come from the dictionary as one row for each descriptor and section. All values are checked by one
set of expressions. Plain scalars need one join and a projection. Everything else goes through one worklist whose rows are values or
objects, each with the path of steps that leads to it: containers yield their elements, objects their properties, and values that are
objects yield objects, until no row is left. The first failing check of a record, in the order of paths, gives its code; corrected
records are folded up again from the deepest paths (``fold``).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import change_hash, handle_collection, handle_key, in_range, valid_collection, valid_key
from glossaria.plans.cut import cut, dealt
from glossaria.plans.dictionary import Dictionary

_STRINGS = ("_type_string", "_type_string_key", "_type_string_handle", "_type_string_enum", "_type_string_date")


def _rule_columns(v: Column, role: Column) -> list[Column]:
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    type_ = F.when(role == "_dict_key", get("_type_key", "string")).when(role == "_set_scalar", get("_set_type", "string")).otherwise(get("_type", "string"))
    out = [type_.alias("type"), get("_kind", "array<string>").alias("kinds"), get("_regexp", "string").alias("regexp")]
    for name, (section, suffix) in model.RANGES.items():
        kind = "double" if name == "num" else "string"
        out += [F.try_variant_get(v, f"$['{section}']['{field}{suffix}']", kind).alias(f"{name}_{b}") for b, field in model.BOUNDS.items()]
    out += [F.try_variant_get(v, f"$._elements['{f}']", "long").alias(a) for f, a in (("_min-items", "min_items"), ("_max-items", "max_items"))]
    return out


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def container_of(v: Column, role: Column) -> Column:
    """The kind of the section that ``v`` holds, null if it has none."""
    return F.when(role == "data", F.coalesce(*[F.when(_part(v, c).isNotNull(), c) for c in model.CONTAINERS])).otherwise(role)


def section_of(v: Column, role: Column) -> Column:
    return F.when(role == "data", F.coalesce(*[_part(v, c) for c in model.CONTAINERS])).otherwise(v)


def descriptor_rules(definitions: DataFrame, levels: int | None = None) -> DataFrame:
    """Rules from (descriptor, definition VARIANT): one row for each section, however deep.

    ``levels`` spares the look for deeper sections where the caller knows that there are no more.

    ``path`` names the section from the outermost in, ``container`` its kind, null if it has none of them. ``fault`` is the code of a malformed
    tuple or dictionary section, ``value_fault`` that of a dictionary's value section, which is met after the keys.
    """

    here = definitions.select("descriptor", F.lit("").alias("path"), F.col("definition").alias("v"), F.lit("data").alias("role"))
    out = []
    while not out or len(out) != levels and not here.isEmpty():
        is_data = F.col("role") == "data"
        rows = here.withColumn("container", container_of(F.col("v"), F.col("role"))).withColumn("s", section_of(F.col("v"), F.col("role")))
        tuple_types = F.try_variant_get("s", "$._tuple_types", "array<string>").alias("tuple_types")
        has = lambda name: _part(F.col("s"), name).isNotNull()
        shape = lambda name: F.coalesce(F.schema_of_variant(_part(F.col("s"), name)), F.lit("VOID"))
        key_part, value_part, inside = shape("_dict_key"), shape("_dict_value"), F.col("container")
        no_list = (inside == "_tuple") & has("_tuple_types") & ~shape("_tuple_types").startswith("ARRAY")
        no_limits = (inside == "_tuple") & has("_elements") & ~shape("_elements").startswith("OBJECT")
        no_key = F.when(~has("_dict_key"), -4).when(~key_part.startswith("OBJECT"), -6).when((key_part != "OBJECT<>") & ~has("_dict_key._type_key"), -6)
        no_value = F.when(~has("_dict_value"), -5).when(~value_part.startswith("OBJECT"), -7)
        faults = [F.when(no_list, 47).when(no_limits, 52).when(inside == "_dict", no_key).alias("fault"), F.when(inside == "_dict", no_value).alias("value_fault")]
        n_fields = F.size(F.map_keys(F.coalesce(F.try_variant_get("v", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))).alias("n_fields")
        # a level's rules and the sections below it are written in one pass
        below = lambda step, v, role: F.struct(F.concat("path", F.lit(step)).alias("path"), v.alias("v"), F.lit(role).alias("role"))
        key = lambda name: _part(F.col("s"), name)
        inner = F.when(is_data & (inside == "_array"), F.array(below("/e", F.col("s"), "data"))).when(is_data & (inside == "_set"), F.array(below("/e", key("_set_scalar"), "_set_scalar")))
        inner = inner.when(is_data & (inside == "_dict"), F.array(below("/k", key("_dict_key"), "_dict_key"), below("/v", key("_dict_value"), "data")))
        level = cut(rows.select("descriptor", "path", "container", *_rule_columns(F.col("s"), F.col("role")), tuple_types, *faults, n_fields, inner.alias("inner")))
        out.append(level.drop("inner"))
        here = level.select("descriptor", F.explode("inner").alias("x")).select("descriptor", "x.*").where("v IS NOT NULL")
    return reduce(DataFrame.unionByName, out)


def _bounds(name: str) -> dict[str, Column]:
    return {b: F.col(f"{name}_{b}") for b in model.BOUNDS}


def _is(kind: Column, *names: str) -> Column:
    return reduce(Column.__or__, (kind.startswith(n) for n in names))


def scalar_code(types: set[str | None], expect_types: bool = False, allow_default: bool = False) -> Column:
    """The status code of a scalar, over the columns of the rules, ``value``, ``kind``, ``text``, ``number`` and the
    looked-up ``term_found``, ``is_descriptor``, ``is_structure``, ``roots``, ``document_found`` and ``resolved``.

    ``types`` are those that the rules have; no other type is built into the expression."""
    kind, text, number = F.col("kind"), F.col("text"), F.col("number")
    is_number = _is(kind, "BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    ranged = in_range(number, _bounds("num"))
    is_string = kind == "STRING"
    regexp = F.when(F.col("regexp").isNotNull() & ~F.regexp_like(text, F.col("regexp")), 17)
    string = F.when(~is_string, 16).otherwise(F.coalesce(regexp, in_range(text, _bounds("str"))))
    stamp = F.unix_millis(F.try_to_timestamp(text)).cast("double")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    fits = lambda k: (
        F.when(k == "_any-term", F.lit(0))
        .when(k == "_any-enum", F.when(F.size("roots") > 0, 0).otherwise(19))
        .when(k == "_any-descriptor", F.when(F.col("is_descriptor"), 0).otherwise(5))
        .when(k == "_any-object", F.when(F.col("is_structure"), 0).otherwise(20))
        .otherwise(F.when(F.array_contains("roots", k), 0).otherwise(27))
    )
    tried = F.transform(kinds, fits)
    by_kind = F.when(F.size(kinds) == 0, 0).when(~F.col("term_found"), 30).when(F.exists(tried, lambda c: c == 0), 0).otherwise(F.element_at(tried, -1))
    key = F.when(string != 0, string).when(text == "", F.lit(0 if allow_default else 18)).when(text == model.DEFAULT_NAMESPACE, 21).when(~valid_key(text), 23).otherwise(by_kind)
    parts = F.split(text, "/")
    handle = (
        F.when(string != 0, string)
        .when(F.size(parts) != 2, 24)
        .when(~valid_collection(handle_collection(text)), 25)
        .when(~handle_collection(text).isin(*model.COLLECTIONS), 26)
        .when(~valid_key(handle_key(text)), 23)
        .when(~F.col("document_found"), 22)
        .otherwise(0)
    )
    enum = (
        F.when(string != 0, string)
        .when(text == model.DEFAULT_NAMESPACE, 21)
        .when(~F.col("term_found"), F.when(F.col("resolved").isNotNull(), 0).otherwise(30))
        .when(F.size("roots") == 0, 19)
        .when((F.size(kinds) > 0) & ~F.arrays_overlap("roots", kinds), 27)
        .otherwise(0)
    )
    date = F.when(~is_string, 16).when(~F.regexp_like(text, F.lit(r"^(\d{4}|\d{6}|\d{8}|\d{4}-\d{4})$")), 33).otherwise(in_range(text, _bounds("date")))
    is_object = kind.startswith("OBJECT")
    geo_type, coordinates = F.try_variant_get("value", "$.type", "variant"), F.try_variant_get("value", "$.coordinates", "variant")
    geojson = F.when(~is_object, 31).when(geo_type.isNull(), 38).when(coordinates.isNull(), 39).when(~F.schema_of_variant(coordinates).startswith("ARRAY"), 40).otherwise(0)
    by_type = {
        "_type_boolean": F.when(kind != "BOOLEAN", 8).otherwise(0),
        "_type_number": F.when(~is_number, 10).otherwise(ranged),
        "_type_number_integer": F.when(~is_number | (number != F.floor(number)), 9).otherwise(ranged),
        "_type_number_timestamp": F.when(is_number, ranged).when(is_string & stamp.isNotNull(), in_range(stamp, _bounds("num"))).otherwise(14),
        "_type_string": string,
        "_type_string_key": key,
        "_type_string_handle": handle,
        "_type_string_enum": enum,
        "_type_string_date": date,
        "_type_struct": F.when(~is_object, 31).otherwise(0),
        "_type_object": F.when(~is_object, 31).otherwise(0),
        "_type_object_geojson": geojson,
    }
    code = F.when(kind.startswith("ARRAY") & (F.col("container") == "_scalar"), 6).when(F.col("type").isNull(), F.lit(-2 if expect_types else 0))
    for name in types & set(by_type):
        code = code.when(F.col("type") == name, by_type[name])
    return code.otherwise(15)


@dataclass(frozen=True)
class _References:
    """What the dictionary knows of terms (``_ref``), handles (``_doc``) and codes (``_code``); none where no rule asks."""

    flags: DataFrame | None
    documents: DataFrame | None
    codes: DataFrame | None

    def written(self) -> _References:
        """The same as tables, for rounds that each ask anew."""
        return replace(self, **{k: t if t is None else cut(t) for k, t in vars(self).items()})


def _references(d: Dictionary, resolve_field: str | None, types: set[str | None]) -> _References:
    """``types`` are those that occur in the rules."""
    flags = documents = by_code = None
    if types & {"_type_string_key", "_type_string_enum"}:
        flags = d.term_flags.select(F.col("term").alias("_ref"), F.lit(True).alias("term_found"), "is_descriptor", "is_structure", "roots")
    if "_type_string_handle" in types:
        documents = d.terms.select(F.concat(F.lit("terms/"), "_key").alias("_doc"), F.lit(True).alias("document_found"))
    if resolve_field is not None and "_type_string_enum" in types:
        # For each code and enumeration the element, if it is the only one
        members = d.enum_members.select(F.col("term").alias("key"), "root")
        codes = d.term_codes.where(F.col("field") == resolve_field).select("code", "key").distinct()
        single = codes.join(members, "key").groupBy("code", "root").agg(F.count("*").alias("n"), F.first("key").alias("key")).where("n = 1")
        by_code = single.groupBy(F.col("code").alias("_code")).agg(F.map_from_entries(F.collect_list(F.struct("root", "key"))).alias("_keys"))
    return _References(flags, documents, by_code)


def _met(rows: DataFrame, known: DataFrame, name: str, asked: Column) -> DataFrame:
    """``rows`` with what ``known`` has under the text ``asked``.

    A few texts may stand in very many rows, and most rows may ask nothing: rows meet a table of the texts that occur, and those
    without one are spread, so that neither gathers in one task.
    """
    rows = rows.withColumn(name, asked)
    named = lambda text: F.concat(F.lit("="), text)
    found = rows.select(name).where(F.col(name).isNotNull()).distinct().join(known, name).withColumn(name, named(F.col(name)))
    apart = F.pmod(F.xxhash64("row_id"), F.lit(1 << 20)).cast("string")  # no text that is asked, for those begin with a sign
    return rows.withColumn(name, F.coalesce(named(F.col(name)), apart)).join(found, name, "left").drop(name)


def _looked_up(known: _References, rows: DataFrame) -> DataFrame:
    """Add what the dictionary knows of each text that a rule takes for a reference."""
    none = F.lit(None)
    if known.flags is not None:
        rows = _met(rows, known.flags, "_ref", F.when(F.col("type").isin("_type_string_key", "_type_string_enum"), F.col("text")))
    else:
        rows = rows.withColumns({c: none.cast("boolean") for c in ("term_found", "is_descriptor", "is_structure")}).withColumn("roots", none.cast("array<string>"))
    if known.documents is not None:
        rows = _met(rows, known.documents, "_doc", F.when(F.col("type") == "_type_string_handle", F.col("text")))
    else:
        rows = rows.withColumn("document_found", none.cast("boolean"))
    false = F.lit(False)
    rows = rows.withColumns({c: F.coalesce(c, false) for c in ("term_found", "is_descriptor", "is_structure", "document_found")})
    rows = rows.withColumn("roots", F.coalesce("roots", F.array().cast("array<string>")))
    if known.codes is None:
        return rows.withColumn("resolved", F.lit(None).cast("string"))
    # The first kind that has an element of this code
    rows = _met(rows, known.codes, "_code", F.when((F.col("type") == "_type_string_enum") & ~F.col("term_found"), F.col("text")))
    hits = F.filter(F.transform("kinds", lambda k: F.try_element_at("_keys", k)), lambda x: x.isNotNull())
    return rows.withColumn("resolved", F.try_element_at(hits, F.lit(1))).drop("_keys")


def _checked(known: _References, leaves: DataFrame, types: set[str | None], resolve_field: str | None, expect_types: bool, allow_default: bool, *keep: str) -> DataFrame:
    """``keep`` and (code, change, json) of scalars that are joined with their rules."""
    leaves = leaves.withColumn("text", F.when(F.col("kind") == "STRING", F.try_variant_get("value", "$", "string"))).withColumn(
        "number", F.when(_is(F.col("kind"), "BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get("value", "$", "double"))
    )
    leaves = _looked_up(known, leaves).withColumn("code", scalar_code(types, expect_types, allow_default))
    after, given = F.lit(None).cast("string"), F.to_json("value")
    if "_type_number_timestamp" in types:
        after = F.when((F.col("type") == "_type_number_timestamp") & (F.col("kind") == "STRING"), F.unix_millis(F.try_to_timestamp("text")).cast("string"))
    if resolve_field is not None and "_type_string_enum" in types:
        after = F.coalesce(after, F.col("resolved"))
    leaves = leaves.withColumn("after", F.when(F.col("code") == 0, after))
    change = F.when(F.col("after").isNotNull(), F.struct(change_hash(F.col("field"), F.col("after")).alias("hash"), "field", F.col("text").alias("original"), F.col("after").alias("resolved")))
    written = F.when(F.col("type") == "_type_number_timestamp", F.col("after")).otherwise(F.to_json(F.col("after").cast("variant")))
    return leaves.select(*keep, "code", change.cast(_CHANGE).alias("change"), F.coalesce(written, given).alias("json"))


_CHANGE = "struct<hash:string,field:string,original:string,resolved:string>"
_ITEM = ("row_id", "at", "link", "origin", "descriptor", "path", "value", "field", "top", "nest", "kinds")
_MARK = ("row_id", "at", "code", "top", "change")


def _plain(d: Dictionary, rules: DataFrame, rows: DataFrame, types: set[str | None], *options) -> DataFrame:
    """The report of rows whose descriptors are plain scalars or unknown: one join with the rules and a projection, no grouping."""
    rules = rules.where("path = '' AND container = '_scalar'")
    joined = rows.select("row_id", "descriptor", "value").join(rules, "descriptor", "left").withColumn("kind", F.coalesce(F.schema_of_variant("value"), F.lit("VOID")))
    checked = _checked(_references(d, options[0], types), joined.withColumn("field", F.col("descriptor")), types, *options, "row_id", "container", "descriptor", "value")
    code = F.when(F.col("container").isNull(), 28).otherwise(F.col("code"))
    fine = F.when(code == 0, F.col("json")).otherwise(F.to_json("value"))
    changes = F.array_compact(F.array(F.when(code == 0, F.col("change"))))
    return checked.select("row_id", "descriptor", code.alias("code"), "value", fine.alias("resolved"), changes.alias("changes"))


def _structures(d: Dictionary, structures: DataFrame | None) -> DataFrame:
    """Rules of structures: those given, else those of the dictionary's terms."""
    if structures is not None:
        return structures
    return structure_rules(d.terms.where("_rule IS NOT NULL").select(F.col("_key").alias("structure"), F.col("_rule").alias("definition")))


def _opened(objects: DataFrame, structures: DataFrame | None) -> DataFrame:
    """Objects with their ``props`` and the ``code`` of those that are none, or that no kind's rule admits."""
    is_object = F.coalesce(F.schema_of_variant("value"), F.lit("VOID")).startswith("OBJECT")
    here = objects.withColumn("props", F.when(is_object, F.expr("try_cast(value AS map<string, variant>)")))
    code = F.when(F.col("props").isNull(), 31)
    if structures is not None:
        tried = here.where("props IS NOT NULL AND kinds IS NOT NULL").select("row_id", "at", F.map_keys("props").alias("keys"), F.explode("kinds").alias("structure"))
        passed = tried.join(structures, "structure").where(structure_holds(F.col("keys"))).select("row_id", "at", F.lit(True).alias("ok")).distinct()
        here = here.join(passed, ["row_id", "at"], "left")
        code = code.when(F.col("kinds").isNotNull() & F.col("ok").isNull(), 34)
    return here.withColumn("code", F.coalesce(code, F.lit(0)))


def _items(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows of the worklist: what is not given is the same as above for ``row_id``, else nothing."""
    kinds = {"nest": "int", "kinds": "array<string>", "path": "string", "top": "string", "field": "string", "descriptor": "string"}
    nothing = {"path": F.lit(""), "nest": F.lit(0)} | {c: F.lit(None).cast(kinds[c]) for c in ("kinds", "top", "field", "descriptor")}
    return rows.select("row_id", *[columns.get(c, nothing.get(c, F.lit(None))).alias(c) for c in _ITEM[1:]])


def _values(known: _References, rules: DataFrame, here: DataFrame, descriptors, expect_terms: bool, types, containers, levels: int | None, options: tuple) -> DataFrame:
    """Values of the worklist with their rules, ``code``, ``change`` and corrected ``json``; ``shape`` is that of a container to follow."""
    expect_types = options[1]
    joined = here.drop("kinds").join(rules.withColumn("ruled", F.lit(True)), ["descriptor", "path"], "left")
    # few names stand in many rows: these meet a table of the names that occur, never all terms, which would gather a name's rows in one task
    named = here.select("descriptor").distinct().join(descriptors.select(F.col("term").alias("descriptor"), F.col("is_descriptor").alias("_known")), "descriptor")
    joined = joined.join(cut(named), "descriptor", "left")
    joined = joined.withColumn("kind", F.coalesce(F.schema_of_variant("value"), F.lit("VOID")))
    more = ("tuple_types", "fault", "value_fault", "container", "type", "kind", "kinds", "ruled", "_known", "n_fields", "min_items", "max_items")
    out = _checked(known, joined, types, *options, *_ITEM[:-1], *more)
    missing = (
        F.when(F.col("origin") == "top", 28)
        .when(F.col("origin") == "property", F.when(F.col("_known").isNull(), 32 if expect_terms else 0).otherwise(29))
        .when(F.col("origin") == "tuple", F.when(F.col("_known").isNull(), 30).when(~F.col("_known"), 5).otherwise(28))
        .otherwise(0)
    )
    n, many, low, high = F.col("n"), F.size("tuple_types"), F.col("min_items"), F.col("max_items")
    listed = F.when(n.isNull(), 35).when(n < low, 36).when(n > high, 37)
    tupled = F.when(n.isNull(), 44).when(F.col("fault") == 47, 47).when(F.col("tuple_types").isNull(), 48).when(F.col("fault") == 52, 52)
    tupled = tupled.when(low > many, 50).when(n < low, 45).when(high > many, 51).when(n > high, 46).when(low.isNull() & high.isNull() & (n != many), 49)
    keyed = F.when(~F.col("kind").startswith("OBJECT"), 31).otherwise(F.col("fault"))
    by_container = {"_array": listed, "_set": listed, "_tuple": tupled, "_dict": keyed}
    code = F.when(F.col("ruled").isNull(), missing).when(F.col("container").isNull(), F.when(F.col("n_fields") > 0, F.lit(-1 if expect_types else 0)).otherwise(0))
    for name in sorted(containers & set(by_container), key=str):
        code = code.when(F.col("container") == name, F.coalesce(by_container[name], F.lit(0)))
    if containers & {"_array", "_set", "_tuple"}:
        out = out.withColumn("n", F.when(F.col("kind").startswith("ARRAY"), F.size(F.expr("try_cast(value AS array<variant>)"))))
    else:
        out = out.withColumn("n", F.lit(None).cast("int"))
    out = out.withColumn("code", code.otherwise(F.col("code")))
    follows = F.coalesce(F.col("container").isin(*by_container), F.lit(False)) & (F.col("code") == 0)
    if levels is not None:
        size = F.coalesce("n", F.size(F.expr("try_cast(value AS map<string, variant>)")))
        out = out.withColumn("code", F.when(follows & (F.col("nest") + 1 >= levels) & (size > 0), 53).otherwise(F.col("code")))
        follows = follows & (F.col("code") == 0)
    shape = F.when(F.col("container") == "_dict", "d").when(F.col("container") == "_set", "s").otherwise("l")
    # what is no scalar of a rule has no corrections of its own
    plain = F.coalesce(F.col("container").isin("_scalar", "_set_scalar", "_dict_key"), F.lit(False)) & (F.col("code") == 0)
    out = out.withColumns({"shape": F.when(follows, shape), "change": F.when(plain, F.col("change")), "json": F.when(plain, F.col("json")).otherwise(F.to_json("value"))})
    return out.drop("fault", "ruled", "_known", "n_fields", "min_items", "max_items", "n")


def _inside(rules: DataFrame, checked: DataFrame, descriptors, types, containers) -> tuple[list[DataFrame], list[DataFrame]]:
    """What the values of one round lead to, and marks that lie between a container and its elements."""
    inner, marks = [], []
    none = F.lit(None).cast(_CHANGE).alias("change")
    if containers & {"_array", "_set", "_tuple"}:
        elements = checked.where("shape IN ('l', 's')").select("*", F.posexplode(F.expr("try_cast(value AS array<variant>)")).alias("pos", "element"))
        is_tuple = F.col("container") == "_tuple"
        typed = F.when(is_tuple, F.try_element_at("tuple_types", F.col("pos") + 1)).otherwise(F.col("descriptor"))
        path = F.when(is_tuple, F.lit("")).otherwise(F.concat("path", F.lit("/e")))
        origin = F.when(is_tuple, F.lit("tuple")).otherwise(F.lit("section"))
        at = F.concat("at", F.array("pos"))
        inner.append(_items(elements, at=at, link=F.lit("e"), origin=origin, descriptor=typed, path=path, value=F.col("element"), field=F.col("field"), top=F.col("top"), nest=F.col("nest") + 1))
    if "_tuple" in containers:
        # all types of a tuple must be descriptors, also those beyond its elements; a missing one comes before the first element
        asked = checked.where("shape = 'l' AND container = '_tuple'").select("row_id", "at", "top", F.explode(F.array_distinct("tuple_types")).alias("descriptor"))
        asked = asked.join(rules.where("path = ''").select("descriptor"), "descriptor", "left_anti")
        asked = asked.join(descriptors.select(F.col("term").alias("descriptor"), "is_descriptor"), "descriptor", "left")
        fault = F.when(F.col("is_descriptor").isNull(), 30).when(~F.col("is_descriptor"), 5).otherwise(28)
        marks.append(asked.select("row_id", "at", fault.alias("code"), "top", none))
    if "_dict" in containers:
        dicts = checked.where("shape = 'd'")
        marks.append(dicts.where("value_fault IS NOT NULL").select("row_id", F.concat("at", F.array(F.lit(1))).alias("at"), F.col("value_fault").alias("code"), "top", none))
        pairs = dicts.select("*", F.posexplode(F.map_entries(F.expr("try_cast(value AS map<string, variant>)"))).alias("pos", "e"))
        same = {"descriptor": F.col("descriptor"), "field": F.col("field"), "top": F.col("top"), "nest": F.col("nest") + 1, "origin": F.lit("section")}
        step = lambda k: F.concat("at", F.array(F.lit(k), F.col("pos")))
        inner.append(_items(pairs, at=step(0), link=F.lit("k"), path=F.concat("path", F.lit("/k")), value=F.col("e.key").cast("variant"), **same))
        inner.append(_items(pairs, at=step(1), link=F.lit("v"), path=F.concat("path", F.lit("/v")), value=F.col("e.value"), **same))
    return inner, marks


def _walk(known: _References, rules: DataFrame, starts: str, here: DataFrame, structures, descriptors, expect_terms: bool, types, containers, deepest: int, levels: int | None, options: tuple, nodes: bool) -> tuple[DataFrame, DataFrame | None]:
    """The marks of all values and objects that ``here`` leads to, and their nodes, if asked for.

    Marks are (row_id, at, code, top, change), nodes (row_id, at, link, label, shape, field, json): what stands where and how it was corrected.
    A round opens objects, then checks values, those of the objects among them. What leads further is written once a round. Without tuples and
    object types the rules say how many rounds there are; else the driver asks after each whether anything was left.
    """
    open_ended = bool(containers & {"_tuple"} or "_type_object" in types)
    further = open_ended or bool(containers - {"_scalar", None})
    marks, found = [], []
    label = F.col("field").alias("label")
    objects, values = (here, None) if starts == "objects" else (None, here)
    for level in itertools.count():
        if objects is not None:
            seen = _opened(objects, structures)
            seen = cut(dealt(seen, "row_id")) if nodes else seen
            marks.append(seen.where("code <> 0").select("row_id", "at", "code", "top", F.lit(None).cast(_CHANGE).alias("change")))
            props = seen.where("code = 0").select("row_id", "at", "top", F.posexplode(F.map_entries("props")).alias("pos", "e"))
            name = F.col("e.key")
            inner = _items(props, at=F.concat("at", F.array("pos")), link=F.lit("e"), origin=F.lit("property"), descriptor=name, value=F.col("e.value"), field=name, top=F.coalesce("top", name))
            values = inner if values is None else values.unionByName(inner)
            if nodes:
                found.append(seen.select("row_id", "at", "link", label, F.when(F.col("code") == 0, "o").alias("shape"), "field", F.to_json("value").alias("json")))
        if level or starts == "objects":
            # small tables are read and shuffled by a task or two, whatever a row costs; names and references are looked for in them, too
            values = cut(dealt(values, "row_id"))
        checked = _values(known, rules, values, descriptors, expect_terms, types, containers, levels, options)
        checked = cut(checked) if further else checked
        if open_ended and checked.isEmpty():
            break
        marks.append(checked.where("code <> 0 OR change IS NOT NULL").select(*_MARK))
        as_object = (F.col("type") == "_type_object") & F.col("kind").startswith("OBJECT") & (F.col("code") == 0)
        if nodes:
            found.append(checked.where(~F.coalesce(as_object, F.lit(False))).select("row_id", "at", "link", label, "shape", "field", "json"))
        if not further or not open_ended and level + 1 >= deepest:
            break
        inner, between = _inside(rules, checked, descriptors, types, containers)
        marks += between
        values = reduce(DataFrame.unionByName, inner) if inner else None
        objects = None
        if "_type_object" in types:
            any_kind = F.coalesce(F.array_contains("kinds", "_any-object"), F.lit(False)) | (F.size(F.coalesce("kinds", F.array().cast("array<string>"))) == 0)
            objects = _items(checked.where(as_object), at=F.col("at"), link=F.col("link"), origin=F.lit("object"), value=F.col("value"), field=F.col("field"), top=F.col("top"), kinds=F.when(~any_kind, F.col("kinds")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(marks), union(found) if nodes else None


def fold(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, json) of whole records, and (row_id, at, change) of sets that lost repeats, from the nodes of ``_walk``.

    Containers are put together again from the deepest paths up: elements in order, sets without repeats, properties by name, dictionaries
    under their corrected keys (the later of two that became equal stays). A round groups the nodes of one depth by their parents.
    """
    nodes = cut(nodes.withColumn("depth", F.size("at")))
    deepest = nodes.agg(F.max("depth")).first()[0]
    none = nodes.sparkSession.createDataFrame([], f"row_id {nodes.schema['row_id'].dataType.simpleString()}, at array<int>, change {_CHANGE}")
    if deepest is None:
        return nodes.select("row_id", "json"), none
    done, dropped = {}, []
    children = F.array_sort(F.collect_list(F.struct(F.element_at("at", -1).alias("pos"), "label", "json")))
    for depth in range(deepest, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        parent = lambda down: F.slice("at", 1, F.lit(depth)).alias("at")
        out = here
        if depth + 1 in done:
            steps = done[depth + 1].where("link = 'e'")
            out = out.join(steps.groupBy("row_id", parent(1)).agg(children.alias("below")), ["row_id", "at"], "left")
        else:
            out = out.withColumn("below", F.array().cast("array<struct<pos:int,label:string,json:string>>"))
        if depth + 2 in done:
            pairs = done[depth + 2].where("link IN ('k', 'v')").groupBy("row_id", parent(2), F.element_at("at", -1).alias("pos"))
            pairs = pairs.agg(F.max(F.when(F.col("link") == "k", F.col("json"))).alias("key"), F.max(F.when(F.col("link") == "v", F.col("json"))).alias("json"))
            kept = pairs.groupBy("row_id", "at", "key").agg(F.max_by("json", "pos").alias("json"))
            entries = kept.groupBy("row_id", "at").agg(F.array_sort(F.collect_list(F.concat("key", F.lit(":"), "json"))).alias("entries"))
            out = out.join(entries, ["row_id", "at"], "left")
        else:
            out = out.withColumn("entries", F.array().cast("array<string>"))
        out = dealt(out, "row_id", "at")
        parts = F.coalesce(F.transform("below", lambda c: c["json"]), F.array().cast("array<string>"))
        named = F.transform("below", lambda c: F.concat(F.to_json(c["label"].cast("variant")), F.lit(":"), c["json"]))
        listed = lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))
        braced = lambda x: F.concat(F.lit("{"), F.coalesce(F.array_join(x, ","), F.lit("")), F.lit("}"))
        shape = F.col("shape")
        single = F.array_distinct(parts)
        whole = F.when(shape == "l", listed(parts)).when(shape == "s", listed(single)).when(shape == "o", braced(named)).when(shape == "d", braced(F.col("entries"))).otherwise(F.col("json"))
        lost = F.when((shape == "s") & (F.size(single) < F.size(parts)), F.struct(change_hash(F.col("field"), whole).alias("hash"), "field", F.col("json").alias("original"), whole.alias("resolved")).cast(_CHANGE))
        out = cut(out.select("row_id", "at", "link", "label", whole.alias("json"), lost.alias("change")))
        done[depth] = out
        dropped.append(out.where("change IS NOT NULL").select("row_id", "at", "change"))
    return done[0].select("row_id", "json"), reduce(DataFrame.unionByName, dropped)


def _nested(d: Dictionary, rules: DataFrame, starts: str, here: DataFrame, structures, descriptors, expect_terms: bool, levels: int | None, options: tuple) -> DataFrame:
    """(row_id, first STRUCT<at, code, top>, changes, json): the verdict on each row of the worklist ``here``; ``json`` where it was corrected.

    ``here`` starts with ``values`` or ``objects``. Rules, structures and names of descriptors are joined in every round: they are written once.
    """
    rules, descriptors = cut(rules), cut(descriptors)
    structures = structures if structures is None else cut(structures)
    sections = rules.select("path", "container", "type").distinct().collect()
    containers, types = {r["container"] for r in sections}, {r["type"] for r in sections}
    deepest = 1 + max((r["path"].count("/") for r in sections), default=0)
    corrects = "_set" in containers or "_type_number_timestamp" in types or (options[0] is not None and "_type_string_enum" in types)
    known = _references(d, options[0], types).written()
    marks, nodes = _walk(known, rules, starts, here, structures, descriptors, expect_terms, types, containers, deepest, levels, options, corrects)
    marks = cut(marks) if corrects else marks
    first = F.min(F.when(F.col("code") != 0, F.struct("at", "code", "top")))
    if not corrects:
        none = F.array().cast(f"array<{_CHANGE}>")
        return marks.groupBy("row_id").agg(first.alias("first")).select("row_id", "first", none.alias("changes"), F.lit(None).cast("string").alias("json"))
    changed = marks.where("change IS NOT NULL").select("row_id")
    if "_set" in containers:
        changed = changed.unionByName(nodes.where("shape = 's'").select("row_id"))
    failed = marks.where("code <> 0").select("row_id").distinct()
    touched = cut(changed.distinct().join(failed, "row_id", "left_anti"))
    if touched.isEmpty():
        whole, dropped = touched.select("row_id", F.lit(None).cast("string").alias("json")), marks.where("false")
    else:
        whole, dropped = fold(nodes.join(touched, "row_id", "left_semi"))
    verdicts = marks.unionByName(dropped.select("row_id", "at", F.lit(0).alias("code"), F.lit(None).cast("string").alias("top"), "change"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("change").isNotNull(), F.struct("at", "change"))))
    found = verdicts.groupBy("row_id").agg(first.alias("first"), ordered.alias("changed"))
    # a record's corrections end with its first error
    before = F.filter("changed", lambda c: F.col("first").isNull() | (c["at"] < F.col("first.at")))
    out = found.select("row_id", "first", F.transform(before, lambda c: c["change"]).alias("changes"))
    return out.join(whole, "row_id", "left")


def validate(
    d: Dictionary,
    rules: DataFrame,
    rows: DataFrame,
    resolve_field: str | None = None,
    expect_types: bool = False,
    allow_default: bool = False,
    levels: int | None = None,
    structures: DataFrame | None = None,
    descriptors: DataFrame | None = None,
    expect_terms: bool = True,
) -> DataFrame:
    """V1, V2: (row_id, descriptor, code, value, resolved, changes) for each row of (row_id, descriptor, value VARIANT).

    Plain scalars are checked by a projection. Other values are followed as deep as they go, through containers, through the types of tuples and
    through objects of ``_type_object`` rules, whose kinds ``structures`` (by default the dictionary's) describe; see ``validate_objects`` for
    their properties. What lies inside is grouped again by ``row_id``, so no two such rows may share one. ``columns.status_name`` names a code.

    ``resolved`` is the corrected value as JSON, the given one if nothing changed or the code is not 0. Unknown descriptors have code 28. A type of
    a tuple that is no term has code 30, one that is no descriptor 5, one without a rule 28. With ``levels``, containers whose
    elements lie beyond have code 53. ``changes``: array of (hash, field, original, resolved), all as text, in order, up to the first error.
    """
    options = (resolve_field, expect_types, allow_default)
    # which sections and types occur decides what the plan needs; both are small closed sets
    sections = rules.select("path", "container", "type").distinct().collect()
    nested = [r for r in sections if r["path"] or r["container"] != "_scalar" or r["type"] == "_type_object"]
    types = {r["type"] for r in sections}
    if not nested:
        return _plain(d, rules, rows, types, *options)
    deep = rules.where("path = '' AND (container <> '_scalar' OR container IS NULL OR type = '_type_object')").select("descriptor").distinct()
    inside = cut(dealt(rows.join(deep, "descriptor", "left_semi").select("row_id", "descriptor", "value"), "row_id"))
    here = _items(inside, at=F.array().cast("array<int>"), link=F.lit("e"), origin=F.lit("top"), descriptor=F.col("descriptor"), value=F.col("value"), field=F.col("descriptor"))
    if descriptors is None:
        descriptors = d.terms.select(F.col("_key").alias("term"), F.col("_data").isNotNull().alias("is_descriptor"))
    found = _nested(d, rules, "values", here, _structures(d, structures), descriptors, expect_terms, levels, options)
    out = inside.join(found, "row_id", "left")
    code, given = F.coalesce("first.code", F.lit(0)), F.to_json("value")
    resolved = F.when(code == 0, F.coalesce("json", given)).otherwise(given)
    none = F.array().cast(f"array<{_CHANGE}>")
    report = out.select("row_id", "descriptor", code.alias("code"), "value", resolved.alias("resolved"), F.coalesce("changes", none).alias("changes"))
    return report.unionByName(_plain(d, rules, rows.join(deep, "descriptor", "left_anti"), types, *options))


def validate_zipped(d: Dictionary, rules: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """V6: (row_id, pos, descriptor, code, value, resolved, changes) for each pair of (row_id, descriptors, values ARRAY<VARIANT>).

    The shorter list is filled with nulls: a value without a descriptor has code 28, a missing value is checked as null.
    """
    pairs = rows.select("row_id", F.posexplode(F.arrays_zip("descriptors", "values")).alias("pos", "x"))
    flat = pairs.select(F.struct("row_id", "pos").alias("row_id"), F.col("x.descriptors").alias("descriptor"), F.col("x.values").alias("value"))
    return validate(d, rules, flat, **options).select("row_id.row_id", "row_id.pos", "descriptor", "code", "value", "resolved", "changes")


def validate_any(d: Dictionary, rules: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """V5: zipped lists, objects or values, by the columns that ``rows`` has."""
    if "descriptors" in rows.columns:
        return validate_zipped(d, rules, rows, **options)
    return (validate_objects if "object" in rows.columns else validate)(d, rules, rows, **options)


def summary(report: DataFrame, *keys: str) -> DataFrame:
    """Counters of valid rows, warnings and errors, and the worst status: -1 error, 1 change, 0 fine."""
    error, changed = F.col("code") != 0, (F.col("code") == 0) & (F.size("changes") > 0)
    counts = report.groupBy(*keys).agg(F.count_if(~error & ~changed).alias("valid"), F.count_if(changed).alias("warnings"), F.count_if(error).alias("errors"))
    return counts.withColumn("status", F.when(F.col("errors") > 0, -1).when(F.col("warnings") > 0, 1).otherwise(0))


def notable(report: DataFrame) -> DataFrame:
    """V2: only rows that failed or changed."""
    return report.where((F.col("code") != 0) | (F.size("changes") > 0))


def structure_columns(v: Column) -> list[Column]:
    get = lambda s, kind: F.try_variant_get(v, f"$._required['{s}']", kind)
    selectors = [get(s, "array<array<string>>" if n == "one_none_of" else "array<string>").alias(n) for n, s in model.SELECTORS.items()]
    return [*selectors, F.try_variant_get(v, "$._banned", "array<string>").alias("banned")]


def structure_rules(definitions: DataFrame) -> DataFrame:
    """(structure, one, one_none, any, one_none_of, all, banned) from (structure, definition VARIANT)."""
    return definitions.select("structure", *structure_columns(F.col("definition")))


def structure_holds(keys: Column) -> Column:
    """Whether an object with these property names satisfies the rule in the selector columns."""
    hits = lambda members: F.size(F.array_intersect(members, keys))
    tests = {
        "one": lambda c: hits(c) == 1,
        "one_none": lambda c: hits(c) <= 1,
        "any": lambda c: hits(c) >= 1,
        "one_none_of": lambda c: F.forall(c, lambda s: hits(s) <= 1),
        "all": lambda c: hits(c) == F.size(F.array_distinct(c)),
        "banned": lambda c: hits(c) == 0,
    }
    return reduce(Column.__and__, (F.coalesce(test(F.col(name)), F.lit(True)) for name, test in tests.items()))


def validate_objects(
    d: Dictionary,
    rules: DataFrame,
    objects: DataFrame,
    structures: DataFrame | None = None,
    descriptors: DataFrame | None = None,
    expect_terms: bool = True,
    resolve_field: str | None = None,
    expect_types: bool = False,
    allow_default: bool = False,
    levels: int | None = None,
) -> DataFrame:
    """(row_id, code, property, resolved, changes) for each row of (row_id, object VARIANT[, kinds]).

    Properties are named by descriptors. ``structures`` are rules from ``structure_rules``, by default those of the dictionary's terms; an object
    with ``kinds`` must satisfy one of them, else its code is 34. ``descriptors``: (term, is_descriptor) of names that are known terms; other
    names have code 32 with ``expect_terms`` and are passed over without, terms that are no descriptors have code 29. Values whose
    rule is ``_type_object`` are objects of the rule's kinds, or of any with none or ``_any-object``; they are checked in the same way, wherever
    and however deep they lie. ``property`` is the property of the record itself in which the first error lies. ``resolved`` is the corrected
    object as JSON, with the properties by name; the given one if nothing changed or the code is not 0.
    """
    objects = cut(dealt(objects, "row_id"))
    kinds = F.col("kinds") if "kinds" in objects.columns else F.lit(None).cast("array<string>")
    here = _items(objects, at=F.array().cast("array<int>"), link=F.lit("e"), origin=F.lit("object"), value=F.col("object"), kinds=kinds)
    if descriptors is None:
        descriptors = d.terms.select(F.col("_key").alias("term"), F.col("_data").isNotNull().alias("is_descriptor"))
    wanted = _structures(d, structures) if "kinds" in objects.columns or structures is not None or not rules.where("type = '_type_object'").isEmpty() else None
    found = _nested(d, rules, "objects", here, wanted, descriptors, expect_terms, levels, (resolve_field, expect_types, allow_default))
    out = objects.select("row_id", "object").join(found, "row_id", "left")
    code, given = F.coalesce("first.code", F.lit(0)), F.to_json("object")
    resolved = F.when(code == 0, F.coalesce("json", given)).otherwise(given)
    none = F.array().cast(f"array<{_CHANGE}>")
    return out.select("row_id", code.alias("code"), F.col("first.top").alias("property"), resolved.alias("resolved"), F.coalesce("changes", none).alias("changes"))


def edge_keys(edges: DataFrame) -> DataFrame:
    """(…, code): 43 where an edge's key is not the digest of its ends and predicate; a missing key is filled in."""
    right = F.md5(F.concat_ws("/", "from", "predicate", "to"))
    return edges.withColumn("code", F.when(F.col("edge_key").isNotNull() & (F.col("edge_key") != right), 43).otherwise(0)).withColumn("edge_key", F.coalesce("edge_key", right))
