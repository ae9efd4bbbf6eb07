"""What a new version of a dictionary may not do to the old one (U1-U14): updates may only relax terms.

One job joins both versions by key; every check is an expression over both versions, and the first violation of a term is reported.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria import model
from glossaria.operators.validate import container_of, section_of, structure_columns


def _first(*tests: tuple[Column, str]) -> Column:
    """The name of the first test that holds; null tests do not."""
    return F.coalesce(*[F.when(t, F.lit(name)) for t, name in tests])


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _code_tests(o: Column, n: Column) -> list[tuple[Column, str]]:
    changed = reduce(Column.__or__, (~o["_code"][f].eqNullSafe(n["_code"][f]) for f in ("_nid", "_lid", "_gid")))
    return [
        (o["_code"].isNotNull() & n["_code"].isNull(), "code section removed"),
        (o["_code"].isNull() & n["_code"].isNotNull(), "code section added"),
        (changed, "identifier changed"),
        (~F.coalesce(F.array_contains(n["_code"]["_aid"], n["_code"]["_lid"]), F.lit(False)), "local identifier missing from official ones"),
        (o["_data"].isNotNull() & n["_data"].isNull(), "data section removed"),
        (o["_rule"].isNull() & n["_rule"].isNotNull(), "rule section added"),
    ]


def _terms_in_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_key, o, n): both versions of each term."""
    side = lambda t, name: t.select("_key", F.struct("_key", "_code", "_data", "_rule").alias(name))
    return side(old, "o").join(side(new, "n"), "_key", "full")


def _presence_tests() -> list[tuple[Column, str]]:
    return [(F.col("n._key").isNull(), "term removed"), (F.col("o._key").isNull(), "term added")]


def code_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_key, violation) over whole terms: keys, code sections, identifiers, data and rule sections."""
    violation = _first(*_presence_tests(), *_code_tests(F.col("o"), F.col("n")))
    return _terms_in_pairs(old, new).select("_key", violation.alias("violation")).where("violation is not null")


def range_tests(name: str, old: Column | None = None, new: Column | None = None) -> list[tuple[Column, str]]:
    """Bounds may be removed or widened; an inclusive bound may turn exclusive only where that admits no less."""
    side = lambda v, s: (lambda b: F.col(f"{s}.{name}_{b}") if v is None else v[f"{name}_{b}"])
    o, n = side(old, "o"), side(new, "n")
    had_low = o("min_inc").isNotNull() | o("min_exc").isNotNull()
    had_high = o("max_inc").isNotNull() | o("max_exc").isNotNull()
    low = (n("min_inc") > o("min_inc")) | (n("min_exc") >= o("min_inc")) | (n("min_exc") > o("min_exc")) | (n("min_inc") > o("min_exc"))
    high = (n("max_inc") < o("max_inc")) | (n("max_exc") <= o("max_inc")) | (n("max_exc") < o("max_exc")) | (n("max_inc") < o("max_exc"))
    has_low, has_high = n("min_inc").isNotNull() | n("min_exc").isNotNull(), n("max_inc").isNotNull() | n("max_exc").isNotNull()
    return [(has_low & ~had_low | has_high & ~had_high, f"{name} range added"), (low, f"{name} lower bound raised"), (high, f"{name} upper bound lowered")]


def _rule_tests(o: Callable[[str], Column], n: Callable[[str], Column], ranges: list[tuple[Column, str]]) -> list[tuple[Column, str]]:
    return [
        (~o("container").eqNullSafe(n("container")), "nesting changed"),
        (~o("type").eqNullSafe(n("type")), "type changed"),
        (~o("regexp").eqNullSafe(n("regexp")), "regexp changed"),
        (o("kinds").isNull() & n("kinds").isNotNull(), "kinds added"),
        (F.size(F.array_except(o("kinds"), n("kinds"))) > 0, "kind lost"),
        *ranges,
        (o("min_items").isNull() & n("min_items").isNotNull() | o("max_items").isNull() & n("max_items").isNotNull(), "element limit added"),
        (n("min_items") > o("min_items"), "minimum elements raised"),
        (n("max_items") < o("max_items"), "maximum elements lowered"),
        (~o("tuple_types").eqNullSafe(n("tuple_types")), "tuple types changed"),
    ]


def rule_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(descriptor, violation) over rules from ``descriptor_rules``, outermost section first."""
    both = old.alias("o").join(new.alias("n"), (F.col("o.descriptor") == F.col("n.descriptor")) & (F.col("o.path") == F.col("n.path")), "full")
    had, has = old.select("descriptor").distinct(), new.select("descriptor").distinct()
    same = had.join(has, "descriptor")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    alone = (n("descriptor").isNull() | o("descriptor").isNull(), "nesting changed")
    violation = _first(alone, *_rule_tests(o, n, [t for name in model.RANGES for t in range_tests(name)]))
    rows = both.select(F.coalesce(o("descriptor"), n("descriptor")).alias("descriptor"), F.coalesce(o("path"), n("path")).alias("path"), violation.alias("violation"))
    rows = rows.where("violation is not null").join(same, "descriptor", "left_semi")
    return rows.groupBy("descriptor").agg(F.min_by("violation", F.struct(F.length("path"), "path")).alias("violation"))


def _structure_tests(old: Callable[[str], Column], new: Callable[[str], Column]) -> list[tuple[Column, str]]:
    tests = []
    for s in model.SELECTORS:
        o, n = old(s), new(s)
        tests.append((o.isNull() & n.isNotNull(), f"selector {s} added"))
        if s == "one_none_of":
            tests.append((F.size(F.array_except(F.flatten(o), F.flatten(n))) > 0, f"selector {s} lost a member"))
        else:
            tests.append((F.size(F.array_distinct(n)) < F.size(F.array_distinct(o)), f"selector {s} has fewer options"))
    banned_o, banned_n = old("banned"), new("banned")
    return [*tests, (banned_o.isNull() & banned_n.isNotNull(), "banned list added"), (F.size(F.array_except(banned_n, banned_o)) > 0, "banned list extended")]


def structure_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(structure, violation) over rules from ``structure_rules``."""
    both = old.alias("o").join(new.alias("n"), F.col("o.structure") == F.col("n.structure"))
    violation = _first(*_structure_tests(lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")))
    return both.select(F.col("o.structure").alias("structure"), violation.alias("violation")).where("violation is not null")


def _section_violation(o: Column, n: Column) -> Column:
    """The first test that two sections with their rules fail."""
    return _first(*_rule_tests(lambda c: o[c], lambda c: n[c], [t for name in model.RANGES for t in range_tests(name, o, n)]))


_NAMES = ("_type", "_type_key", "_set_type", "_kind", "_regexp", *(section for section, _ in model.RANGES.values()), "_elements", "_tuple_types")
_PARTS = "struct<" + ", ".join(f"`{name}` variant" for name in _NAMES) + ">"


def _inside(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _opened(container: Column, s: Column, parts: Column, role: Column) -> Column:
    """A section with its kind and its columns in ``descriptor_rules``, from its ``parts``, which are read at once."""
    get = lambda name, kind: F.try_variant_get(parts[name], "$", kind)
    type_ = F.when(role == "_dict_key", get("_type_key", "string")).when(role == "_set_scalar", get("_set_type", "string")).otherwise(get("_type", "string"))
    out = [container.alias("container"), s.alias("s"), type_.alias("type"), get("_kind", "array<string>").alias("kinds"), get("_regexp", "string").alias("regexp")]
    for name, (section, suffix) in model.RANGES.items():
        kind = "double" if name == "num" else "string"
        out += [F.try_variant_get(parts[section], f"$['{field}{suffix}']", kind).alias(f"{name}_{b}") for b, field in model.BOUNDS.items()]
    out += [F.try_variant_get(parts["_elements"], f"$['{f}']", "long").alias(c) for f, c in (("_min-items", "min_items"), ("_max-items", "max_items"))]
    return F.struct(*out, get("_tuple_types", "array<string>").alias("tuple_types"))


def _state(o: Column, n: Column, role: Column, key_o: Column, key_n: Column, found: Column) -> Column:
    """Where a comparison of two definitions has come to: sections to compare, keys of dictionaries to compare before them, the violation."""
    return F.struct(o.alias("o"), n.alias("n"), role.alias("role"), key_o.alias("key_o"), key_n.alias("key_n"), found.alias("found"))


def _beyond(o: Column, n: Column, found: Column) -> Column:
    """The state after two opened sections are compared: at those inside."""

    def below(side: Column) -> Column:
        kind = side["container"]
        return F.when(kind == "_array", side["s"]).when(kind == "_set", _inside(side["s"], "_set_scalar")).when(kind == "_dict", _inside(side["s"], "_dict_value"))

    keys_of = lambda side: F.when(side["container"] == "_dict", _inside(side["s"], "_dict_key"))
    role = F.when(o["container"] == "_set", "_set_scalar").otherwise("data")
    return _state(below(o), below(n), role, keys_of(o), keys_of(n), found)


def _outer_level(rows: DataFrame) -> DataFrame:
    """``_walk`` one level further, in plain columns, which is faster than ``_walked``; dictionaries' keys are left to that."""
    x = F.col("_walk")
    here = x["found"].isNull() & x["key_o"].isNull() & x["key_n"].isNull() & x["o"].isNotNull() & x["n"].isNotNull()
    rows = rows.withColumn("_here", here)
    of = lambda side, f: F.when(F.col("_here"), f(x[side], x["role"]))
    rows = rows.withColumns({f"_{k}{side}": of(side, f) for side in "on" for k, f in (("c", container_of), ("s", section_of))})
    rows = rows.withColumns({f"_p{side}": F.try_variant_get(f"_s{side}", "$", _PARTS) for side in "on"})
    rows = rows.withColumns({f"_r{side}": _opened(F.col(f"_c{side}"), F.col(f"_s{side}"), F.col(f"_p{side}"), x["role"]) for side in "on"})
    o, n = F.col("_ro"), F.col("_rn")
    return rows.withColumn("_walk", F.when(F.col("_here"), _beyond(o, n, _section_violation(o, n))).otherwise(x)).drop("_here", *(f"_{k}{side}" for k in "cspr" for side in "on"))


def _walked(start: Column, steps: Column) -> Column:
    """The violation in the outermost section that has one, as by ``rule_violations``, from a ``_state`` on.

    Each step compares a section of both and goes on to the one inside; the keys of a dictionary come before its values and hold no more sections.
    """
    opened = lambda v, role: _let(section_of(v, role), lambda s: _let(F.try_variant_get(s, "$", _PARTS), lambda p: _opened(container_of(v, role), s, p, role)))
    both = lambda v, w, role: F.struct(opened(v, role).alias("o"), opened(w, role).alias("n"))
    alone = lambda v, w: F.when(v.isNull() != w.isNull(), "nesting changed")
    nothing, key = F.lit(None).cast("variant"), F.lit("_dict_key")

    def step(x: Column, _: Column) -> Column:
        keys = F.when(x["key_o"].isNotNull() & x["key_n"].isNotNull(), _let(both(x["key_o"], x["key_n"], key), lambda s: _section_violation(s["o"], s["n"])))
        before = F.coalesce(alone(x["key_o"], x["key_n"]), keys, alone(x["o"], x["n"]))
        compared = _let(both(x["o"], x["n"], x["role"]), lambda s: _beyond(s["o"], s["n"], F.coalesce(before, _section_violation(s["o"], s["n"]))))
        here = F.when(x["o"].isNotNull() & x["n"].isNotNull(), compared).otherwise(_state(nothing, nothing, F.lit("data"), nothing, nothing, before))
        return F.when(_to_go(x), here).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda x: x["found"])


def _to_go(x: Column) -> Column:
    return x["found"].isNull() & F.coalesce(x["o"], x["n"], x["key_o"], x["key_n"]).isNotNull()


def first_violations(pairs: DataFrame, levels: int | None = None, touched: Column | None = None) -> DataFrame:
    """``pairs`` with ``violation``, the first of the version ``n`` of a term against the older ``o``, code before data before rule.

    ``o`` and ``n`` are structs of the sections of terms, and nothing is joined. Data that are not ``touched`` are the same in both and are spared the look.
    """
    o, n, x = F.col("o"), F.col("n"), F.col("_walk")
    pairs = pairs.withColumn("violation", _first(*_code_tests(o, n)))
    look = F.col("violation").isNull() & o["_data"].isNotNull() & n["_data"].isNotNull() & (F.lit(True) if touched is None else touched)
    nothing = F.lit(None).cast("variant")
    rows = pairs.withColumn("_walk", _state(F.when(look, o["_data"]), F.when(look, n["_data"]), F.lit("data"), nothing, nothing, F.lit(None).cast("string")))
    if levels:
        steps = F.lit(levels)
    else:
        rows = _outer_level(_outer_level(rows))
        # a section inside takes a container's name, so there are no more steps than names
        steps = F.regexp_count(F.to_json(o["_data"]), F.lit('"_(array|set|dict)"')) + F.lit(2)
    rows = rows.withColumn("_inner", F.when(_to_go(x), _walked(x, steps)).otherwise(x["found"]))
    structure = lambda v: F.struct(*structure_columns(v))
    rules = _let(F.struct(structure(o["_rule"]).alias("o"), structure(n["_rule"]).alias("n")), lambda s: _first(*_structure_tests(lambda c: s["o"][c], lambda c: s["n"][c])))
    rule = F.when(o["_rule"].isNotNull() & n["_rule"].isNotNull(), rules)
    return rows.withColumn("violation", F.coalesce("violation", "_inner", rule)).drop("_walk", "_inner")


def diff_terms(old: DataFrame, new: DataFrame, levels: int | None = None) -> DataFrame:
    """(_key, violation): the first violation of each term, code before data before rule; ``levels`` as in ``descriptor_rules``."""
    rows = first_violations(_terms_in_pairs(old, new), levels).select("_key", F.coalesce(_first(*_presence_tests()), "violation").alias("violation"))
    return rows.where("violation is not null").groupBy("_key").agg(F.min("violation").alias("violation"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(_key, path, change) over documents as maps of leaf paths (_key, doc): added, deleted, modified or same."""
    leaves = lambda t, v: t.select("_key", F.explode("doc").alias("path", v))
    both = leaves(old, "before").join(leaves(new, "after"), ["_key", "path"], "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") != F.col("after"), "modified").otherwise("same")
    return both.select("_key", "path", kind.alias("change"))
