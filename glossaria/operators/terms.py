"""Terms: codes, search, lookup, edits (T1-T17), and descriptors by qualifier (Q1-Q5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import default_codes, language_text, merged, same_map, tokens, wildcard


def derive_codes(terms: DataFrame) -> DataFrame:
    """Fill ``_gid``, ``_key`` and ``_aid`` from the namespace and local identifier."""
    new = default_codes(F.col("_code._nid"), F.col("_code._lid"), F.col("_code._aid"))
    return terms.withColumn("_code", F.col("_code").withField("_gid", new["_gid"]).withField("_aid", new["_aid"])).withColumn("_key", new["_key"])


def plan_inserts(terms: DataFrame, new: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """The new terms with codes filled in and an ``action``: inserted, conflict or invalid.

    ``reports``: (_key, code) of a validation. Inserting is all or nothing: write only if no row is a conflict or invalid.
    """
    rows = derive_codes(new)
    twice = rows.groupBy("_key").count().where("count > 1").select("_key")
    taken = terms.select("_key").unionByName(twice).distinct().withColumn("taken", F.lit(True))
    out = rows.join(taken, "_key", "left")
    bad = F.lit(False)
    if reports is not None:
        out = out.join(reports.where("code <> 0").select("_key").distinct().withColumn("bad", F.lit(True)), "_key", "left")
        bad = F.coalesce("bad", F.lit(False))
    action = F.when(F.coalesce("taken", F.lit(False)), "conflict").when(bad, "invalid").otherwise("inserted")
    return out.withColumn("action", action).drop("taken", "bad")


def plan_deletes(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """T4, T5: (_key, action) for each requested key: removed or ignored."""
    known = terms.select("_key", F.lit(True).alias("hit"))
    return keys.select("_key").distinct().join(known, "_key", "left").select("_key", F.when(F.col("hit"), "removed").otherwise("ignored").alias("action"))


def get_terms(terms: DataFrame, keys: DataFrame, language: str | None = None) -> DataFrame:
    """One row for each requested key, the term or nulls; ``language`` as in ``project_language``."""
    out = keys.select("_key").join(terms, "_key", "left")
    return out if language is None else project_language(out, language)


def project_language(terms: DataFrame, language: str) -> DataFrame:
    """Add ``<field>_text`` for each information field; ``@`` leaves the maps alone."""
    if language == "@":
        return terms
    return terms.withColumns({f"{f.strip('_')}_text": language_text(F.col(f"_info.{f}"), language) for f in model.INFO_FIELDS})


def selection(
    term_type: str | None = None,
    aid: list[str] | None = None,
    language: str = model.LANGUAGE,
    every: bool = False,
    **fields: str,
) -> Column:
    """One predicate over terms from a search form; clauses are joined by AND, and no clause accepts all terms.

    ``_nid``, ``_lid``, ``_gid``, ``_name`` and ``_pid`` take a pattern with wildcards, ``aid`` any of the official codes, ``_provider`` and the
    information fields words, any of which must occur, or with ``every`` all.
    """
    clauses = []
    if term_type:
        clauses.append(F.col({"descriptor": "_data", "structure": "_rule"}[term_type]).isNotNull())
    if aid:
        clauses.append(F.arrays_overlap(F.col("_code._aid"), F.array(*map(F.lit, aid))))
    for name, value in fields.items():
        if name == "_pid":
            clauses.append(F.exists(F.col("_code._pid"), lambda p, v=value: wildcard(p, v)))
        elif name in ("_nid", "_lid", "_gid", "_name"):
            clauses.append(wildcard(F.col(f"_code.{name}"), value))
        elif name in (*model.INFO_FIELDS, "_provider"):
            text = F.col("_info._provider") if name == "_provider" else language_text(F.col(f"_info.{name}"), language)
            wanted = tokens(F.lit(value))
            clauses.append(F.size(F.array_except(wanted, tokens(text))) == 0 if every else F.arrays_overlap(tokens(text), wanted))
        else:
            raise ValueError(f"unknown search field {name}")
    return reduce(Column.__and__, (F.coalesce(c, F.lit(False)) for c in clauses), F.lit(True))


def for_client(documents: DataFrame) -> DataFrame:
    """Documents without the columns that only a store has use for."""
    return documents.drop("_id", "_rev", "_oldRev")


def search(terms: DataFrame, where: Column, start: int = 0, limit: int = 25) -> DataFrame:
    """A page of the terms that satisfy a selection, by key; select the key or project a language as needed."""
    return terms.where(where).orderBy("_key").offset(start).limit(limit)


def plain_selection(
    sections: list[str] | None = None,
    aid: list[str] | None = None,
    scalar_types: list[str] | None = None,
    scalar_kinds: list[str] | None = None,
    title: str | None = None,
    definition: str | None = None,
    language: str = model.LANGUAGE,
    **codes: str,
) -> Column:
    """The older search form: patterns on whole values, no words, and filters on the data section."""
    clauses = [F.col(s).isNotNull() if s in ("_data", "_rule") else F.variant_get("_data", f"$.{s}", "variant").isNotNull() for s in sections or ()]
    if aid:
        clauses.append(F.arrays_overlap(F.col("_code._aid"), F.array(*map(F.lit, aid))))
    for name, pattern in codes.items():
        value = F.col(f"_code.{name}")
        clauses.append(F.exists(value, lambda p, v=pattern: p.like(v)) if name in ("_pid",) else value.like(pattern))
    for field, pattern in (("_title", title), ("_definition", definition)):
        if pattern is not None:
            clauses.append(language_text(F.col(f"_info.{field}"), language).like(pattern))
    if scalar_types:
        clauses.append(F.try_variant_get("_data", "$._scalar._type", "string").isin(scalar_types))
    if scalar_kinds:
        clauses.append(F.arrays_overlap(F.try_variant_get("_data", "$._scalar._kind", "array<string>"), F.array(*map(F.lit, scalar_kinds))))
    return reduce(Column.__and__, (F.coalesce(c, F.lit(False)) for c in clauses), F.lit(True))


def merge_updates(leaves: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply path patches to documents held as maps of leaf paths (``updates.merged_document``: to nested documents).

    ``leaves``: (_key, doc map<string,string>); ``patches``: (_key, path, value), a null value removing the path and all below it. The
    result has ``doc``, merged, and ``changed``. Patches to unknown keys have no effect.
    """
    new = patches.groupBy("_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("patch"))
    out = leaves.join(new, "_key", "left").withColumn("after", merged(F.col("doc"), F.col("patch")))
    return out.select("_key", F.col("after").alias("doc"), (~same_map(F.col("doc"), F.col("after"))).alias("changed"))


def has_language(info: Column, language: str = model.LANGUAGE) -> Column:
    """Every information text that is given has the default language."""
    return reduce(Column.__and__, (info[f].isNull() | F.coalesce(F.map_contains_key(info[f], language), F.lit(True)) for f in model.INFO_FIELDS))


def qualifiers(terms: DataFrame) -> DataFrame:
    """(key, _subject, _class, _list, _domain, _tag) of all descriptors."""
    one = [F.try_variant_get("_data", f"$.{f}", "string").alias(f) for f in ("_subject", "_class", "_list")]
    many = [F.try_variant_get("_data", f"$.{f}", "array<string>").alias(f) for f in ("_domain", "_tag")]
    return terms.where(F.col("_data").isNotNull()).select(F.col("_key").alias("key"), *one, *many)


def qualification_summary(qualified: DataFrame, requests: DataFrame) -> DataFrame:
    """Q1: distinct subjects, classes, domains and tags of each request's descriptors. ``requests``: (request_id, key)."""
    rows = requests.join(qualified, "key")
    many = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(a) for c, a in (("_domain", "domains"), ("_tag", "tags"))]
    return rows.groupBy("request_id").agg(F.array_sort(F.collect_set("_subject")).alias("subjects"), F.array_sort(F.collect_set("_class")).alias("classes"), *many)


def qualifier_selection(op: str = "AND", **values: list[str]) -> Column:
    """Q4: any value in common for each qualifier given, joined by ``op``; no qualifier accepts nothing."""
    clauses = []
    for name, wanted in values.items():
        column = F.col(name)
        clauses.append(F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, wanted))) if name in ("_domain", "_tag") else column.isin(wanted), F.lit(False)))
    if not clauses:
        return F.lit(False)
    return reduce(Column.__and__ if op == "AND" else Column.__or__, clauses)


def query_descriptors(qualified: DataFrame, where: Column, start: int = 0, limit: int = 25) -> DataFrame:
    """Q2, Q3: a page of descriptors by key."""
    return qualified.where(where).orderBy("key").offset(start).limit(limit)


def enum_kinds(rules: DataFrame) -> DataFrame:
    """Q5: (descriptor, kinds): the enumerations of a descriptor, through its arrays and sets; none where its scalar is no enumeration.

    ``rules`` as from ``descriptor_rules``; a dictionary or tuple has no enumeration of its own.
    """
    leaf = rules.where((F.col("type") == "_type_string_enum") & F.col("container").isin("_scalar", "_set_scalar") & F.col("path").rlike("^(/e)*$"))
    kinds = leaf.select("descriptor", "kinds")
    return rules.select("descriptor").distinct().join(kinds, "descriptor", "left").select("descriptor", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
