"""Lookups by root and predicate, and membership of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import handle_collection, handle_key, language_text
from glossaria.plans.dictionary import Dictionary


def functional_edges(d: Dictionary, requests: DataFrame) -> DataFrame:
    """the edges of a root with a predicate. ``requests``: (request_id, root, predicate)."""
    return d.edge_path.join(requests, ["root", "predicate"]).select("request_id", "root", "edge_key", "from", "predicate", "to")


def functional_handles(d: Dictionary, requests: DataFrame, many_to_one: bool = True) -> DataFrame:
    """the ends of those edges that face away from the root, once each."""
    end = "from" if many_to_one else "to"
    return functional_edges(d, requests).select("request_id", F.col(end).alias("handle")).distinct()


def with_terms(d: Dictionary, handles: DataFrame, handle: str = "handle") -> DataFrame:
    """Add the term of each handle, null where there is none."""
    terms = d.terms.select(F.concat(F.lit("terms/"), "_key").alias(handle), F.struct("*").alias("term"))
    return handles.join(terms, handle, "left")


def functional_terms(d: Dictionary, requests: DataFrame, many_to_one: bool = True, language: str | None = None) -> DataFrame:
    """the terms of the functional nodes; with ``language``, also the title in it."""
    out = with_terms(d, functional_handles(d, requests, many_to_one))
    return out if language is None else out.withColumn("title", language_text(F.col("term._info._title"), language))


def enumeration_keys(d: Dictionary, roots: DataFrame, predicate: str = model.ENUM_OF) -> DataFrame:
    """Keys of all elements of each root. ``roots``: (request_id, root)."""
    handles = functional_handles(d, roots.withColumn("predicate", F.lit(predicate)))
    return handles.select("request_id", handle_key(F.col("handle")).alias("key"))


def edges_by_key(d: Dictionary, keys: DataFrame) -> DataFrame:
    """the edges of a list of keys. ``keys``: (edge_key)."""
    return d.edges.join(keys.select("edge_key").distinct(), "edge_key", "left_semi")


def terms_by_code(d: Dictionary, requests: DataFrame) -> DataFrame:
    """(request_id, key) of terms with a code in a field. ``requests``: (request_id, field, code)."""
    return requests.join(d.term_codes, ["field", "code"]).select("request_id", "key").distinct()


def check_enum_keys(d: Dictionary, requests: DataFrame) -> DataFrame:
    """(request_id, key, matched): the element, false as null, that an enumeration has for a key.

    ``requests``: (request_id, root, key). The key may stand at either end of an enumeration edge of the root; the element is
    the edge's ``from`` end. Two equi-joins stand in for the disjunction; of several edges the least key wins.
    """
    enum = d.edge_path.where(F.col("predicate") == model.ENUM_OF)
    ends = enum.select("root", "edge_key", "from", F.col("from").alias("handle")).unionByName(enum.select("root", "edge_key", "from", F.col("to").alias("handle")))
    asked = requests.withColumn("handle", F.concat(F.lit("terms/"), "key"))
    found = asked.join(ends, ["root", "handle"]).groupBy("request_id", "key").agg(F.min_by("from", "edge_key").alias("from"))
    return requests.select("request_id", "key").join(found, ["request_id", "key"], "left").select("request_id", "key", handle_key(F.col("from")).alias("matched"))


def check_enum_codes(d: Dictionary, requests: DataFrame, first: bool = False) -> DataFrame:
    """(request_id, code, matched) with all elements of the enumeration that have the code, empty if none.

    ``requests``: (request_id, root, field, code). With ``first``, ``matched`` is the least of them or null.
    """
    found = requests.join(d.term_codes, ["field", "code"]).join(
        d.enum_members.select(F.col("term").alias("key"), F.concat(F.lit("terms/"), "root").alias("root")), ["root", "key"]
    )
    found = found.groupBy("request_id", "code").agg(F.array_sort(F.collect_set(F.concat(F.lit("terms/"), "key"))).alias("matched"))
    out = requests.select("request_id", "code").join(found, ["request_id", "code"], "left")
    empty = F.coalesce("matched", F.array().cast("array<string>"))
    return out.withColumn("matched", F.try_element_at(empty, F.lit(1)) if first else empty)


def enum_keys_by_code(d: Dictionary, requests: DataFrame) -> DataFrame:
    """I4: (request_id, key) of enumeration elements by field, code and root. ``requests``: (request_id, field, code, root)."""
    members = d.enum_members.select(F.col("term").alias("key"), F.concat(F.lit("terms/"), "root").alias("root"))
    hits = requests.join(d.term_codes, ["field", "code"])
    return hits.join(members, ["key", "root"], "left_semi").select("request_id", "key").distinct()


def enum_terms_by_code(d: Dictionary, requests: DataFrame) -> DataFrame:
    """The terms of ``enum_keys_by_code``."""
    return enum_keys_by_code(d, requests).join(d.terms.withColumnRenamed("_key", "key"), "key")


def lookup(d: Dictionary, keys: DataFrame, descriptors: bool = False) -> DataFrame:
    """(key, found, _data, _rule, roots) for each requested key; with ``descriptors``, other terms count as missing."""
    roots = d.enum_members.groupBy(F.col("term").alias("key")).agg(F.array_sort(F.collect_set("root")).alias("roots"))
    terms = d.terms.select(F.col("_key").alias("key"), "_data", "_rule", F.lit(True).alias("hit"))
    terms = terms.where(F.col("_data").isNotNull()) if descriptors else terms
    out = keys.select("key").join(terms, "key", "left").join(roots, "key", "left")
    return out.select("key", F.coalesce("hit", F.lit(False)).alias("found"), "_data", "_rule", F.when(F.col("hit"), F.coalesce("roots", F.array().cast("array<string>"))).alias("roots"))


def documents_exist(d: Dictionary, handles: DataFrame) -> DataFrame:
    """(handle, collection_exists, document_exists) for each requested handle."""
    known = d.terms.select(F.concat(F.lit("terms/"), "_key").alias("handle"))
    known = known.unionByName(d.edges.select(F.concat(F.lit("edges/"), "edge_key").alias("handle")))
    if d.links is not None:
        known = known.unionByName(d.links.select(F.concat(F.lit("links/"), "edge_key").alias("handle")))
    out = handles.select("handle").join(known.withColumn("hit", F.lit(True)), "handle", "left")
    return out.select("handle", handle_collection(F.col("handle")).isin(*model.COLLECTIONS).alias("collection_exists"), F.coalesce("hit", F.lit(False)).alias("document_exists"))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in a total order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")
