"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaria import model

KEY_PATTERN = r"^[a-zA-Z0-9\-.@+,=;$!*'%()_]{1,254}$"
COLLECTION_PATTERN = r"^[a-zA-Z0-9\-_]{1,128}$"


def edge_key(from_: Column, predicate: Column, to: Column) -> Column:
    """md5 of subject, predicate and object joined by slashes."""
    return F.md5(F.concat_ws("/", from_, predicate, to))


def handle_key(handle: Column) -> Column:
    """The key of a ``collection/key`` handle; an empty string where there is no slash."""
    return F.split_part(handle, F.lit("/"), F.lit(2))


def handle_collection(handle: Column) -> Column:
    return F.split_part(handle, F.lit("/"), F.lit(1))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits; no stemming."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))


def language_text(texts: Column, language: str) -> Column:
    """The text of a language map in one language, null where it has none."""
    return F.try_element_at(texts, F.lit(language))


def wildcard(value: Column, pattern: str) -> Column:
    """``pattern`` with ``%``, ``_`` and backslash escapes against the value or any of its tokens, case aside."""
    pattern = pattern.lower()
    return F.lower(value).like(pattern) | F.exists(tokens(value), lambda t: t.like(pattern))


def valid_key(value: Column) -> Column:
    return F.coalesce(value.rlike(KEY_PATTERN), F.lit(False))


def valid_collection(value: Column) -> Column:
    return F.coalesce(value.rlike(COLLECTION_PATTERN), F.lit(False))


def in_range(value: Column, bounds: dict[str, Column]) -> Column:
    """0, 12 below the range, 13 above it; null bounds are open."""
    low = (value < bounds["min_inc"]) | (value <= bounds["min_exc"])
    high = (value > bounds["max_inc"]) | (value >= bounds["max_exc"])
    return F.when(low, 12).when(high, 13).otherwise(0)


def status_name(code: Column) -> Column:
    """The name of a status code."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in model.STATUS.items() for x in pair]), code)


def default_codes(nid: Column, lid: Column, aid: Column) -> dict[str, Column]:
    """Global id, key and official ids of a term (T3): an empty namespace still gets its separator, a missing one does not."""
    gid = F.when(nid.isNull(), lid).otherwise(F.concat(nid, F.lit("_"), lid))
    return {"_gid": gid, "_key": gid, "_aid": F.array_union(F.coalesce(aid, F.array().cast("array<string>")), F.array(lid))}


def change_hash(field: Column, resolved: Column) -> Column:
    """The name of a logged change."""
    return F.md5(F.concat_ws("\t", field, resolved))


def merged(old: Column, new: Column) -> Column:
    """Merge maps of leaf paths (W12, T14): a null value removes a path and all below it, others replace."""
    old = F.coalesce(old, F.create_map().cast("map<string,string>"))
    paths = F.map_keys(new)
    kept = F.map_filter(old, lambda k, v: ~F.exists(paths, lambda p: (k == p) | k.startswith(F.concat(p, F.lit("."))) | p.startswith(F.concat(k, F.lit(".")))))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, F.map_filter(new, lambda k, v: v.isNotNull())))


def same_map(a: Column, b: Column) -> Column:
    order = lambda m: F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return order(a) == order(b)


def is_empty_object(value: Column) -> Column:
    """Whether a VARIANT is an object without properties; false for all else, null included."""
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.coalesce(is_object & (F.size(F.try_variant_get(value, "$", "map<string,variant>")) == 0), F.lit(False))
