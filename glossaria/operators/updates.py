"""Updates of documents at listed paths (T13-T15): merge, compare with the old version, validate, plan the replacement."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import valid_key
from glossaria.operators.evolve import first_violations
from glossaria.operators.terms import derive_codes, has_language, plan_inserts
from glossaria.operators.validate import validate_objects
from glossaria.plans.cut import cut, dealt
from glossaria.plans.dictionary import Dictionary

_MERGED = "doc string, error string"
_MISSING = object()


def value_at(document: Column, path: Column) -> Column:
    """The VARIANT at a path such as ``_data._array[2]._kind`` of a VARIANT, null where there is none."""
    return F.try_variant_get(document, F.concat(F.lit("$."), path), "variant")


@lru_cache(4096)
def _steps(path: str) -> list[str | int]:
    return [int(index) if index else name for index, name in re.findall(r"\[(\d+)\]|([^.\[\]]+)", path)]


def _child(node, step):
    if isinstance(step, int):
        return node[step] if isinstance(node, list) and step < len(node) else _MISSING
    return node.get(step, _MISSING) if isinstance(node, dict) else _MISSING


def _put(node, new, steps: list, remove: bool, strict: bool) -> None:
    """Set or remove the value at ``steps``; where the document ends earlier, the whole of ``new`` below is taken."""
    step, rest = steps[0], steps[1:]
    if not isinstance(node, list if isinstance(step, int) else dict):
        if strict and not remove:
            raise ValueError("the document has another shape")
        return
    known = _child(node, step) is not _MISSING
    if known and rest:
        _put(node[step], new[step], rest, remove, strict)
    elif remove:
        if known:
            del node[step]
    elif isinstance(step, int) and not known:
        if strict and step > len(node):
            raise ValueError("the index lies beyond the end")
        node.extend([None] * (step - len(node)) + [copy.deepcopy(new[step])])
    else:
        node[step] = copy.deepcopy(new[step])


def _change(doc, updates: str, references: list[str], strict: bool) -> str | None:
    """Put the values into ``doc``; the error, after which ``doc`` may be half changed."""
    new = json.loads(updates)
    for path in references:
        steps, value = _steps(path), new
        for step in steps:
            value = _child(value, step)
        if not steps or value is _MISSING:
            return f"{path}: no such value in the updates"
        try:
            _put(doc, new, steps, value is None, strict)
        except ValueError as e:
            return f"{path}: {e}"
    return None


def _merge(doc: str, updates: str, references: list[str], strict: bool) -> tuple[str | None, str | None]:
    merged = json.loads(doc)
    error = _change(merged, updates, references, strict)
    return (None, error) if error else (json.dumps(merged, ensure_ascii=False), None)


def merged_document(doc: Column, updates: Column, references: Column, strict: bool = False) -> Column:
    """STRUCT<doc, error>: the JSON ``doc`` with the values that ``references`` name taken from the JSON ``updates``.

    A value null in ``updates`` removes the path; in an array the elements behind move up. A path that ``updates`` lacks is an error, and
    with ``strict`` also one that the document's shape contradicts; other such paths are passed over. Null inputs give nulls.
    """

    @F.pandas_udf(_MERGED)
    def merge(docs: pd.Series, news: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if d is None or n is None or p is None else _merge(d, n, list(p), strict) for d, n, p in zip(docs, news, paths)]
        return pd.DataFrame(rows, columns=["doc", "error"], dtype=object)

    return merge(doc, updates, references)


def term_codes_of(terms: DataFrame, language: str = model.LANGUAGE) -> DataFrame:
    """V4: (_key, code) of all terms: 23 for a key of other characters, 42 for an information text without the default language."""
    code = F.when(~F.coalesce(valid_key(F.col("_key")), F.lit(False)), 23).when(~F.coalesce(has_language(F.col("_info"), language), F.lit(True)), 42)
    return terms.select("_key", code.otherwise(0).alias("code"))


def plan_checked_inserts(d: Dictionary, new: DataFrame, rules: DataFrame | None = None, structures: DataFrame | None = None, language: str = model.LANGUAGE, **options) -> DataFrame:
    """``plan_inserts`` of the new terms, which are validated here: by ``term_codes_of``, and with ``rules`` as whole objects."""
    rows = derive_codes(new)
    reports = term_codes_of(rows, language)
    if rules is not None:
        objects = rows.select(F.col("_key").alias("row_id"), F.parse_json(F.to_json(F.struct("_key", "_code", "_info", "_data", "_rule"))).alias("object"))
        found = validate_objects(d, rules, objects, structures, **options)
        reports = reports.unionByName(found.select(F.col("row_id").alias("_key"), "code"))
    return plan_inserts(d.terms, new, reports)


def _versions(pending: DataFrame, order: list[str], ahead: int, strict: bool) -> DataFrame:
    """(_key, position, _waits, _before, _after, _error, _new, _paths) of each request, given that all earlier ones of its term succeed.

    Those behind the first ``ahead`` of a term wait and get no version.

    ``pending`` are the terms' documents (_key, _text, _from), not null, and the requests (_key, _new, _paths) in the order of the columns ``order``,
    then as text; their positions go on from ``_from``. A task streams through a term's document and its requests and holds one document, so a term
    with very many requests costs no memory.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_key", "position", "_waits", "_before", "_after", "_error", "_new", "_paths"]
        write = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
        listed = lru_cache(4096)(json.loads)
        key, text, doc, position, last = _MISSING, None, None, 0, 0
        for frame in frames:
            out = []
            for k, start, since, new, paths in zip(frame["_key"], frame["_text"], frame["_from"], frame["_new"], frame["_paths"]):
                if start is not None:
                    key, text, doc, position, last = k, start, None, int(since), int(since) + ahead
                    continue
                if k != key:
                    key, text, doc, position, last = k, None, None, 0, None
                position += 1
                if last is not None and position > last:
                    out.append((k, position, True, None, None, None, new, paths))
                    continue
                after, error = None, None
                if text is not None and new is not None and paths is not None:
                    doc = json.loads(text) if doc is None else doc
                    error = _change(doc, new, listed(paths), strict)
                    after = None if error else write(doc)
                out.append((k, position, False, text, after, error, new, paths))
                text, doc = (after, doc) if after is not None else (text, None)
            yield pd.DataFrame(dict(zip(names, zip(*out))) if out else {n: [] for n in names}, columns=names, dtype=object)

    rows = dealt(pending, "_key").sortWithinPartitions("_key", F.col("_text").isNull(), *order, "_new", "_paths").select("_key", "_text", "_from", "_new", "_paths")
    return rows.mapInPandas(fold, "_key string, position long, _waits boolean, _before string, _after string, _error string, _new string, _paths string")


def plan_updates(
    d: Dictionary, requests: DataFrame, rules: DataFrame | None = None, structures: DataFrame | None = None, strict: bool = False, language: str = model.LANGUAGE, **options
) -> DataFrame:
    """(_key, position, action, reason, code, term) for each of (_key, updates VARIANT, references ARRAY<STRING>[, position LONG]).

    Requests for one term are taken in the order of ``position``, then of their updates and paths as text; ``position`` in the result counts them from
    1. Each is merged into the version that the requests before it left, and is checked against that version: a refused, invalid or failed request
    changes nothing and those behind it go on from the version before. Null keys are unknown terms; null updates or references change nothing.

    Actions: ``unknown`` (no such term), ``failed`` (the merge, ``reason`` says where), ``refused`` (the new version does more than relax the old
    one, ``reason`` names the violation), ``invalid`` (``code``), ``same`` and ``updated``; ``term`` is the new version of the last two.
    With ``rules`` the whole new document is also validated as an object. Sections that terms do not have are dropped.

    Versions of a term are made as if every request were accepted, and are checked at once, request by request; the first that is
    turned down settles those before it, and the rest go on in another round. A round takes at most two requests of a term and each later one
    twice as many as that before, so the rounds follow the refusals of one term and the logarithm of its requests.
    A version is compared with the one before it in its own row; a round deals its rows to their terms twice and is written once.
    """
    columns = ["_key", "_code", "_info", "_data", "_rule"]
    order = ["position"] if "position" in requests.columns else []
    asked = requests.select("_key", *order, F.to_json("updates").alias("_new"), F.to_json("references").alias("_paths"))
    old = d.terms.where("_key IS NOT NULL").select("_key", F.to_json(F.struct(*columns)).alias("_text"), F.lit(0).cast("long").alias("_from"))
    pending, settled = old.unionByName(asked, allowMissingColumns=True), []
    earlier = Window.partitionBy("_key").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    stops = F.col("action").isin("refused", "invalid")
    ahead = 2
    while True:
        judged = _judged(d, _versions(pending, order, ahead, strict), columns, rules, structures, language, options)
        judged = judged.withColumn("_last", F.coalesce(F.lead("_waits").over(Window.partitionBy("_key").orderBy("position")), F.lit(False)))
        judged = cut(judged.withColumn("_settled", ~F.col("_waits") & ~F.coalesce(F.max(stops).over(earlier), F.lit(False))))
        term = F.from_json("_text", model.TERMS)
        kept = F.when(F.col("action").isin("same", "updated"), F.struct(F.col("_key"), *(term[c].alias(c) for c in columns[1:])))
        settled.append(judged.where("_settled").select("_key", "position", "action", "reason", "code", kept.alias("term")))
        left = judged.where("NOT _settled").select("_key", "position", "_new", "_paths")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        starts = judged.where(F.col("_settled") & (stops | F.col("_last"))).select("_key", "_text", F.col("position").alias("_from"))
        pending, order, ahead = starts.unionByName(left, allowMissingColumns=True), ["position"], 2 * ahead


def _judged(d: Dictionary, rows: DataFrame, columns: list[str], rules, structures, language: str, options: dict) -> DataFrame:
    """The verdict on each version: (_key, position, _waits, action, reason, code, _text, _new, _paths), ``_text`` being the version accepted or the one that stays."""
    fine = F.col("_after").isNotNull()
    if rules is not None:
        rows = cut(rows.withColumn("_id", F.concat_ws("/", "_key", F.col("position").cast("string"))))  # a key holds no slash
        report = validate_objects(d, rules, rows.where(fine).select(F.col("_id").alias("row_id"), F.parse_json("_after").alias("object")), structures, **options)
        rows = rows.join(report.where("code <> 0").select(F.col("row_id").alias("_id"), F.col("code").alias("_found")), "_id", "left")
    else:
        rows = rows.withColumn("_found", F.lit(None).cast("int"))
    both = rows.withColumn("o", F.from_json("_before", model.TERMS)).withColumn("n", F.from_json("_after", model.TERMS))
    moved = F.when(F.get_json_object("_after", "$._key") != F.col("_key"), "key changed")
    # the same bounds contradict each other only if there are exclusive ones
    touched = fine & ((F.contains("_paths", F.lit("_data")) & (F.col("_before") != F.col("_after"))) | F.contains("_before", F.lit("-range-exclusive")))
    both = first_violations(both, touched=touched)
    both = both.withColumn("reason", F.coalesce("_error", F.when(fine, F.coalesce(moved, "violation"))))
    own = F.when(~F.coalesce(valid_key(F.col("_key")), F.lit(False)), 23).when(~F.coalesce(has_language(F.col("n._info"), language), F.lit(True)), 42)
    both = both.withColumn("_own", F.coalesce(F.when(fine, own), "_found"))
    action = (
        F.when(F.col("_waits"), None)
        .when(F.col("_before").isNull(), "unknown")
        .when(F.col("_error").isNotNull(), "failed")
        .when(F.col("reason").isNotNull(), "refused")
        .when(F.col("_own").isNotNull(), "invalid")
        .when(F.col("_after").isNull() | (F.col("_before") == F.col("_after")) | _same(F.col("o"), F.col("n")), "same")
        .otherwise("updated")
    )
    both = both.withColumn("action", action)
    text = F.coalesce(F.when(F.col("action").isin("same", "updated"), F.col("_after")), "_before")
    return both.select("_key", "position", "_waits", "action", "reason", F.coalesce("_own", F.lit(0)).alias("code"), text.alias("_text"), "_new", "_paths")


def _same(o: Column, n: Column) -> Column:
    """Whether two versions are the same as JSON."""
    info = lambda t: F.struct(*(F.map_entries(t["_info"][f]) for f in model.INFO_FIELDS), t["_info"]["_provider"])
    plain = o["_key"].eqNullSafe(n["_key"]) & o["_code"].eqNullSafe(n["_code"]) & (o["_info"].isNull() == n["_info"].isNull())
    data = [F.to_json(o[c]).eqNullSafe(F.to_json(n[c])) for c in ("_data", "_rule")]
    return plain & info(o).eqNullSafe(info(n)) & data[0] & data[1]


def apply_updates(terms: DataFrame, plan: DataFrame) -> DataFrame:
    """The terms with the updated ones replaced by their last version; the rest of the plan changes nothing."""
    last = plan.where("action = 'updated'").groupBy("_key").agg(F.max_by("term", "position").alias("term"))
    new = last.select("term.*")
    return terms.join(new, "_key", "left_anti").select(*new.columns).unionByName(new)
