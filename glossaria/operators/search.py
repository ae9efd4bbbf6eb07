"""Search through saved tokens (S2 with T9, T11) and pages of sorted results.

A posting says that a token stands in a field of a term. Search forms are rows; all of them are answered by joins of their words with the
postings, and no text of a term is read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import tokens
from glossaria.plans.cut import cut
from glossaria.plans.dictionary import Dictionary


def postings(d: Dictionary, language: str = model.LANGUAGE) -> DataFrame:
    """(token, field, key), each once: the words of information texts in a language, and of providers. Save it sorted by token."""
    rows = d.term_tokens.where((F.col("lang") == language) | (F.col("field") == "_provider"))
    return rows.select("token", "field", "key").distinct()


def _expanded(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Patterns (…, word) with each ``token`` that they match, by equal first letters, else by an equal last one."""
    word = F.col("word")
    prefix, last = F.regexp_extract(word, r"^[^%_\\]{0,2}", 0), F.regexp_extract(word, r"(?<![\\])[^%_\\]$", 0)
    by = F.when(F.length(prefix) == 2, F.concat(F.lit("2"), prefix)).when(F.length(prefix) == 1, F.concat(F.lit("1"), prefix)).when(last != "", F.concat(F.lit("z"), last)).otherwise("*")
    token = F.col("token")
    names = F.array(F.concat(F.lit("2"), F.left(token, F.lit(2))), F.concat(F.lit("1"), F.left(token, F.lit(1))), F.concat(F.lit("z"), F.right(token, F.lit(1))), F.lit("*"))
    keyed = vocabulary.select("token", F.explode(names).alias("_by"))
    return patterns.withColumn("_by", by).join(keyed, "_by").where("token LIKE word").drop("_by")


def search_tokens(posted: DataFrame, forms: DataFrame) -> DataFrame:
    """(form_id, key) of the terms that each form finds, from ``postings``.

    ``forms``: (form_id, field, mode, words ARRAY<STRING>); rows of one form must all hold. ``mode``: ``any`` or ``all`` of the words' tokens. A word with
    ``%`` or ``_`` (escaped by a backslash) is a pattern for whole tokens. A row without words finds nothing.

    Clauses that forms share are answered once. Of the words that must all occur, the one with the fewest postings gives the candidates, and only these are looked up under the others.
    """
    clauses = cut(forms.select("field", "mode", "words").distinct().withColumn("clause", F.monotonically_increasing_id()))
    same = reduce(Column.__and__, (F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("field", "mode", "words")))
    held = cut(forms.alias("f").join(clauses.alias("c"), same).select("form_id", "clause").distinct())
    words = clauses.select("clause", "field", "mode", F.posexplode("words").alias("pos", "word")).withColumn("word", F.lower("word"))
    is_pattern = F.col("word").rlike("[%_]")
    plain = words.where(~is_pattern).withColumn("token", F.explode(tokens(F.col("word")))).withColumn("unit", F.concat_ws(":", "pos", "token"))
    vocabulary = cut(posted.select("token").distinct())
    broad = _expanded(words.where(is_pattern), vocabulary).withColumn("unit", F.col("pos").cast("string"))
    columns = ["clause", "field", "mode", "unit", "token"]
    units = cut(plain.select(*columns).unionByName(broad.select(*columns)).distinct())
    asked = plain.select("clause", "unit").unionByName(words.where(is_pattern).select("clause", F.col("pos").cast("string").alias("unit"))).distinct()
    wanted = asked.groupBy("clause").agg(F.count("*").alias("n_units"))

    any_of = units.where("mode = 'any'").join(posted, ["field", "token"]).select("clause", "key").distinct()

    every = units.where("mode = 'all'")
    sizes = every.select("field", "token").distinct().join(posted, ["field", "token"]).groupBy("field", "token").agg(F.count("*").alias("n"))
    weighed = every.join(sizes, ["field", "token"], "left").groupBy("clause", "unit").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rarest = weighed.groupBy("clause").agg(F.min(F.struct("n", "unit")).alias("r")).select("clause", F.col("r.unit").alias("unit"))
    first = every.join(rarest, ["clause", "unit"]).join(posted, ["field", "token"]).select("clause", "field", "key").distinct()
    first = cut(first)
    others = every.join(rarest, ["clause", "unit"], "left_anti").select("clause", "unit", "token")
    met = first.join(others, "clause").join(posted, ["field", "token", "key"]).select("clause", "key", "unit").distinct().groupBy("clause", "key").agg(F.count("*").alias("n"))
    whole = first.join(met, ["clause", "key"], "left").join(wanted, "clause").where("coalesce(n, 0) + 1 = n_units")

    hits = cut(any_of.unionByName(whole.select("clause", "key")))
    held = held.join(held.groupBy("form_id").agg(F.count("*").alias("n_clauses")), "form_id")
    found = held.join(hits, "clause")
    several = found.where("n_clauses > 1").groupBy("form_id", "key", "n_clauses").agg(F.count("*").alias("n")).where("n = n_clauses")
    return found.where("n_clauses = 1").select("form_id", "key").unionByName(several.select("form_id", "key"))


@dataclass(frozen=True)
class Pages:
    """Sorted rows in ranges: ``rows`` has its range as ``_part``, ``first`` the rank of each range's first row, ``size`` the rows of a page."""

    rows: DataFrame
    by: tuple[str, ...]
    first: tuple[tuple[int, int, int], ...]
    size: int

    def page(self, number: int) -> DataFrame:
        """Rows of a page, counted from 0, with their ``rank``; only the ranges that the page meets are read."""
        return self.pages(number, number)

    def pages(self, first: int, last: int) -> DataFrame:
        low, high = first * self.size, (last + 1) * self.size
        met = [(part, start) for part, start, n in self.first if start < high and start + n > low]
        rows = self.rows.where(F.col("_part").isin([part for part, _ in met]))
        starts = F.create_map(*[F.lit(x) for pair in met for x in pair]) if met else None
        inside = F.row_number().over(Window.partitionBy("_part").orderBy(*self.by)) - 1
        rank = inside + (F.element_at(starts, F.col("_part")) if met else F.lit(0))
        return rows.withColumn("rank", rank.cast("long")).where((F.col("rank") >= low) & (F.col("rank") < high)).drop("_part")


def paged(rows: DataFrame, by: list[str], size: int) -> Pages:
    """Rows in the order of ``by``, nulls first, laid out in ranges of which a page reads one or two, however deep it lies.

    ``by`` must order the rows totally, else ranks of ties may differ from one reading to the next. The driver holds one count for each range.
    """
    dealt = cut(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect())
    first, start = [], 0
    for part, n in counts:
        first.append((part, start, n))
        start += n
    return Pages(dealt, tuple(by), tuple(first), size)
