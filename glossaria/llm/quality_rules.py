"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a SQL expression over the text; there is no shuffle and no Python on the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import let, table

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a and as at be by for from in is it not of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "aus das dem den der des die ein eine für ist mit nicht sich sie und von zu "
    "como con del el es las lo los no o para por que se su sus una y"
).split()


@dataclass(frozen=True)
class Rule:
    """The row passes if ``low * per <= 100 * measure`` and ``100 * measure <= high * per``; ``per`` names another measure or is 1."""

    measure: str
    per: str = ""
    low: float | None = None
    high: float | None = None


#: Bounds are percentages of ``per`` where it is given, else plain values.
RULES = (
    Rule("n_words", low=50),
    Rule("word_chars", "n_words", low=200, high=1200),
    Rule("n_symbols", "n_words", high=10),
    Rule("n_stop_words", "n_words", low=6),
    Rule("n_dup_lines", "n_lines", high=40),
    Rule("n_repeat_words", "n_words", high=50),
)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more.

    Hashes of windows are sorted with their positions, so equal windows become neighbours.
    """

    def count(w: Column) -> Column:
        n = F.size(w)

        def of_hashes(h: Column) -> Column:
            keys = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

            def of_sorted(s: Column) -> Column:
                last = F.size(s) - 1
                same = lambda x, i: x["h"] == s[i]["h"]
                hit = F.filter(
                    F.transform(s, lambda x, i: F.when(((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(x, F.least(i + 1, last))), x["p"])),
                    lambda x: x.isNotNull(),
                )
                return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda p: F.array(p, p + 1, p + 2)))))

            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(keys, of_sorted))

        hashes = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))
        return let(hashes, of_hashes)

    return let(words, count)


def measures(text: Column) -> Column:
    """A struct of all measures of a text, each a long."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    w, x = let(words_of(text), of_words), let(lines, of_lines)
    symbols = (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")
    return F.struct(w.alias("w"), x.alias("x"), symbols.alias("n_symbols"))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """All rules as one boolean expression over the measures' columns."""

    def one(r: Rule) -> Column:
        value, per = (100 * F.col(r.measure), F.col(r.per)) if r.per else (F.col(r.measure), F.lit(1))
        tests = [value >= F.lit(r.low) * per] * (r.low is not None) + [value <= F.lit(r.high) * per] * (r.high is not None)
        return reduce(Column.__and__, tests, F.lit(True))

    return reduce(Column.__and__, map(one, rules), F.lit(True))


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to every row of ``docs``.

    A null or empty text has no words: it fails. Columns of these names in ``docs`` are replaced, others pass through;
    repeated rows are judged one by one.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    out, m = docs.drop(*names, "base_failed", "kept"), "_m"
    while m in out.columns:
        m += "_"
    out = out.withColumn(m, measures(F.col(text)))
    out = out.select("*", f"{m}.w.*", f"{m}.x.*", f"{m}.n_symbols").drop(m)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines"
    )


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL_OP3 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), tri AS (
  SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS p, ws FROM w WHERE len(ws) > 2
), keyed AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k FROM tri
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice)
  ) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, len(ls) AS n_lines
  FROM w LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words AND 100 * n_symbols <= 10 * n_words
         AND 100 * n_stop_words >= 6 * n_words AND 100 * n_dup_lines <= 40 * n_lines AS kept,
       n_stop_words::BIGINT AS n_stop_words, n_lines::BIGINT AS n_lines
FROM b
"""
