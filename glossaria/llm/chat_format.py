"""Chat formatting in budgeted windows, by DataFrame functions alone.

Prefix sums of turn tokens cut a conversation into spans of whole turns. Each window holds the leading system turn, the last turns
before its span within a limit, and the span. Loss falls on the assistant texts of the span only, so a repeated text is never
a target twice.

A turn is written ``<|start|>role<|message|>text<|end|>``. In roles and texts, every ``<|`` gets a backslash between its two characters,
and one more where backslashes stand there already, so no text can hold a marker, and reading back removes exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.llm.common import table

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def count_tokens(text: Column) -> Column:
    """Words and the markers of a turn: a count that needs no vocabulary."""
    return F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")) + OVERHEAD


def windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """One row for each window of a conversation: (conv_id, window, formatted, loss_spans, n_turns, n_repeated, n_tokens).

    ``turns`` has conv_id, turn, role and text; other columns play no part. Null roles and texts are empty. Turns are ordered by
    turn, then role, then text, null turns first; repeated rows are turns of their own, and rows without a conv_id one conversation. The first turn is the system turn if
    that is its role. A window has at most ``budget`` tokens, of which at most ``history`` repeat earlier turns, unless the system turn
    or a single turn alone takes more; no turn is cut or dropped. ``loss_spans`` are ranges of code points of ``formatted``, end
    exclusive; the first ``n_repeated`` turns stand in an earlier window too. An empty table gives no rows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(ordered)).withColumn("t", count_tokens(F.col("text")).cast("long"))
    rows = rows.withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    whole = Window.partitionBy("conv_id")
    own = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("t"))
    rows = rows.withColumn("room", F.greatest(budget - history - F.coalesce(F.max(F.when(F.col("is_system"), F.col("t"))).over(whole), F.lit(0)), F.lit(1)))
    running = F.sum(own).over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("until", running).withColumn("since", F.col("until") - own)
    rows = rows.withColumn("cell", F.floor(F.col("since") / F.col("room")))
    body = rows.where(~F.col("is_system"))
    body = body.withColumn("cell_since", F.min("since").over(Window.partitionBy("conv_id", "cell")))
    fits = (F.col("until") - F.col("cell_since") <= F.col("room")) | (F.col("since") == F.col("cell_since"))
    body = body.withColumn("window", 2 * F.col("cell") + F.when(fits, 0).otherwise(1))
    turn = F.struct("kind", "pos", "role", "text", "t")
    new = body.select("conv_id", "window", F.lit(2).alias("kind"), "pos", "role", "text", "t")

    starts = body.groupBy("conv_id", "window").agg(F.min("since").alias("begin")).where("begin > 0")
    low, high = F.floor((F.col("begin") - history) / history), F.floor((F.col("begin") - 1) / history)
    wanted = starts.withColumn("bucket", F.explode(F.sequence(low, high)))
    earlier = body.select("conv_id", F.floor(F.col("since") / history).alias("bucket"), "since", "pos", "role", "text", "t")
    near = (F.col("since") < F.col("begin")) & (F.col("since") >= F.col("begin") - history)
    earlier = earlier.withColumnRenamed("conv_id", "_id")
    repeated = wanted.join(earlier, F.col("conv_id").eqNullSafe(F.col("_id")) & (wanted["bucket"] == earlier["bucket"]))
    repeated = repeated.where(near).select("conv_id", "window", F.lit(1).alias("kind"), "pos", "role", "text", "t")

    system = rows.where("is_system").select("conv_id", "pos", "role", "text", "t")
    places = starts.select(F.col("conv_id").alias("_id"), "window").join(system, F.col("_id").eqNullSafe(F.col("conv_id")))
    leading = system.select("conv_id", F.lit(0).cast("long").alias("window"), F.lit(2).alias("kind"), "pos", "role", "text", "t")
    kept = places.select("conv_id", "window", F.lit(0).alias("kind"), "pos", "role", "text", "t")

    every = new.unionByName(repeated).unionByName(leading).unionByName(kept)
    packed = every.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    packed = packed.select("conv_id", "window", "turns", F.transform("turns", _written).alias("parts"))
    starts_at = F.transform(
        F.sequence(F.lit(1), F.size("parts")),
        lambda k: F.aggregate(F.slice("parts", 1, k - 1), F.lit(0), lambda s, p: s + F.length(p["head"]) + F.length(p["body"]) + len(END)),
    )
    packed = packed.withColumn("starts_at", starts_at)
    spans = F.filter(
        F.zip_with(
            F.zip_with("turns", "parts", lambda a, b: F.struct(a.alias("turn"), b.alias("part"))),
            F.col("starts_at"),
            lambda x, at: F.when(
                (x["turn"]["kind"] == 2) & (x["turn"]["role"] == "assistant"),
                F.struct((at + F.length(x["part"]["head"])).alias("start"), (at + F.length(x["part"]["head"]) + F.length(x["part"]["body"])).alias("end")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return packed.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda x: x["kind"] < 2)).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + x["t"]).alias("n_tokens"),
    )


def _written(turn: Column) -> Column:
    return F.struct(F.concat(F.lit(START), escape(turn["role"]), F.lit(MESSAGE)).alias("head"), escape(turn["text"]).alias("body"))


def read_back(formatted: Column) -> Column:
    """The turns of a window as an array of (role, text), from its formatted text alone."""
    pieces = F.split(formatted, r"<\|end\|>")
    inner = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|message\|>"))
    return F.transform(inner, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from its windows."""
    turns = read_back(F.col("formatted"))
    rows = formatted.select(
        "conv_id",
        "window",
        F.transform(F.slice(turns, F.col("n_repeated") + 1, F.size(turns)), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    row = F.struct("window", F.size("turns").alias("n"), F.array_join("turns", "").alias("text"), "loss", "chars")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("w"))
    return whole.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_turns"),
        F.sha2(F.array_join("w.text", ""), 256).alias("turns_sha256"),
        F.length(F.array_join("w.loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("w.loss", ""), 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


_HARD = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{_HARD}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return digests(windows(turns.unionByName(hard)))


SQL_OP2 = f"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}'
), b AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 4 AS t FROM a
), c AS (
  SELECT *, pos = 1 AND role = 'system' AS is_system FROM b
), d AS (
  SELECT *, greatest(2048 - 256 - coalesce(max(CASE WHEN is_system THEN t END) OVER (PARTITION BY conv_id), 0), 1) AS room,
         sum(CASE WHEN is_system THEN 0 ELSE t END) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS until_
  FROM c
), e AS (
  SELECT *, until_ - t AS since, (until_ - t) // room AS cell FROM d WHERE NOT is_system
), f AS (
  SELECT *, min(since) OVER (PARTITION BY conv_id, cell) AS cell_since FROM e
), g AS (
  SELECT *, 2 * cell + CASE WHEN until_ - cell_since <= room OR since = cell_since THEN 0 ELSE 1 END AS w FROM f
), starts AS (
  SELECT conv_id, w, min(since) AS begin_ FROM g GROUP BY conv_id, w HAVING min(since) > 0
), placed AS (
  SELECT conv_id, w, role, text FROM g
  UNION ALL SELECT s.conv_id, s.w, g.role, g.text FROM starts s JOIN g ON s.conv_id = g.conv_id AND g.since < begin_ AND g.since >= begin_ - 256
  UNION ALL SELECT conv_id, 0, role, text FROM d WHERE is_system
  UNION ALL SELECT s.conv_id, s.w, d.role, d.text FROM starts s JOIN d ON s.conv_id = d.conv_id AND d.is_system
), sized AS (
  SELECT conv_id, sum(length(role) + length(text) + 27 + len(regexp_extract_all(role || chr(10) || text, '<\\\\*\\|'))) AS formatted_chars,
         count(DISTINCT w) AS n_windows
  FROM placed GROUP BY conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss
  FROM b GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, n_windows
FROM whole JOIN sized USING (conv_id)
"""
