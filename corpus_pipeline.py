"""The corpus pipeline: language, quality, near duplicates, packing; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import held_out, materialized
from glossaria.llm.language_id import fit, identify
from glossaria.llm.ngram_join import near_duplicates
from glossaria.llm.packing import pack_texts
from glossaria.llm.quality_rules import score


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The rows under names that no operator adds, but for ``text``, and what gives the columns their own names again."""
    names = [c if c == "text" else f"column_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is clear; the model learns from the documents of the training folds.

    A null text, or one without letters, has no language and goes. Rows with a null id count as training rows, repeated rows are judged each
    on its own, and all columns pass through unchanged, whatever their names.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"), 5)))
    rows, own = _apart(docs)
    return identify(rows, model).where(~F.col("rejected")).select(own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass all rules; null and empty texts have no words and go.

    Repeated rows are judged each on its own, and all columns pass through unchanged, whatever their names.
    """
    rows, own = _apart(docs)
    return score(rows).where("kept").select(own)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, the first by a number given to every row, so repeated and null ids need no rule of their own.

    Texts without words link with nothing and stay. All columns pass through, whatever their names.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = materialized(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = near_duplicates(rows, key=row, unique=True).where("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens, one row for each piece; a null or empty text is its end token alone."""
    return pack_texts(docs, "word_bpe_49k.json", 2)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else materialized(docs)
    return docs


#: Compression, MinHash verification order and packing lie beyond SQL.
ORACLE_SQL = None
