"""Reading and writing dictionary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria import model
from glossaria.plans.dictionary import Dictionary

SCHEMAS = {"terms": model.TERMS, "edges": model.EDGES, "links": model.LINKS}


def read(spark: SparkSession, folder: str) -> Dictionary:
    """The dictionary saved in a folder."""
    return Dictionary(*(spark.read.parquet(f"{folder}/{name}") for name in SCHEMAS))


def save(d: Dictionary, folder: str) -> None:
    """Write the tables, and those derived from them that joins use most (S2), sorted within files by their join column."""
    d.terms.write.mode("overwrite").parquet(f"{folder}/terms")
    d.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    if d.links is not None:
        d.links.write.mode("overwrite").parquet(f"{folder}/links")
    derived = {"edge_path": ["root", "predicate"], "term_codes": ["field", "code"], "term_tokens": ["field", "token"], "enum_members": ["root", "term"]}
    for name, order in derived.items():
        getattr(d, name).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: a file of JSON lines; a malformed line has nulls and its text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: the lines of a file, as text."""
    return spark.read.text(path)


def requests(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal request frame."""
    return spark.createDataFrame(rows, schema)


def insert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with new rows; raises if a key is taken or comes twice."""
    clash = new.groupBy(key).count().where("count > 1").select(key).unionByName(new.select(key).join(table, key, "left_semi"))
    taken = clash.limit(3).collect()
    if taken:
        raise ValueError(f"keys already in use: {', '.join(str(r[0]) for r in taken)}")
    return table.unionByName(new)


def replace(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the rows of equal key replaced."""
    return table.join(new, key, "left_anti").unionByName(new.join(table, key, "left_semi"))


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the rows of these keys."""
    return table.join(keys, key, "left_anti")


def inserted_rows(plan: DataFrame) -> DataFrame:
    """Of a plan, the rows that would be written; a dry run is the plan itself."""
    return plan.where(F.col("action").isin("inserted", "updated"))
