"""The dictionary: its tables and those derived from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import handle_key, tokens


@dataclass(frozen=True)
class Dictionary:
    """Terms (``model.TERMS``), edges (``model.EDGES``) and links (``model.LINKS``).

    All derived tables are plain plans over the three; write the ones in constant use (``sources.tables.save``) sorted by the
    column that they are joined on.
    """

    terms: DataFrame
    edges: DataFrame
    links: DataFrame | None = None

    @property
    def edge_path(self) -> DataFrame:
        """One row for each edge and root that uses it."""
        return self.edges.select("edge_key", F.explode("roots").alias("root"), "from", "predicate", "to")

    @property
    def enum_members(self) -> DataFrame:
        """(term, root): the enumerations that a term is an element of."""
        rows = self.edge_path.where(F.col("predicate") == model.ENUM_OF)
        return rows.select(handle_key(F.col("from")).alias("term"), handle_key(F.col("root")).alias("root")).distinct()

    @property
    def term_codes(self) -> DataFrame:
        """(field, code, key): every identifier of every term."""
        single = [F.struct(F.lit(f).alias("field"), F.array(F.col(f"_code.{f}")).alias("codes")) for f in ("_nid", "_lid", "_gid", "_name")]
        many = [F.struct(F.lit(f).alias("field"), F.col(f"_code.{f}").alias("codes")) for f in ("_aid", "_pid")]
        rows = self.terms.select(F.col("_key").alias("key"), F.explode(F.array(*single, *many)).alias("x"))
        return rows.select("key", "x.field", F.explode("x.codes").alias("code")).where("code is not null").select("field", "code", "key")

    @property
    def term_tokens(self) -> DataFrame:
        """(key, field, lang, token): the words of all information texts."""
        parts = [self.terms.select(F.col("_key").alias("key"), F.lit(f).alias("field"), F.explode(F.col(f"_info.{f}")).alias("lang", "text")) for f in model.INFO_FIELDS]
        provider = self.terms.select(F.col("_key").alias("key"), F.lit("_provider").alias("field"), F.lit(None).cast("string").alias("lang"), F.col("_info._provider").alias("text"))
        rows = reduce(DataFrame.unionByName, [*parts, provider])
        return rows.select("key", "field", "lang", F.explode(tokens(F.col("text"))).alias("token"))

    @property
    def term_flags(self) -> DataFrame:
        """(term, is_descriptor, is_structure, roots): what the validator asks of a term."""
        roots = self.enum_members.groupBy("term").agg(F.sort_array(F.collect_set("root")).alias("roots"))
        flags = self.terms.select(F.col("_key").alias("term"), F.col("_data").isNotNull().alias("is_descriptor"), F.col("_rule").isNotNull().alias("is_structure"))
        return flags.join(roots, "term", "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<string>")))


def edge_rows(path_rows: DataFrame) -> DataFrame:
    """Edges from rows (edge_key, root, from, predicate, to); a row with a null root gives an edge no root."""
    return path_rows.groupBy("edge_key", "from", "predicate", "to").agg(F.array_sort(F.collect_set("root")).alias("roots"))
