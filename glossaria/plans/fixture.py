"""A dictionary derived from the star-schema tables of the test data.

The mapping is SQL that Spark and DuckDB both run: ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import edge_key
from glossaria.plans.dictionary import Dictionary, edge_rows

TABLES = ("region", "nation", "supplier", "customer", "part", "lineitem")

EDGES = """
SELECT 'terms/region_' || r_regionkey AS f, '_predicate_section-of' AS p, 'terms/geo' AS t, 'terms/geo' AS root FROM {region}
UNION ALL SELECT 'terms/region_' || r_regionkey, '_predicate_section-of', 'terms/geo', 'terms/supply' FROM {region}
UNION ALL SELECT 'terms/nation_' || n_nationkey, '_predicate_enum-of', 'terms/region_' || n_regionkey, 'terms/geo' FROM {nation}
UNION ALL SELECT 'terms/nation_' || n_nationkey, '_predicate_enum-of', 'terms/region_' || n_regionkey, 'terms/supply' FROM {nation}
UNION ALL SELECT 'terms/supplier_' || s_suppkey, '_predicate_enum-of', 'terms/nation_' || s_nationkey, 'terms/supply' FROM {supplier}
UNION ALL SELECT 'terms/customer_' || c_custkey, '_predicate_property-of', 'terms/nation_' || c_nationkey, 'terms/geo' FROM {customer}
UNION ALL SELECT DISTINCT 'terms/geo', '_predicate_bridge-of', 'terms/supply', 'terms/supply' FROM {region}
UNION ALL SELECT DISTINCT 'terms/brand_' || replace(p_brand, 'Brand#', ''), '_predicate_section-of', 'terms/catalog', 'terms/catalog' FROM {part}
UNION ALL SELECT 'terms/part_' || p_partkey, '_predicate_enum-of', 'terms/brand_' || replace(p_brand, 'Brand#', ''), 'terms/catalog' FROM {part}
"""

LINKS = """
SELECT 'terms/part_' || p_partkey AS f, '_predicate_requires_metadata' AS p, 'terms/part_' || CAST(floor(p_partkey / 2) AS BIGINT) AS t FROM {part} WHERE p_partkey > 0
UNION ALL SELECT DISTINCT 'terms/part_' || l_partkey, '_predicate_requires_indicator', 'terms/supplier_' || l_suppkey FROM {lineitem}
"""

TERMS = """
SELECT 'region_' || r_regionkey AS k, 'region' AS nid, '' || r_regionkey AS lid, r_name AS name FROM {region}
UNION ALL SELECT 'nation_' || n_nationkey, 'nation', '' || n_nationkey, n_name FROM {nation}
UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier', '' || s_suppkey, s_name FROM {supplier}
UNION ALL SELECT 'customer_' || c_custkey, 'customer', '' || c_custkey, c_name FROM {customer}
UNION ALL SELECT 'part_' || p_partkey, 'part', '' || p_partkey, p_name FROM {part}
UNION ALL SELECT DISTINCT 'brand_' || replace(p_brand, 'Brand#', ''), 'brand', replace(p_brand, 'Brand#', ''), p_brand FROM {part}
UNION ALL SELECT DISTINCT 'geo', CAST(NULL AS VARCHAR(9)), 'geo', 'Geography' FROM {region}
UNION ALL SELECT DISTINCT 'supply', CAST(NULL AS VARCHAR(9)), 'supply', 'Supply' FROM {region}
UNION ALL SELECT DISTINCT 'catalog', CAST(NULL AS VARCHAR(9)), 'catalog', 'Catalog' FROM {region}
"""


def plain(text: str) -> str:
    """The same SQL over views named like the tables."""
    return text.format(**{t: t for t in TABLES})


#: For oracle queries: ``ep`` is edge_path, ``lk`` the links, ``tm`` the terms.
ORACLE = f"""
raw_edges AS ({plain(EDGES)}),
ep AS (SELECT md5(concat_ws('/', f, p, t)) AS edge_key, root, f, p, t FROM raw_edges),
lk AS (SELECT md5(concat_ws('/', f, p, t)) AS edge_key, f, p, t FROM ({plain(LINKS)})),
tm AS ({plain(TERMS)})
"""


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the tables that it names."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    """The dictionary of a data folder; titles are names, official codes are number and name."""
    no_data = F.create_map().cast("map<string,string>")
    named = lambda df: df.select(edge_key(F.col("f"), F.col("p"), F.col("t")).alias("edge_key"), F.col("f").alias("from"), F.col("p").alias("predicate"), F.col("t").alias("to"), *(F.col(c) for c in df.columns if c == "root"))
    edges = edge_rows(named(sql(spark, sf_dir, EDGES))).withColumn("data", no_data)
    links = named(sql(spark, sf_dir, LINKS)).withColumn("data", no_data)
    empty = F.lit(None).cast("map<string,string>")
    code = F.struct(
        F.col("nid").alias("_nid"), F.col("lid").alias("_lid"), F.col("k").alias("_gid"), F.array("lid", "name").alias("_aid"), F.lit(None).cast("array<string>").alias("_pid"), F.col("name").alias("_name")
    )
    info = F.struct(F.create_map(F.lit(model.LANGUAGE), F.col("name")).alias("_title"), *(empty.alias(f) for f in model.INFO_FIELDS[1:]), F.lit(None).cast("string").alias("_provider"))
    none = F.lit(None).cast("variant")
    terms = sql(spark, sf_dir, TERMS).select(F.col("k").alias("_key"), code.alias("_code"), info.alias("_info"), none.alias("_data"), none.alias("_rule"))
    return Dictionary(terms, edges, links)
