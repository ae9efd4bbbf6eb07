"""Registered queries over the driver's tables, and the SQL that gives the same rows in another engine.

Requests are derived from the tables too, so every query answers as many requests as the data has entities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions import columns
from glossaria.functions.columns import edge_key, handle_key, is_empty_object
from glossaria.operators import definitions, edits, evolve, flat, geo, search, terms, updates, validate, walk
from glossaria.plans.cut import dealt, scratch
from glossaria.plans.fixture import ORACLE, dictionary, sql
from glossaria.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, dictionary_sql: bool = True) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL over ep, lk and tm."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {ORACLE}, {text.strip()}" if dictionary_sql else text.strip()
        return f

    return add


def _joined(array: str) -> Column:
    return F.array_join(array, ",")


def _roots(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT root AS request_id, root FROM VALUES ('terms/geo'), ('terms/supply'), ('terms/catalog') AS v(root)")


# Flat lookups


@query("q AS (SELECT 1) SELECT DISTINCT root || '|' || p AS request_id, f AS handle FROM ep")
def f1_functional_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.edge_path.select("root", "predicate").distinct().withColumn("request_id", F.concat("root", F.lit("|"), "predicate"))
    return flat.functional_handles(d, asked)


@query("h AS (SELECT DISTINCT root, f FROM ep WHERE p = '_predicate_enum-of') SELECT root AS request_id, f AS handle, lid, name AS title FROM h LEFT JOIN tm ON 'terms/' || k = f")
def f2_functional_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _roots(spark).withColumn("predicate", F.lit(model.ENUM_OF))
    out = flat.functional_terms(dictionary(spark, sf_dir), asked, language=model.LANGUAGE)
    return out.select("request_id", "handle", F.col("term._code._lid").alias("lid"), "title")


@query("q AS (SELECT 1) SELECT root AS request_id, edge_key, f AS from_handle, t AS to_handle FROM ep WHERE p = '_predicate_section-of'")
def f3_functional_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _roots(spark).withColumn("predicate", F.lit(model.SECTION_OF))
    return flat.functional_edges(dictionary(spark, sf_dir), asked).select("request_id", "edge_key", F.col("from").alias("from_handle"), F.col("to").alias("to_handle"))


@query("q AS (SELECT 1) SELECT DISTINCT root AS request_id, split_part(f, '/', 2) AS key FROM ep WHERE p = '_predicate_enum-of'")
def f5_enumeration_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.enumeration_keys(dictionary(spark, sf_dir), _roots(spark))


@query("q AS (SELECT 1) SELECT DISTINCT root AS request_id, split_part(f, '/', 2) AS key FROM ep WHERE p = '_predicate_property-of'")
def f8_property_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.enumeration_keys(dictionary(spark, sf_dir), _roots(spark), model.PROPERTY_OF)


@query("g AS (SELECT edge_key, f, t, count(DISTINCT root) AS n_roots FROM ep WHERE p = '_predicate_enum-of' GROUP BY edge_key, f, t) SELECT edge_key, f AS from_handle, t AS to_handle, n_roots FROM g")
def f10_edges_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    keys = d.edge_path.where(F.col("predicate") == model.ENUM_OF).select("edge_key")
    return flat.edges_by_key(d, keys).select("edge_key", F.col("from").alias("from_handle"), F.col("to").alias("to_handle"), F.size("roots").cast("long").alias("n_roots"))


# Codes and membership


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term name, as a request."""
    rows = dictionary(spark, sf_dir).terms.select(F.col("_code._name").alias("code")).distinct()
    return rows.select(F.col("code").alias("request_id"), F.lit("_aid").alias("field"), "code")


@query("q AS (SELECT 1) SELECT DISTINCT name AS request_id, k AS key FROM tm")
def i1_terms_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.terms_by_code(dictionary(spark, sf_dir), _names(spark, sf_dir))


@query("""
ends AS (SELECT root, edge_key, f, f AS h FROM ep WHERE p = '_predicate_enum-of' UNION ALL SELECT root, edge_key, f, t FROM ep WHERE p = '_predicate_enum-of'),
m AS (SELECT k, arg_min(f, edge_key) AS f FROM tm JOIN ends ON root = 'terms/supply' AND h = 'terms/' || k GROUP BY k)
SELECT tm.k AS request_id, tm.k AS key, split_part(m.f, '/', 2) AS matched FROM tm LEFT JOIN m ON tm.k = m.k
""")
def i2_check_enum_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.terms.select(F.col("_key").alias("request_id"), F.lit("terms/supply").alias("root"), F.col("_key").alias("key"))
    return flat.check_enum_keys(d, asked)


@query("""
n AS (SELECT DISTINCT name FROM tm),
m AS (SELECT name, string_agg('terms/' || k, ',' ORDER BY k) AS matched FROM (SELECT DISTINCT tm.name, tm.k FROM tm JOIN ep ON f = 'terms/' || k AND p = '_predicate_enum-of' AND root = 'terms/catalog') GROUP BY name)
SELECT n.name AS request_id, n.name AS code, coalesce(matched, '') AS matched FROM n LEFT JOIN m ON n.name = m.name
""")
def i3_check_enum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _names(spark, sf_dir).withColumn("root", F.lit("terms/catalog"))
    return flat.check_enum_codes(dictionary(spark, sf_dir), asked).withColumn("matched", _joined("matched"))


@query("q AS (SELECT 1) SELECT DISTINCT tm.lid AS request_id, tm.k AS key FROM tm JOIN ep ON f = 'terms/' || k AND p = '_predicate_enum-of' AND root = 'terms/supply'")
def i4_enum_keys_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    codes = d.terms.select(F.col("_code._lid").alias("code")).distinct()
    asked = codes.select(F.col("code").alias("request_id"), F.lit("_lid").alias("field"), "code", F.lit("terms/supply").alias("root"))
    return flat.enum_keys_by_code(d, asked)


@query("""
w AS (SELECT DISTINCT split_part(f, '/', 2) AS key FROM ep UNION SELECT DISTINCT 'none_' || split_part(f, '/', 2) FROM ep),
r AS (SELECT split_part(f, '/', 2) AS key, string_agg(DISTINCT split_part(root, '/', 2), ',' ORDER BY split_part(root, '/', 2)) AS roots FROM ep WHERE p = '_predicate_enum-of' GROUP BY f)
SELECT w.key, tm.k IS NOT NULL AS found, CASE WHEN tm.k IS NOT NULL THEN coalesce(roots, '') END AS roots FROM w LEFT JOIN tm ON w.key = tm.k LEFT JOIN r ON w.key = r.key
""")
def i9_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    keys = d.edges.select(handle_key(F.col("from")).alias("key")).distinct()
    asked = keys.unionByName(keys.select(F.concat(F.lit("none_"), "key").alias("key")))
    return flat.lookup(d, asked).select("key", "found", _joined("roots").alias("roots"))


@query("""
h AS (SELECT DISTINCT f AS handle FROM lk UNION SELECT DISTINCT 'links/' || edge_key FROM ep UNION SELECT DISTINCT 'users/' || edge_key FROM ep),
k AS (SELECT 'terms/' || k AS handle FROM tm UNION SELECT DISTINCT 'edges/' || edge_key FROM ep UNION SELECT 'links/' || edge_key FROM lk)
SELECT h.handle, split_part(h.handle, '/', 1) IN ('terms', 'edges', 'links') AS collection_exists, k.handle IS NOT NULL AS document_exists FROM h LEFT JOIN k ON h.handle = k.handle
""")
def i12_documents_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    made = d.edges.select(F.explode(F.array(F.concat(F.lit("links/"), "edge_key"), F.concat(F.lit("users/"), "edge_key"))).alias("handle"))
    return flat.documents_exist(d, d.links.select(F.col("from").alias("handle")).unionByName(made).distinct())


# Walks


@query("""
r AS (SELECT DISTINCT root, root AS node, 0 AS depth FROM ep UNION SELECT r.root, ep.f, depth + 1 FROM r JOIN ep ON ep.root = r.root AND ep.t = r.node WHERE depth < 9),
e AS (SELECT DISTINCT ep.root, ep.t, ep.p, ep.f FROM (SELECT DISTINCT root, node FROM r) n JOIN ep ON ep.root = n.root AND ep.t = n.node
      WHERE ep.p IN ('_predicate_enum-of', '_predicate_section-of', '_predicate_bridge-of'))
SELECT root AS request_id, t AS parent, p AS predicate, count(*) AS n_children, md5(string_agg(f, ',' ORDER BY f)) AS children FROM e GROUP BY root, t, p
""")
def g1_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walk.tree(dictionary(spark, sf_dir), _roots(spark), (model.ENUM_OF, model.SECTION_OF, model.BRIDGE_OF))
    return out.select("request_id", "parent", "predicate", F.size("children").cast("long").alias("n_children"), F.md5(_joined("children")).alias("children"))


@query("""
r AS (SELECT DISTINCT root, root AS node, 0 AS depth FROM ep UNION SELECT r.root, ep.f, depth + 1 FROM r JOIN (SELECT DISTINCT t, f FROM ep) ep ON ep.t = r.node WHERE depth < 9),
e AS (SELECT DISTINCT n.root, ep.t, ep.p, ep.f FROM (SELECT DISTINCT root, node FROM r) n JOIN ep ON ep.t = n.node WHERE ep.p IN ('_predicate_property-of', '_predicate_bridge-of'))
SELECT root AS request_id, t AS parent, p AS predicate, count(*) AS n_children, md5(string_agg(f, ',' ORDER BY f)) AS children FROM e GROUP BY root, t, p
""")
def g2_property_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walk.property_tree(dictionary(spark, sf_dir), _roots(spark))
    return out.select("request_id", "parent", "predicate", F.size("children").cast("long").alias("n_children"), F.md5(_joined("children")).alias("children"))


_PATHS = """
r AS (SELECT DISTINCT root, root AS node, 0 AS depth, root AS path, '' AS p FROM ep
      UNION ALL SELECT r.root, ep.f, depth + 1, path || '>' || ep.f, ep.p FROM r JOIN ep ON ep.root = r.root AND ep.t = r.node WHERE depth < 10)
"""


@query(f"{_PATHS} SELECT root AS request_id, depth, path FROM r WHERE depth BETWEEN 2 AND 4 AND p IN ('_predicate_enum-of', '_predicate_property-of')")
def g5_level_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _roots(spark).withColumn("parent", F.col("root"))
    out = walk.level_paths(dictionary(spark, sf_dir), asked, (model.ENUM_OF, model.PROPERTY_OF), True, 2, 4)
    return out.select("request_id", "depth", F.array_join("vertices", ">").alias("path"))


@query(f"""{_PATHS},
w AS (SELECT * FROM r WHERE path NOT LIKE '%customer%')
SELECT node AS request_id, depth, path FROM w WHERE root = 'terms/supply' AND node LIKE 'terms/supplier%'
""")
def g6_node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.terms.where("_code._nid = 'supplier'").select(F.concat(F.lit("terms/"), "_key").alias("target"))
    asked = asked.select(F.col("target").alias("request_id"), F.lit("terms/supply").alias("root"), "target")
    out = walk.node_paths(d, asked, (model.ENUM_OF, model.SECTION_OF, model.BRIDGE_OF))
    return out.select("request_id", "depth", F.array_join("vertices", ">").alias("path"))


@query(f"{_PATHS} SELECT name AS request_id, depth, path FROM r JOIN tm ON 'terms/' || k = node WHERE root = 'terms/catalog' AND depth > 0")
def g7_code_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _names(spark, sf_dir).withColumn("root", F.lit("terms/catalog"))
    out = walk.code_paths(dictionary(spark, sf_dir), asked, (model.ENUM_OF, model.SECTION_OF))
    return out.select("request_id", "depth", F.array_join("vertices", ">").alias("path"))


@query("""
own AS (SELECT DISTINCT f FROM ep WHERE root = 'terms/supply' AND p = '_predicate_enum-of'),
up AS (SELECT t, arg_min(f, edge_key) AS f FROM ep WHERE root = 'terms/supply' AND p = '_predicate_enum-of' GROUP BY t)
SELECT 'terms/' || k AS request_id, CASE WHEN own.f IS NOT NULL THEN own.f ELSE up.f END AS matched, CASE WHEN own.f IS NOT NULL THEN 0 ELSE 1 END AS depth
FROM tm LEFT JOIN own ON own.f = 'terms/' || k LEFT JOIN up ON up.t = 'terms/' || k
WHERE nid IN ('region', 'nation', 'supplier', 'part') AND (own.f IS NOT NULL OR up.f IS NOT NULL)
""")
def g8_match_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    handle = F.concat(F.lit("terms/"), "_key")
    asked = d.terms.where(F.col("_code._nid").isin("region", "nation", "supplier", "part")).select(handle.alias("request_id"), F.lit("terms/supply").alias("root"), handle.alias("target"))
    return walk.match_nodes(d, asked, model.ENUM_OF).select("request_id", "matched", "depth")


@query(f"""{_PATHS},
h AS (SELECT tm.k, r.*, row_number() OVER (PARTITION BY tm.k ORDER BY depth, md5(concat_ws('/', node, p, split_part(path, '>', -2)))) AS n FROM tm JOIN r ON r.root = 'terms/supply' AND p = '_predicate_enum-of'
      AND (r.node = 'terms/' || tm.k OR split_part(path, '>', -2) = 'terms/' || tm.k))
SELECT k AS request_id, depth, path FROM h WHERE n = 1
""")
def g12_match_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.terms.select(F.col("_key").alias("request_id"), F.lit("terms/supply").alias("root"), F.concat(F.lit("terms/"), "_key").alias("target"))
    return walk.match_enumeration(d, asked).select("request_id", "depth", F.array_join("vertices", ">").alias("path"))


@query(f"{_PATHS} SELECT DISTINCT lid AS request_id, depth, path FROM r JOIN tm ON 'terms/' || k = node WHERE root = 'terms/supply' AND p = '_predicate_enum-of'")
def g18_match_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    codes = d.terms.select(F.col("_code._lid").alias("code")).distinct()
    asked = codes.select(F.col("code").alias("request_id"), F.lit("terms/supply").alias("root"), F.lit("_lid").alias("field"), "code")
    return walk.match_enumeration_code(d, asked).select("request_id", "depth", F.array_join("vertices", ">").alias("path"))


_LINKED = """
r AS (SELECT DISTINCT f AS start, f AS node, 0 AS depth FROM lk WHERE p = '_predicate_requires_metadata'
      UNION SELECT start, t, depth + 1 FROM r JOIN lk ON f = node WHERE depth < 9)
"""


@query(f"""{_LINKED}
SELECT DISTINCT split_part(start, '/', 2) AS request_id, split_part(lk.t, '/', 2) AS key FROM r JOIN lk ON lk.f = r.node AND lk.p = '_predicate_requires_metadata'
""")
def g21_linked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    starts = d.links.where(F.col("predicate") == model.REQUIRES_METADATA).select(handle_key(F.col("from")).alias("key")).distinct()
    return walk.required_metadata(d, starts.select(F.col("key").alias("request_id"), "key"))


@query(f"""{_LINKED},
x AS (SELECT DISTINCT split_part(start, '/', 2) AS request_id, split_part(lk.t, '/', 2) AS key FROM r JOIN lk ON lk.f = r.node AND lk.p = '_predicate_requires_indicator')
SELECT request_id, count(*) AS n, count(tm.k) AS known, min(name) AS first_title FROM x LEFT JOIN tm ON x.key = tm.k GROUP BY request_id
""")
def g22_linked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    starts = d.links.where(F.col("predicate") == model.REQUIRES_METADATA).select(handle_key(F.col("from")).alias("key")).distinct()
    out = walk.linked_terms(d, starts.select(F.col("key").alias("request_id"), "key"), model.REQUIRES_INDICATOR)
    return out.groupBy("request_id").agg(F.count("*").alias("n"), F.count("term._key").alias("known"), F.min("term._code._name").alias("first_title"))


@query("q AS (SELECT 1) SELECT DISTINCT f AS request_id FROM ep WHERE root = 'terms/geo' OR f = 'terms/geo'")
def g25_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.edges.select(F.col("from").alias("request_id"), F.lit("terms/geo").alias("root"), F.col("from").alias("parent")).distinct()
    return walk.connected(d, asked).select("request_id")


# Terms and descriptors


@query("q AS (SELECT 1) SELECT CASE WHEN nid IS NULL THEN lid ELSE nid || '_' || lid END AS key, name || ',' || lid AS official FROM tm")
def t3_derive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = dictionary(spark, sf_dir).terms.withColumn("_code", F.col("_code").withField("_aid", F.array("_code._name")).withField("_gid", F.lit(None).cast("string")))
    return terms.derive_codes(bare.withColumn("_key", F.lit(None).cast("string"))).select(F.col("_key").alias("key"), _joined("_code._aid").alias("official"))


@query("w AS (SELECT DISTINCT f FROM lk UNION SELECT DISTINCT t || 'x' FROM lk) SELECT split_part(w.f, '/', 2) AS key, name AS title FROM w LEFT JOIN tm ON 'terms/' || k = w.f")
def t7_terms_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    keys = d.links.select("from").unionByName(d.links.select(F.concat("to", F.lit("x")).alias("from"))).distinct().select(handle_key(F.col("from")).alias("_key"))
    return terms.get_terms(d.terms, keys, model.LANGUAGE).select(F.col("_key").alias("key"), F.col("title_text").alias("title"))


@query("""
s AS (SELECT k, name FROM tm WHERE lower(nid) LIKE 'par%' AND list_has_any(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''), ['red', 'widget']))
SELECT k AS key, name AS title FROM s ORDER BY k LIMIT 25 OFFSET 5
""")
def t11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terms.search(dictionary(spark, sf_dir).terms, terms.selection(_nid="PAR%", _title="Red widget"), 5, 25)
    return terms.project_language(found, model.LANGUAGE).select(F.col("_key").alias("key"), F.col("title_text").alias("title"))


@query("q AS (SELECT 1) SELECT k AS key FROM tm WHERE lid LIKE '1%' AND name LIKE '%ring' AND nid = 'part'")
def t12_plain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary(spark, sf_dir).terms.where(terms.plain_selection(title="%ring", _lid="1%", _nid="part"))
    return found.select(F.col("_key").alias("key"))


@query("SELECT p_partkey AS key, p_size + 1 AS size, p_size > 25 AS has_note, p_size > 25 AS changed FROM part WHERE p_size + 1 > 0 AND false UNION ALL SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END, p_size > 25, p_size > 25 FROM part", dictionary_sql=False)
def t14_merge_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    doc = F.create_map(F.lit("_data._size"), F.col("p_size").cast("string"), F.lit("_info.old.a"), F.lit("1"), F.lit("_info.old.b"), F.lit("2"))
    docs = part.select(F.col("p_partkey").alias("_key"), doc.alias("doc"))
    patch = F.array(F.struct(F.lit("_data._size").alias("path"), (F.col("p_size") + 1).cast("string").alias("value")), F.struct(F.lit("_info.note").alias("path"), F.lit("x").alias("value")), F.struct(F.lit("_info.old").alias("path"), F.lit(None).cast("string").alias("value")))
    patches = part.where("p_size > 25").select(F.col("p_partkey").alias("_key"), F.explode(patch).alias("x")).select("_key", "x.*")
    out = terms.merge_updates(docs, patches)
    note = F.map_contains_key("doc", "_info.note") & ~F.map_contains_key("doc", "_info.old.a") & ~F.map_contains_key("doc", "_info.old.b")
    return out.select(F.col("_key").alias("key"), F.col("doc")["_data._size"].cast("int").alias("size"), note.alias("has_note"), "changed")


def _part_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as descriptors: brand is the subject, type the class, words of the name are tags."""
    data = F.struct(
        F.col("p_brand").alias("_subject"), F.col("p_type").alias("_class"), F.array("p_type", F.concat(F.lit("size_"), (F.col("p_size") % 3).cast("string"))).alias("_domain"), F.split("p_name", " ").alias("_tag")
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.concat(F.lit("part_"), "p_partkey").alias("_key"), F.parse_json(F.to_json(data)).alias("_data"), F.col("p_size").alias("size"))


@query("""
WITH t AS (SELECT p_size, p_brand, p_type, unnest([p_type, 'size_' || (p_size % 3)]) AS dom FROM part), g AS (SELECT p_size, p_brand, p_type, unnest(string_split(p_name, ' ')) AS tag FROM part)
SELECT 'size ' || a.p_size AS request_id, subjects, classes, domains, tags FROM
 (SELECT p_size, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS subjects, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS classes, string_agg(DISTINCT dom, ',' ORDER BY dom) AS domains FROM t GROUP BY p_size) a
 JOIN (SELECT p_size, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM g GROUP BY p_size) b ON a.p_size = b.p_size
""", dictionary_sql=False)
def q1_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _part_descriptors(spark, sf_dir)
    asked = parts.select(F.concat(F.lit("size "), "size").alias("request_id"), F.col("_key").alias("key"))
    out = terms.qualification_summary(terms.qualifiers(parts), asked)
    return out.select("request_id", *(_joined(c).alias(c) for c in ("subjects", "classes", "domains", "tags")))


@query("SELECT 'part_' || p_partkey AS key, p_brand AS subject FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND list_has_any(string_split(p_name, ' '), ['red', 'bolt']) ORDER BY key LIMIT 25", dictionary_sql=False)
def q2_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = terms.qualifier_selection("AND", _class=["ECONOMY", "SMALL"], _tag=["red", "bolt"])
    return terms.query_descriptors(terms.qualifiers(_part_descriptors(spark, sf_dir)), where).select("key", F.col("_subject").alias("subject"))


# Edits


def _set_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers join geo's graph, customers become elements of their nations, and nations are set again."""
    text = """
    SELECT 'suppliers' AS request_id, 'terms/geo' AS root, 'terms/nation_' || s_nationkey AS parent, '_predicate_enum-of' AS predicate, 'terms/supplier_' || s_suppkey AS child, map() AS data FROM {supplier}
    UNION ALL SELECT 'customers', 'terms/geo', 'terms/nation_' || c_nationkey, '_predicate_enum-of', 'terms/customer_' || c_custkey, map('note', c_mktsegment) FROM {customer}
    UNION ALL SELECT 'nations', 'terms/geo', 'terms/region_' || n_regionkey, '_predicate_enum-of', 'terms/nation_' || n_nationkey, CAST(NULL AS MAP<STRING, STRING>) FROM {nation}
    """
    return sql(spark, sf_dir, text.replace("map() AS data", "CAST(map() AS MAP<STRING, STRING>) AS data"))


_SETS = """
rq AS (SELECT 'suppliers' AS request_id, 'terms/geo' AS root, 'terms/supplier_' || s_suppkey AS f, 'terms/nation_' || s_nationkey AS t FROM supplier
       UNION ALL SELECT 'customers', 'terms/geo', 'terms/customer_' || c_custkey, 'terms/nation_' || c_nationkey FROM customer
       UNION ALL SELECT 'nations', 'terms/geo', 'terms/nation_' || n_nationkey, 'terms/region_' || n_regionkey FROM nation),
ky AS (SELECT *, md5(concat_ws('/', f, '_predicate_enum-of', t)) AS edge_key FROM rq),
pl AS (SELECT ky.*, CASE WHEN NOT EXISTS (SELECT 1 FROM ep WHERE ep.edge_key = ky.edge_key) THEN 'inserted'
       WHEN NOT EXISTS (SELECT 1 FROM ep WHERE ep.edge_key = ky.edge_key AND ep.root = ky.root) THEN 'updated' ELSE 'existing' END AS action FROM ky)
"""


@query(f"{_SETS} SELECT request_id, edge_key, action FROM pl")
def w1_set_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = edits.plan_set_edges(dictionary(spark, sf_dir), edits.children(_set_requests(spark, sf_dir)))
    return plan.select("request_id", "edge_key", "action")


@query(f"""{_SETS},
al AS (SELECT edge_key, root FROM ep UNION SELECT edge_key, root FROM pl WHERE action <> 'existing')
SELECT n_roots, count(*) AS n_edges FROM (SELECT edge_key, count(DISTINCT root) AS n_roots FROM al GROUP BY edge_key) GROUP BY n_roots
""")
def w1_apply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    edges = edits.apply_edges(d.edges, edits.plan_set_edges(d, edits.children(_set_requests(spark, sf_dir))))
    return edges.groupBy(F.size("roots").cast("long").alias("n_roots")).agg(F.count("*").alias("n_edges"))


@query("""
rq AS (SELECT DISTINCT 'terms/geo' AS root, f, p, t, edge_key FROM ep WHERE p IN ('_predicate_enum-of', '_predicate_property-of')),
c AS (SELECT edge_key, count(DISTINCT root) AS n, max(CASE WHEN root = 'terms/geo' THEN 1 ELSE 0 END) AS hit FROM ep GROUP BY edge_key)
SELECT rq.edge_key, CASE WHEN hit = 0 THEN 'ignored' WHEN n = 1 THEN 'deleted' ELSE 'updated' END AS action FROM rq JOIN c ON rq.edge_key = c.edge_key
""")
def w3_delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.edges.where(F.col("predicate").isin(model.ENUM_OF, model.PROPERTY_OF)).select(
        F.lit("all").alias("request_id"), F.lit("terms/geo").alias("root"), "edge_key", "from", "predicate", "to", F.lit(None).cast("map<string,string>").alias("data")
    )
    return edits.plan_delete_edges(d, asked).select("edge_key", "action")


@query("""
q AS (SELECT 1) SELECT edge_key, CASE WHEN p = '_predicate_property-of' THEN 'deleted' ELSE 'updated' END AS action FROM ep WHERE root = 'terms/geo'
""")
def w3_delete_and_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.edges.where((F.col("predicate") == model.SECTION_OF) & F.array_contains("roots", "terms/geo")).select(
        F.col("from").alias("request_id"), F.lit("terms/geo").alias("root"), "edge_key", "from", "predicate", "to", F.lit(None).cast("map<string,string>").alias("data")
    )
    plan = edits.plan_delete_edges(d, asked, prune=True, sections=(model.ENUM_OF, model.PROPERTY_OF))
    return plan.select("edge_key", "action")


_LINK_REQUESTS = """
SELECT 'known' AS request_id, 'terms/part_' || p_partkey AS child, '_predicate_requires_metadata' AS predicate, 'terms/part_' || CAST(floor(p_partkey / 2) AS BIGINT) AS parent FROM {part}
UNION ALL SELECT 'new', 'terms/part_' || p_partkey, '_predicate_requires_metadata', 'terms/brand_' || replace(p_brand, 'Brand#', '') FROM {part}
"""
_LINK_SQL = "rq AS (" + _LINK_REQUESTS.format(part="part") + "), ky AS (SELECT rq.*, md5(concat_ws('/', child, predicate, parent)) AS edge_key FROM rq)"


@query(f"{_LINK_SQL} SELECT request_id, ky.edge_key, CASE WHEN lk.edge_key IS NULL THEN 'inserted' ELSE 'existing' END AS action FROM ky LEFT JOIN lk ON lk.edge_key = ky.edge_key")
def w7_set_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = sql(spark, sf_dir, _LINK_REQUESTS).withColumn("data", F.lit(None).cast("map<string,string>"))
    return edits.plan_set_links(dictionary(spark, sf_dir), edits.children(asked)).select("request_id", "edge_key", "action")


@query(f"{_LINK_SQL} SELECT request_id, CASE WHEN lk.edge_key IS NULL THEN 'ignored' ELSE 'deleted' END AS action, count(*) AS n FROM ky LEFT JOIN lk ON lk.edge_key = ky.edge_key GROUP BY ALL")
def w8_delete_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = sql(spark, sf_dir, _LINK_REQUESTS).withColumn("data", F.lit(None).cast("map<string,string>"))
    return edits.counters(edits.plan_delete_links(dictionary(spark, sf_dir), edits.children(asked)))


@query("""
rq AS (SELECT o_orderstatus AS request_id, 'terms/customer_' || o_custkey AS parent, 'terms/order_' || o_orderkey AS child FROM orders),
h AS (SELECT request_id, parent AS handle FROM rq UNION SELECT request_id, child FROM rq)
SELECT request_id, handle FROM h LEFT JOIN tm ON 'terms/' || k = handle WHERE k IS NULL
""")
def w9_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = orders.select(F.col("o_orderstatus").alias("request_id"), F.concat(F.lit("terms/customer_"), "o_custkey").alias("parent"), F.concat(F.lit("terms/order_"), "o_orderkey").alias("child"))
    return edits.orphans(dictionary(spark, sf_dir), asked)


# Validation

_RULES = {
    "quantity": '{"_scalar": {"_type": "_type_number", "_valid-range": {"_min-range-inclusive": 5, "_max-range-inclusive": 45}}}',
    "discount": '{"_scalar": {"_type": "_type_number", "_valid-range": {"_min-range-inclusive": 0, "_max-range-exclusive": 0.1}}}',
    "size": '{"_scalar": {"_type": "_type_number_integer", "_valid-range": {"_min-range-exclusive": 3, "_max-range-inclusive": 40}}}',
    "year": '{"_scalar": {"_type": "_type_string_date", "_valid-range_date": {"_max-range-inclusive_date": "1996"}}}',
    "shipped": '{"_scalar": {"_type": "_type_number_timestamp"}}',
    "nation": '{"_scalar": {"_type": "_type_string_enum", "_kind": ["geo"]}}',
    "brand": '{"_scalar": {"_type": "_type_string", "_regexp": "^Brand#[0-9]$"}}',
    "words": '{"_set": {"_set_scalar": {"_set_type": "_type_string"}, "_elements": {"_min-items": 2, "_max-items": 2}}}',
    "k": '{"_scalar": {"_type": "_type_number_integer", "_valid-range": {"_max-range-inclusive": 90}}}',
}


def rules(spark: SparkSession) -> DataFrame:
    """The descriptors of the validation queries."""
    rows = " UNION ALL ".join(f"SELECT '{k}' AS descriptor, parse_json('{v}') AS definition" for k, v in _RULES.items())
    return validate.descriptor_rules(spark.sql(rows), levels=2)


def _report(spark: SparkSession, sf_dir: str, name: str, table: str, key: Column, value: Column, **options) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key.alias("row_id"), F.lit(name).alias("descriptor"), value.cast("variant").alias("value"))
    return validate.validate(dictionary(spark, sf_dir), rules(spark).where(F.col("descriptor") == name), rows, levels=2, **options)


def _line() -> Column:
    return F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


@query("SELECT CASE WHEN l_quantity < 5 THEN 12 WHEN l_quantity > 45 THEN 13 ELSE 0 END AS code, count(*) AS n FROM lineitem GROUP BY 1", dictionary_sql=False)
def v2_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "quantity", "lineitem", _line(), F.col("l_quantity")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT count_if(l_discount < 0.1 AND l_discount >= 0) AS valid, 0::BIGINT AS warnings, count_if(NOT (l_discount < 0.1 AND l_discount >= 0)) AS errors, CASE WHEN count_if(NOT (l_discount < 0.1 AND l_discount >= 0)) > 0 THEN -1 ELSE 0 END AS status FROM lineitem", dictionary_sql=False)
def v2_discount_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(_report(spark, sf_dir, "discount", "lineitem", _line(), F.col("l_discount")), "descriptor").drop("descriptor")


@query("SELECT p_partkey AS row_id, CASE WHEN p_size <= 3 THEN 12 WHEN p_size > 40 THEN 13 ELSE 0 END AS code FROM part", dictionary_sql=False)
def v19_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "size", "part", F.col("p_partkey"), F.col("p_size")).select("row_id", "code")


@query("SELECT o_orderkey AS row_id, CASE WHEN year(o_orderdate) > 1996 THEN 13 ELSE 0 END AS code FROM orders", dictionary_sql=False)
def v27_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "year", "orders", F.col("o_orderkey"), F.year("o_orderdate").cast("string")).select("row_id", "code")


@query("SELECT o_orderkey AS row_id, 0 AS code, epoch_ms(o_orderdate)::VARCHAR AS resolved, 1 AS n_changes, md5('shipped' || chr(9) || epoch_ms(o_orderdate)) AS hash FROM orders", dictionary_sql=False)
def v21_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _report(spark, sf_dir, "shipped", "orders", F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return report.select("row_id", "code", "resolved", F.size("changes").alias("n_changes"), F.element_at("changes", 1)["hash"].alias("hash"))


@query("SELECT c_custkey AS row_id, CASE WHEN c_custkey % 10 = 0 THEN 30 ELSE 0 END AS code, CASE WHEN c_custkey % 10 = 0 THEN '\"x\"' ELSE '\"nation_' || c_nationkey || '\"' END AS resolved FROM customer", dictionary_sql=False)
def v26_resolve_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("c_custkey") % 10 == 0, "x").when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("nation_"), "c_nationkey")).otherwise(F.col("c_nationkey").cast("string"))
    return _report(spark, sf_dir, "nation", "customer", F.col("c_custkey"), value, resolve_field="_lid").select("row_id", "code", "resolved")


@query("SELECT p_partkey AS row_id, CASE WHEN regexp_matches(p_brand, '^Brand#[0-9]$') THEN 0 ELSE 17 END AS code FROM part", dictionary_sql=False)
def v22_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "brand", "part", F.col("p_partkey"), F.col("p_brand")).select("row_id", "code")


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, CASE p_size % 4 WHEN 0 THEN string_split(p_name, ' ')[1:1] WHEN 1 THEN list_concat(string_split(p_name, ' '), ['x']) WHEN 2 THEN [p_brand, p_brand] ELSE string_split(p_name, ' ') END AS v FROM part)
SELECT p_partkey AS row_id, CASE WHEN len(v) < 2 THEN 36 WHEN len(v) > 2 THEN 37 ELSE 0 END AS code,
 '["' || array_to_string(CASE WHEN len(v) = 2 AND v[1] = v[2] THEN v[1:1] ELSE v END, '","') || '"]' AS resolved, CASE WHEN len(v) = 2 AND v[1] = v[2] THEN 1 ELSE 0 END AS n_changes FROM w
""", dictionary_sql=False)
def v11_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, k = F.split("p_name", " "), F.col("p_size") % 4
    value = F.when(k == 0, F.slice(words, 1, 1)).when(k == 1, F.concat(words, F.array(F.lit("x")))).when(k == 2, F.array("p_brand", "p_brand")).otherwise(words)
    report = _report(spark, sf_dir, "words", "part", F.col("p_partkey"), F.transform(value, lambda x: x.cast("string")))
    return report.select("row_id", "code", "resolved", F.size("changes").alias("n_changes"))


@query("SELECT event_id AS row_id, CASE WHEN json_extract(props, '$.k')::INT > 90 THEN 13 ELSE 0 END AS code, CASE WHEN json_extract(props, '$.k')::INT > 90 THEN 'k' END AS property FROM events", dictionary_sql=False)
def v3_event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("row_id"), F.try_parse_json("props").alias("object"))
    return validate.validate_objects(dictionary(spark, sf_dir), rules(spark), rows, levels=1).select("row_id", "code", "property")


@query("SELECT c_custkey AS row_id, CASE WHEN c_nationkey % 3 = 0 THEN 34 WHEN c_nationkey % 3 = 1 THEN 32 ELSE 0 END AS code FROM customer", dictionary_sql=False)
def v31_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_nationkey") % 3
    made = F.when(k == 0, F.to_json(F.struct(F.lit("Brand#1").alias("brand")))).when(k == 1, F.to_json(F.struct(F.lit(9).alias("size"), F.lit(1).alias("other")))).otherwise(F.to_json(F.struct(F.lit(9).alias("size"))))
    rows = customers.select(F.col("c_custkey").alias("row_id"), F.parse_json(made).alias("object"), F.array(F.lit("thing")).alias("kinds"))
    definition = '{"_required": {"_selection-descriptors_one": ["size", "k"]}, "_banned": ["brand"]}'
    structures = validate.structure_rules(spark.sql(f"SELECT 'thing' AS structure, parse_json('{definition}') AS definition"))
    return validate.validate_objects(dictionary(spark, sf_dir), rules(spark), rows, structures, levels=1).select("row_id", "code")


# Evolution


@query("""
SELECT 'part_' || p_partkey AS key, CASE p_partkey % 6 WHEN 1 THEN 'identifier changed' WHEN 2 THEN 'num lower bound raised' WHEN 3 THEN 'type changed' WHEN 4 THEN 'data section removed' END AS violation FROM part WHERE p_partkey % 6 BETWEEN 1 AND 4
""", dictionary_sql=False)
def u1_diff_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("m", F.col("p_partkey") % 6)

    def version(nid: Column, type_: Column, low: Column, data: Column) -> DataFrame:
        code = F.struct(nid.alias("_nid"), F.col("p_partkey").cast("string").alias("_lid"), F.concat(F.lit("part_"), "p_partkey").alias("_gid"), F.array(F.col("p_partkey").cast("string")).alias("_aid"))
        scalar = F.struct(F.struct(type_.alias("_type"), F.struct(low.alias("_min-range-inclusive")).alias("_valid-range")).alias("_scalar"))
        return part.select(
            F.concat(F.lit("part_"), "p_partkey").alias("_key"), code.alias("_code"), F.when(data, F.parse_json(F.to_json(scalar))).alias("_data"), F.lit(None).cast("variant").alias("_rule")
        )

    old = version(F.lit("part"), F.lit("_type_number"), F.col("p_size"), F.lit(True))
    m = F.col("m")
    new = version(
        F.when(m == 1, "piece").otherwise("part"), F.when(m == 3, "_type_string").otherwise("_type_number"), F.col("p_size") + F.when(m == 2, 1).when(m == 5, -1).otherwise(0), m != 4
    )
    return evolve.diff_terms(old, new, levels=1).select(F.col("_key").alias("key"), "violation")


@query("""
WITH a AS (SELECT event_type, unnest(['value', 'user']) AS path, event_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS even FROM events)
SELECT path, CASE WHEN path = 'user' AND even = 1 THEN 'deleted' WHEN path = 'value' AND even = 1 THEN 'modified' ELSE 'same' END AS change, count(*) AS n FROM a GROUP BY ALL
""", dictionary_sql=False)
def u14_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    even = F.col("user_id") % 2 == 0
    old = events.select(F.col("event_id").alias("_key"), F.create_map(F.lit("value"), F.lit("1"), F.lit("user"), F.lit("2")).alias("doc"))
    new = events.select(F.col("event_id").alias("_key"), F.when(even, F.create_map(F.lit("value"), F.lit("3"))).otherwise(F.create_map(F.lit("value"), F.lit("1"), F.lit("user"), F.lit("2"))).alias("doc"))
    return evolve.changes(old, new).groupBy("path", "change").agg(F.count("*").alias("n"))


# Grids and measurements


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select("c_custkey", ((F.col("c_custkey") * 37) % 3600 / 100.0).alias("lon"), ((F.col("c_custkey") * 91) % 1800 / 100.0).alias("lat"), "c_acctbal")


@query("""
WITH p AS (SELECT c_custkey, (c_custkey * 37) % 3600 / 100.0 AS lon, (c_custkey * 91) % 1800 / 100.0 AS lat FROM customer),
c AS (SELECT DISTINCT (s_suppkey % 36)::INT AS i, (s_suppkey % 18)::INT AS j FROM supplier)
SELECT c_custkey, i || '_' || j AS cell_id FROM p JOIN c ON floor(lon) = i AND floor(lat) = j
""", dictionary_sql=False)
def x1_cells_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    cells = suppliers.select((F.col("s_suppkey") % 36).alias("i"), (F.col("s_suppkey") % 18).alias("j")).distinct()
    cells = cells.select(F.concat_ws("_", "i", "j").alias("cell_id"), F.col("i").cast("double").alias("west"), F.col("j").cast("double").alias("south"))
    return geo.cells_of_points(_points(spark, sf_dir), cells, 1.0).select("c_custkey", "cell_id")


@query("""
WITH p AS (SELECT c_custkey, (c_custkey * 37) % 3600 / 100.0 AS lon, (c_custkey * 91) % 1800 / 100.0 AS lat FROM customer),
c AS (SELECT DISTINCT (s_suppkey % 36) + 0.5 AS clon, (s_suppkey % 18) + 0.5 AS clat FROM supplier),
d AS (SELECT c_custkey, 2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2), 1.0))) AS distance FROM p JOIN c ON abs(clon - lon) < 2 AND abs(clat - lat) < 2)
SELECT c_custkey, count(*) AS n, round(min(distance), 3) AS nearest FROM d WHERE distance BETWEEN 1000 AND 100000 GROUP BY c_custkey
""", dictionary_sql=False)
def x2_within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    cells = suppliers.select((F.col("s_suppkey") % 36 + 0.5).alias("clon"), (F.col("s_suppkey") % 18 + 0.5).alias("clat")).distinct()
    near = geo.within_distance(_points(spark, sf_dir), cells, 1000.0, 100_000.0)
    return near.groupBy("c_custkey").agg(F.count("*").alias("n"), F.round(F.min("distance"), 3).alias("nearest"))


@query("""
SELECT strftime(ts, '%Y%m%d') AS span, count(*) AS n, min(ts)::DATE::VARCHAR AS first_date, max(ts)::DATE::VARCHAR AS last_date, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS terms FROM events GROUP BY 1
""", dictionary_sql=False)
def x8_measurement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(geo.span_of(F.col("ts"), "day").alias("span"), F.to_date("ts").cast("string").alias("date"), F.col("event_type").alias("term"), F.lit("events").alias("dataset"))
    return geo.measurement_summary(rows, ["span"]).select("span", "n", "first_date", "last_date", _joined("terms").alias("terms"))


@query("SELECT event_type, min(value) AS value_min, avg(value) AS value_avg, max(value) AS value_max, stddev_pop(value) AS value_std, var_pop(value) AS value_var FROM events GROUP BY 1", dictionary_sql=False)
def x3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geo.statistics(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], ["value"])
    return out


@query("q AS (SELECT 1) SELECT DISTINCT edge_key, f AS from_handle FROM ep")
def w14_edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = dictionary(spark, sf_dir).edges
    checked = validate.edge_keys(edges.withColumn("edge_key", F.when(F.col("edge_key") < "8", F.col("edge_key"))))
    return checked.where("code = 0").select(F.coalesce("edge_key", edge_key(F.col("from"), F.col("predicate"), F.col("to"))).alias("edge_key"), F.col("from").alias("from_handle"))


# More of the same families


@query("q AS (SELECT 1) SELECT DISTINCT lid AS request_id, k AS key, name AS title FROM tm JOIN ep ON f = 'terms/' || k AND p = '_predicate_enum-of' AND root = 'terms/catalog'")
def i5_enum_terms_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    codes = d.terms.select(F.col("_code._lid").alias("code")).distinct()
    asked = codes.select(F.col("code").alias("request_id"), F.lit("_lid").alias("field"), "code", F.lit("terms/catalog").alias("root"))
    return flat.enum_terms_by_code(d, asked).select("request_id", "key", F.col("_code._name").alias("title"))


@query("""
own AS (SELECT DISTINCT f FROM ep WHERE root = 'terms/supply' AND p = '_predicate_enum-of'),
up AS (SELECT t, arg_min(f, edge_key) AS f FROM ep WHERE root = 'terms/supply' AND p = '_predicate_enum-of' GROUP BY t)
SELECT DISTINCT lid AS request_id, coalesce(own.f, up.f) AS matched FROM tm LEFT JOIN own ON own.f = 'terms/' || k LEFT JOIN up ON up.t = 'terms/' || k
WHERE own.f IS NOT NULL OR (up.f IS NOT NULL AND nid IN ('region', 'nation'))
""")
def g9_match_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    codes = d.terms.select(F.col("_code._lid").alias("code")).distinct()
    asked = codes.select(F.col("code").alias("request_id"), F.lit("terms/supply").alias("root"), F.lit("_lid").alias("field"), "code")
    return walk.match_codes(d, asked, model.ENUM_OF)


@query("q AS (SELECT 1) SELECT k AS key, CASE WHEN nid = 'part' AND lid::INT % 2 = 0 THEN 'inserted' ELSE 'conflict' END AS action FROM (SELECT CASE WHEN nid = 'part' AND lid::INT % 2 = 0 THEN 'spare_' || lid ELSE k END AS k, nid, lid FROM tm)")
def t2_insert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    spare = F.expr("_code._nid = 'part' AND try_cast(_code._lid AS INT) % 2 = 0")
    new = d.terms.withColumn("_code", F.when(F.coalesce(spare, F.lit(False)), F.col("_code").withField("_nid", F.lit("spare"))).otherwise(F.col("_code")))
    return terms.plan_inserts(d.terms, new).select(F.col("_key").alias("key"), "action")


@query("w AS (SELECT DISTINCT f FROM lk UNION SELECT DISTINCT f || 'x' FROM lk) SELECT CASE WHEN k IS NULL THEN 'ignored' ELSE 'removed' END AS action, count(*) AS n FROM w LEFT JOIN tm ON 'terms/' || k = w.f GROUP BY 1")
def t5_delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    keys = d.links.select("from").unionByName(d.links.select(F.concat("from", F.lit("x")).alias("from"))).select(handle_key(F.col("from")).alias("_key"))
    return terms.plan_deletes(d.terms, keys).groupBy("action").agg(F.count("*").alias("n"))


@query("""
b AS (SELECT DISTINCT 'terms/brand_' || replace(p_brand, 'Brand#', '') AS f FROM part),
ky AS (SELECT md5(concat_ws('/', f, '_predicate_section-of', 'terms/catalog')) AS edge_key, 'terms/supply' AS root FROM b UNION ALL SELECT md5(concat_ws('/', f, '_predicate_section-of', 'terms/supply')), 'terms/supply' FROM b)
SELECT ky.edge_key, CASE WHEN count(ep.edge_key) = 0 THEN 'inserted' ELSE 'updated' END AS action FROM ky LEFT JOIN ep ON ep.edge_key = ky.edge_key GROUP BY ky.edge_key
""")
def w2_set_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("terms/brand_"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("child")).distinct()
    asked = brands.select(F.lit("r").alias("request_id"), F.lit("terms/supply").alias("root"), F.explode(F.array(F.lit("terms/catalog"), F.lit("terms/supply"))).alias("parent"), "child", F.lit(None).cast("map<string,string>").alias("data"))
    return edits.plan_set_edges(dictionary(spark, sf_dir), edits.children(edits.containers(asked))).select("edge_key", "action")


@query("""
b AS (SELECT DISTINCT root FROM ep), pr AS (SELECT a.root, b.root AS bridged FROM b a JOIN b ON a.root <> b.root),
ky AS (SELECT root || '>' || bridged AS request_id, root, md5(concat_ws('/', bridged, '_predicate_bridge-of', root)) AS edge_key FROM pr)
SELECT ky.request_id, CASE WHEN count(ep.edge_key) = 0 THEN 'inserted' ELSE 'existing' END AS action FROM ky LEFT JOIN ep ON ep.edge_key = ky.edge_key AND ep.root = ky.root GROUP BY ky.request_id
""")
def w5_set_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    known = [r["root"] for r in _roots(spark).collect()]  # the three roots of the fixture
    roots = d.edge_path.select("root").distinct()
    pairs = roots.withColumn("bridged", F.explode(F.array(*map(F.lit, known)))).where("root <> bridged")
    asked = pairs.select(F.concat("root", F.lit(">"), "bridged").alias("request_id"), "root", "bridged", F.lit(None).cast("map<string,string>").alias("data"))
    return edits.plan_set_edges(d, edits.children(edits.bridges(asked))).select("request_id", "action")


@query("""
h AS (SELECT DISTINCT o_orderstatus AS request_id, 'terms/customer_' || o_custkey AS handle FROM orders UNION SELECT DISTINCT o_orderstatus, 'orders/' || o_orderkey FROM orders)
SELECT request_id, handle, CASE WHEN k IS NULL THEN 'not a term' ELSE 'not a descriptor' END AS reason FROM h LEFT JOIN tm ON 'terms/' || k = handle
""")
def w11_not_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = orders.select(F.col("o_orderstatus").alias("request_id"), F.concat(F.lit("terms/customer_"), "o_custkey").alias("parent"), F.concat(F.lit("orders/"), "o_orderkey").alias("child"))
    return edits.not_descriptors(dictionary(spark, sf_dir), asked)


_MORE_RULES = {
    "deep": '{"_array": {"_array": {"_array": {"_array": {"_scalar": {"_type": "_type_number"}}}}}}',
    "flag": '{"_scalar": {"_type": "_type_boolean"}}',
    "anystruct": '{"_scalar": {"_type": "_type_struct"}}',
    "box": '{"_scalar": {"_type": "_type_object", "_kind": ["boxed"]}}',
    "anykey": '{"_scalar": {"_type": "_type_string_key", "_kind": ["_any-term"]}}',
    "enumkey": '{"_scalar": {"_type": "_type_string_key", "_kind": ["_any-enum"]}}',
    "handle": '{"_scalar": {"_type": "_type_string_handle"}}',
    "sizes": '{"_array": {"_scalar": {"_type": "_type_number_integer", "_valid-range": {"_max-range-inclusive": 40}}, "_elements": {"_min-items": 1, "_max-items": 3}}}',
    "pair": '{"_tuple": {"_tuple_types": ["anysize", "anytext"]}}',
    "anysize": '{"_scalar": {"_type": "_type_number_integer", "_valid-range": {"_max-range-inclusive": 40}}}',
    "anytext": '{"_scalar": {"_type": "_type_string"}}',
    "prices": '{"_dict": {"_dict_key": {"_type_key": "_type_string", "_regexp": "^[a-z]+$"}, "_dict_value": {"_scalar": {"_type": "_type_number", "_valid-range": {"_min-range-inclusive": 1000}}}}}',
    "place": '{"_scalar": {"_type": "_type_object_geojson"}}',
}


def _more(spark: SparkSession, sf_dir: str, names: list[str], table: str, key: Column, value: Column, levels: int | None) -> DataFrame:
    """Codes of the first of ``names``; the others are descriptors that it refers to."""
    definitions = " UNION ALL ".join(f"SELECT '{n}' AS descriptor, parse_json('{_MORE_RULES[n]}') AS definition" for n in names)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key.alias("row_id"), F.lit(names[0]).alias("descriptor"), value.alias("value"))
    return validate.validate(dictionary(spark, sf_dir), validate.descriptor_rules(spark.sql(definitions), levels), rows, levels=levels).select("row_id", "code")


@query("SELECT c_custkey AS row_id, CASE c_custkey % 5 WHEN 0 THEN 30 WHEN 1 THEN 23 WHEN 2 THEN 18 WHEN 3 THEN 21 ELSE 0 END AS code FROM customer", dictionary_sql=False)
def v23_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    value = F.when(k == 0, F.concat(F.lit("nobody_"), "c_custkey")).when(k == 1, "a b").when(k == 2, "").when(k == 3, ";").otherwise(F.concat(F.lit("customer_"), "c_custkey"))
    return _more(spark, sf_dir, ["anykey"], "customer", F.col("c_custkey"), value.cast("variant"), 1)


@query("SELECT p_partkey AS row_id, CASE WHEN p_partkey % 2 = 0 THEN 19 ELSE 0 END AS code FROM part", dictionary_sql=False)
def v23_enum_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("brand_"), F.replace("p_brand", F.lit("Brand#"), F.lit("")))).otherwise(F.concat(F.lit("part_"), "p_partkey"))
    return _more(spark, sf_dir, ["enumkey"], "part", F.col("p_partkey"), value.cast("variant"), 1)


@query("SELECT c_custkey AS row_id, CASE c_custkey % 6 WHEN 0 THEN 24 WHEN 1 THEN 25 WHEN 2 THEN 26 WHEN 3 THEN 23 WHEN 4 THEN 22 ELSE 0 END AS code FROM customer", dictionary_sql=False)
def v24_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    value = F.when(k == 0, "terms").when(k == 1, "te rms/x").when(k == 2, "users/x").when(k == 3, "terms/a b").when(k == 4, "terms/nobody").otherwise(F.concat(F.lit("terms/customer_"), "c_custkey"))
    return _more(spark, sf_dir, ["handle"], "customer", F.col("c_custkey"), value.cast("variant"), 1)


@query("SELECT p_partkey AS row_id, CASE p_size % 4 WHEN 0 THEN 36 WHEN 1 THEN 37 WHEN 2 THEN 35 ELSE CASE WHEN p_size > 40 THEN 13 ELSE 0 END END AS code FROM part", dictionary_sql=False)
def v10_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, "[]").when(k == 1, "[1, 2, 3, 4]").when(k == 2, size).otherwise(F.concat(F.lit("[1, "), size, F.lit("]")))
    return _more(spark, sf_dir, ["sizes"], "part", F.col("p_partkey"), F.parse_json(text), 2)


@query("SELECT p_partkey AS row_id, CASE p_size % 4 WHEN 0 THEN 49 WHEN 1 THEN 44 WHEN 2 THEN CASE WHEN p_size > 40 THEN 13 ELSE 16 END ELSE CASE WHEN p_size > 40 THEN 13 ELSE 0 END END AS code FROM part", dictionary_sql=False)
def v13_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, "[1]").when(k == 1, size).when(k == 2, F.concat(F.lit("["), size, F.lit(", 5]"))).otherwise(F.concat(F.lit("["), size, F.lit(', "x"]')))
    return _more(spark, sf_dir, ["pair", "anysize", "anytext"], "part", F.col("p_partkey"), F.parse_json(text), 2)


@query("SELECT p_partkey AS row_id, CASE p_size % 3 WHEN 0 THEN 31 WHEN 1 THEN 17 ELSE CASE WHEN p_retailprice < 1000 THEN 12 ELSE 0 END END AS code FROM part", dictionary_sql=False)
def v15_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("p_size") % 3, F.col("p_retailprice").cast("string")
    text = F.when(k == 0, price).when(k == 1, F.concat(F.lit('{"N7": '), price, F.lit("}"))).otherwise(F.concat(F.lit('{"price": '), price, F.lit("}")))
    return _more(spark, sf_dir, ["prices"], "part", F.col("p_partkey"), F.parse_json(text), 2)


@query("SELECT c_custkey AS row_id, CASE c_custkey % 5 WHEN 0 THEN 31 WHEN 1 THEN 38 WHEN 2 THEN 39 WHEN 3 THEN 40 ELSE 0 END AS code FROM customer", dictionary_sql=False)
def v30_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, F.col("c_custkey").cast("string")).when(k == 1, '{"coordinates": [1, 2]}').when(k == 2, '{"type": "Point"}').when(k == 3, '{"type": "Point", "coordinates": 3}')
    text = text.otherwise(F.concat(F.lit('{"type": "Point", "coordinates": ['), F.col("c_nationkey").cast("string"), F.lit(", 2]}")))
    return _more(spark, sf_dir, ["place"], "customer", F.col("c_custkey"), F.parse_json(text), 1)


@query("SELECT 'part_' || p_partkey AS structure, CASE p_partkey % 4 WHEN 1 THEN 'selector any has fewer options' WHEN 2 THEN 'banned list extended' ELSE 'selector one added' END AS violation FROM part WHERE p_partkey % 4 > 0", dictionary_sql=False)
def u10_structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part_"), "p_partkey").alias("structure"), (F.col("p_partkey") % 4).alias("m"))
    rule = lambda options, banned, more="": f'{{"_required": {{"_selection-descriptors_any": {options}{more}}}, "_banned": {banned}}}'
    old = part.select("structure", F.parse_json(F.lit(rule('["a", "b"]', '["z"]'))).alias("definition"))
    m = F.col("m")
    new = F.when(m == 1, rule('["a"]', '["z"]')).when(m == 2, rule('["a", "b"]', '["z", "y"]')).when(m == 3, rule('["a", "b"]', '["z"]', ', "_selection-descriptors_one": ["c"]')).otherwise(rule('["a", "b", "c"]', "[]"))
    return evolve.structure_violations(validate.structure_rules(old), validate.structure_rules(part.select("structure", F.parse_json(new).alias("definition"))))


@query("SELECT p_partkey AS row_id, CASE WHEN p_size % 2 = 0 THEN 10 ELSE 0 END AS code FROM part", dictionary_sql=False)
def v10_deep_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, '[[[[1, "x"]]]]').otherwise(F.concat(F.lit("[[[["), F.col("p_size").cast("string"), F.lit("]], []]]")))
    return _more(spark, sf_dir, ["deep"], "part", F.col("p_partkey"), F.parse_json(text), None)


@query("SELECT p_partkey AS row_id, CASE WHEN p_size % 3 = 0 THEN 8 ELSE 0 END AS code FROM part", dictionary_sql=False)
def v18_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    return _more(spark, sf_dir, ["flag"], "part", F.col("p_partkey"), F.parse_json(F.when(k == 0, F.lit("1")).when(k == 1, "true").otherwise("false")), 1)


@query("SELECT p_partkey AS row_id, CASE WHEN p_size % 3 = 2 THEN 0 ELSE 31 END AS code FROM part", dictionary_sql=False)
def v28_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    return _more(spark, sf_dir, ["anystruct"], "part", F.col("p_partkey"), F.parse_json(F.when(k == 0, F.lit("1")).when(k == 1, '"{}"').otherwise('{"a": {}}')), 1)


@query("""
SELECT p_partkey AS row_id, CASE p_partkey % 4 WHEN 0 THEN 34 WHEN 1 THEN CASE WHEN p_size > 40 THEN 13 ELSE 0 END WHEN 2 THEN 9 ELSE 31 END AS code,
       CASE WHEN p_partkey % 4 = 1 AND p_size <= 40 THEN NULL ELSE 'box' END AS property
FROM part
""", dictionary_sql=False)
def v29_nested_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["box", "anysize"]
    definitions = " UNION ALL ".join(f"SELECT '{n}' AS descriptor, parse_json('{_MORE_RULES[n]}') AS definition" for n in names)
    boxed = spark.sql("""SELECT 'boxed' AS structure, parse_json('{"_required": {"_selection-descriptors_all": ["anysize"]}}') AS definition""")
    known = spark.sql("SELECT t AS term, true AS is_descriptor FROM VALUES ('box'), ('anysize') AS v(t)")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.lit('{"box": {"other": 1}}')).when(k == 1, F.concat(F.lit('{"box": {"anysize": '), F.col("p_size").cast("string"), F.lit("}}")))
    text = text.when(k == 2, '{"box": {"anysize": "x"}}').otherwise('{"box": 3}')
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.parse_json(text).alias("object"))
    out = validate.validate_objects(dictionary(spark, sf_dir), validate.descriptor_rules(spark.sql(definitions)), rows, validate.structure_rules(boxed), known)
    return out.select("row_id", "code", "property")


@query("h AS (SELECT DISTINCT root, f FROM ep WHERE p = '_predicate_property-of') SELECT root AS request_id, f AS handle, name AS title FROM h LEFT JOIN tm ON 'terms/' || k = f")
def f9_property_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _roots(spark).withColumn("predicate", F.lit(model.PROPERTY_OF))
    return flat.functional_terms(dictionary(spark, sf_dir), asked, language=model.LANGUAGE).select("request_id", "handle", "title")


@query("""
n AS (SELECT DISTINCT name FROM tm),
m AS (SELECT name, min('terms/' || k) AS matched FROM (SELECT DISTINCT tm.name, tm.k FROM tm JOIN ep ON f = 'terms/' || k AND p = '_predicate_enum-of' AND root = 'terms/catalog') GROUP BY name)
SELECT n.name AS request_id, n.name AS code, matched FROM n LEFT JOIN m ON n.name = m.name
""")
def i6_first_enum_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _names(spark, sf_dir).withColumn("root", F.lit("terms/catalog"))
    return flat.check_enum_codes(dictionary(spark, sf_dir), asked, first=True)


@query("""
rq AS (SELECT DISTINCT edge_key FROM ep WHERE p IN ('_predicate_enum-of', '_predicate_property-of')),
al AS (SELECT DISTINCT ep.edge_key, ep.root FROM ep LEFT JOIN rq ON rq.edge_key = ep.edge_key WHERE rq.edge_key IS NULL OR ep.root <> 'terms/geo')
SELECT edge_key, string_agg(root, ',' ORDER BY root) AS roots FROM al GROUP BY edge_key
""")
def w3_apply_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.edges.where(F.col("predicate").isin(model.ENUM_OF, model.PROPERTY_OF)).select(
        F.lit("all").alias("request_id"), F.lit("terms/geo").alias("root"), "edge_key", "from", "predicate", "to", F.lit(None).cast("map<string,string>").alias("data")
    )
    return edits.apply_edges(d.edges, edits.plan_delete_edges(d, asked)).select("edge_key", _joined("roots").alias("roots"))


@query(f"{_LINK_SQL} SELECT DISTINCT edge_key, child AS from_handle, parent AS to_handle FROM ky UNION SELECT edge_key, f, t FROM lk")
def w7_apply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = sql(spark, sf_dir, _LINK_REQUESTS).withColumn("data", F.lit(None).cast("map<string,string>"))
    twice = asked.unionByName(asked.withColumn("request_id", F.concat("request_id", F.lit(" again"))))
    return edits.apply_links(d.links, edits.plan_set_links(d, edits.children(twice))).select("edge_key", F.col("from").alias("from_handle"), F.col("to").alias("to_handle"))


# Updates of documents, and operators around them


_TITLED = "STRUCT<_title: MAP<STRING, STRING>, _definition: MAP<STRING, STRING>, _description: MAP<STRING, STRING>, _examples: MAP<STRING, STRING>, _notes: MAP<STRING, STRING>, _provider: STRING>"


def _part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as descriptors of an array of numbers, the least of which is their size, with two remarks."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartition("p_partkey").withColumn("m", F.col("p_partkey") % 6)
    lid = F.col("p_partkey").cast("string")
    none = F.lit(None).cast("array<string>").alias("_pid")
    code = F.struct(F.lit("part").alias("_nid"), lid.alias("_lid"), F.concat(F.lit("part_"), lid).alias("_gid"), F.array(lid, "p_brand").alias("_aid"), none, F.col("p_name").alias("_name"))
    info = F.from_json(F.to_json(F.struct(F.create_map(F.lit(model.LANGUAGE), F.col("p_name")).alias("_title"))), _TITLED)
    scalar = F.struct(F.lit("_type_number").alias("_type"), F.struct(F.col("p_size").alias("_min-range-inclusive")).alias("_valid-range"))
    data = F.struct(F.struct(scalar.alias("_scalar")).alias("_array"), F.array(F.lit("a"), F.col("p_type")).alias("_remarks"))
    return part.select(F.concat(F.lit("part_"), lid).alias("_key"), code.alias("_code"), info.alias("_info"), F.parse_json(F.to_json(data)).alias("_data"), F.lit(None).cast("variant").alias("_rule"), "p_size", "m")


def _part_updates(parts: DataFrame) -> DataFrame:
    """By the key's remainder by six: widen the range, narrow it, retitle in another language, name a missing path, change nothing, ask for an unknown key."""
    m = F.col("m")
    low = lambda by: F.concat(F.lit('{"_data":{"_array":{"_scalar":{"_valid-range":{"_min-range-inclusive":'), (F.col("p_size") + by).cast("string"), F.lit("}}},"), F.lit('"_remarks":["b",null]}}'))
    body = F.when(m == 0, low(-1)).when(m == 1, low(1)).when(m == 2, '{"_info":{"_title":{"other":"x"}}}').otherwise(low(0))
    bound = "_data._array._scalar._valid-range._min-range-inclusive"
    paths = F.when(m == 0, F.array(F.lit(bound), F.lit("_data._remarks[0]"), F.lit("_data._remarks[1]"))).when(m == 1, F.array(F.lit(bound))).when(m == 2, F.array(F.lit("_info._title")))
    paths = paths.when(m == 3, F.array(F.lit("_data._nothing[0]"))).otherwise(F.array(F.lit(bound)))
    key = F.when(m == 5, F.concat("_key", F.lit("x"))).otherwise(F.col("_key"))
    return parts.select(key.alias("_key"), F.parse_json(body).alias("updates"), paths.alias("references"))


_UPDATED = """
WITH w AS (SELECT p_partkey % 6 AS m, p_size, p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 'part_' || p_partkey || 'x' ELSE 'part_' || p_partkey END AS key FROM part)
"""


@query(f"""{_UPDATED}
SELECT key, CASE m WHEN 0 THEN 'updated' WHEN 1 THEN 'refused' WHEN 2 THEN 'invalid' WHEN 3 THEN 'failed' WHEN 4 THEN 'same' ELSE 'unknown' END AS action,
 CASE m WHEN 1 THEN 'num lower bound raised' WHEN 3 THEN '_data._nothing[0]: no such value in the updates' END AS reason, CASE m WHEN 2 THEN 42 ELSE 0 END AS code,
 CASE m WHEN 0 THEN p_size - 1 WHEN 4 THEN p_size ELSE -99 END AS low FROM w
""", dictionary_sql=False)
def t13_update_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _part_terms(spark, sf_dir)
    d = dictionary(spark, sf_dir)
    plan = updates.plan_updates(type(d)(parts.drop("p_size", "m"), d.edges, d.links), _part_updates(parts))
    low = F.try_variant_get("term._data", "$._array._scalar['_valid-range']['_min-range-inclusive']", "int")
    return plan.select(F.col("_key").alias("key"), "action", "reason", "code", F.coalesce(low, F.lit(-99)).alias("low"))


@query("SELECT p_partkey % 6 AS m, CASE p_partkey % 6 WHEN 0 THEN '[\"b\"]' ELSE '[\"a\",\"' || p_type || '\"]' END AS remarks, count(*) AS n FROM part GROUP BY ALL", dictionary_sql=False)
def t13_apply_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _part_terms(spark, sf_dir)
    d = dictionary(spark, sf_dir)
    old = parts.drop("p_size", "m")
    new = updates.apply_updates(old, updates.plan_updates(type(d)(old, d.edges, d.links), _part_updates(parts)))
    rows = new.select((F.col("_code._lid").cast("long") % 6).alias("m"), F.to_json(updates.value_at(F.col("_data"), F.lit("_remarks"))).alias("remarks"))
    return rows.groupBy("m", "remarks").agg(F.count("*").alias("n"))


@query("SELECT 'part_' || p_partkey AS key, CASE p_size % 3 WHEN 0 THEN '\"' || p_type || '\"' WHEN 1 THEN '\"_type_number\"' END AS found FROM part", dictionary_sql=False)
def t15_value_at_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, k = _part_terms(spark, sf_dir), F.col("p_size") % 3
    path = F.when(k == 0, "_remarks[1]").when(k == 1, "_array._scalar._type").otherwise("_remarks[7]._kind")
    return parts.select(F.col("_key").alias("key"), F.to_json(updates.value_at(F.col("_data"), path)).alias("found"))


@query("SELECT 'part_' || p_partkey AS descriptor, CASE WHEN p_size % 5 < 3 THEN p_type || ',' || p_brand ELSE '' END AS kinds FROM part", dictionary_sql=False)
def q5_enum_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerations bare, in an array of arrays and in an array of sets; strings and the values of dictionaries have none."""
    form = F.col("p_size") % 5
    text = (
        F.when(form == 0, '{"_scalar": {"_type": "_type_string_enum", "_kind": KINDS}}')
        .when(form == 1, '{"_array": {"_array": {"_scalar": {"_type": "_type_string_enum", "_kind": KINDS}}}}')
        .when(form == 2, '{"_array": {"_set": {"_set_scalar": {"_set_type": "_type_string_enum", "_kind": KINDS}}}}')
        .when(form == 3, '{"_scalar": {"_type": "_type_string_key", "_kind": KINDS}}')
        .otherwise('{"_dict": {"_dict_key": {"_type_key": "_type_string"}, "_dict_value": {"_scalar": {"_type": "_type_string_enum", "_kind": KINDS}}}}')
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    definition = F.parse_json(F.replace(text, F.lit("KINDS"), F.to_json(F.array("p_type", "p_brand"))))
    made = validate.descriptor_rules(part.select(F.concat(F.lit("part_"), "p_partkey").alias("descriptor"), definition.alias("definition")))
    return terms.enum_kinds(made).select("descriptor", _joined("kinds").alias("kinds"))


@query("""
r AS (SELECT DISTINCT root, root AS node, 0 AS depth FROM ep UNION SELECT r.root, ep.f, depth + 1 FROM r JOIN (SELECT DISTINCT t, f FROM ep) ep ON ep.t = r.node WHERE depth < 9),
e AS (SELECT DISTINCT n.root, ep.t, ep.p, ep.f FROM (SELECT DISTINCT root, node FROM r) n JOIN ep ON ep.t = n.node WHERE ep.p IN ('_predicate_property-of', '_predicate_bridge-of'))
SELECT root AS request_id, t AS parent, count(DISTINCT p) AS n_predicates, count_if(p = '_predicate_property-of') AS n_properties FROM e GROUP BY root, t
""")
def a3_tree_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walk.tree_dictionary(walk.property_tree(dictionary(spark, sf_dir), _roots(spark)))
    properties = F.coalesce(F.size(F.try_element_at("children", F.lit(model.PROPERTY_OF))), F.lit(0))
    return out.select("request_id", "parent", F.size("children").cast("long").alias("n_predicates"), F.greatest(properties, F.lit(0)).cast("long").alias("n_properties"))


@query("""
SELECT 'part_' || p_partkey || CASE WHEN p_size % 7 = 0 THEN ' ' ELSE '' END AS key, CASE WHEN p_size % 7 = 0 THEN 23 WHEN p_size % 7 IN (1, 2) THEN 42 ELSE 0 END AS code FROM part
""", dictionary_sql=False)
def v4_default_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 7
    texts = lambda language, field: F.to_json(F.struct(F.create_map(F.lit(language), F.lit("x")).alias(field)))
    info = F.when(k == 1, texts("other", "_title")).when(k == 2, texts("other", "_notes")).when(k == 3, "{}").otherwise(texts(model.LANGUAGE, "_definition"))
    key = F.concat("_key", F.when(k == 0, " ").otherwise(""))
    parts = _part_terms(spark, sf_dir).select(key.alias("_key"), F.from_json(info, _TITLED).alias("_info"))
    return updates.term_codes_of(parts).select(F.col("_key").alias("key"), "code")


@query("""
WITH w AS (SELECT c_custkey, unnest([0, 1, 2]) AS pos, c_acctbal, c_nationkey FROM customer)
SELECT c_custkey AS row_id, pos::INT AS pos, CASE pos WHEN 0 THEN CASE WHEN c_nationkey <= 3 THEN 12 WHEN c_nationkey > 40 THEN 13 ELSE 0 END WHEN 1 THEN 17 ELSE 28 END AS code FROM w
""", dictionary_sql=False)
def v6_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("row_id"),
        F.array(F.lit("size"), F.lit("brand"), F.lit("nobody")).alias("descriptors"),
        F.array(F.col("c_nationkey").cast("variant"), F.col("c_name").cast("variant"), F.col("c_name").cast("variant")).alias("values"),
    )
    return validate.validate_any(dictionary(spark, sf_dir), rules(spark), rows, levels=2).select("row_id", "pos", "code")


@query("SELECT event_type, CASE WHEN user_id % 3 = 0 THEN true ELSE false END AS empty, count(*) AS n FROM events GROUP BY ALL", dictionary_sql=False)
def w13_empty_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id") % 3
    value = F.when(k == 0, F.parse_json(F.lit("{}"))).when(k == 1, F.parse_json(F.lit("[]"))).otherwise(F.try_parse_json("props"))
    return events.select("event_type", is_empty_object(value).alias("empty")).groupBy("event_type", "empty").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT c_custkey % 4 AS m, c_custkey AS k FROM customer)
SELECT CASE m WHEN 0 THEN 'customer_' || k WHEN 3 THEN 'client_' || k || ' b' ELSE 'client_' || k END AS key, CASE m WHEN 0 THEN 'conflict' WHEN 1 THEN 'inserted' ELSE 'invalid' END AS action FROM w
""", dictionary_sql=False)
def t1_checked_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers again, then as new terms: sound ones, ones without a text in the default language, and ones with a space in the key."""
    d, m = dictionary(spark, sf_dir), F.col("c_custkey") % 4
    lid = F.concat(F.col("c_custkey").cast("string"), F.when(m == 3, " b").otherwise(""))
    none = F.lit(None).cast("string")
    code = F.struct(F.when(m == 0, "customer").otherwise("client").alias("_nid"), lid.alias("_lid"), none.alias("_gid"), F.array(lid).alias("_aid"), F.array().cast("array<string>").alias("_pid"), F.col("c_name").alias("_name"))
    text = F.to_json(F.struct(F.create_map(F.when(m == 2, "other").otherwise(model.LANGUAGE), F.col("c_name")).alias("_title")))
    empty = F.lit(None).cast("variant")
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").select(none.alias("_key"), code.alias("_code"), F.from_json(text, _TITLED).alias("_info"), empty.alias("_data"), empty.alias("_rule"))
    return updates.plan_checked_inserts(d, new).select(F.col("_key").alias("key"), "action")


@query("q AS (SELECT 1) SELECT k AS key, CASE WHEN lid LIKE '%3' THEN 'ignored' ELSE 'removed' END AS action FROM (SELECT CASE WHEN lid LIKE '%3' THEN k || 'x' ELSE k END AS k, lid FROM tm)")
def t4_delete_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = dictionary(spark, sf_dir).terms
    asked = known.select(F.concat("_key", F.when(F.col("_code._lid").endswith("3"), "x").otherwise("")).alias("_key"))
    return terms.plan_deletes(known, asked).select(F.col("_key").alias("key"), "action")


@query("SELECT 'part_' || p_partkey AS key FROM part WHERE p_type IN ('ECONOMY', 'SMALL') OR list_has_any(string_split(p_name, ' '), ['red', 'bolt']) OR 'size_1' IN (p_type, 'size_' || (p_size % 3))", dictionary_sql=False)
def q3_any_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    qualified = terms.qualifiers(_part_descriptors(spark, sf_dir))
    return qualified.where(terms.qualifier_selection("OR", _class=["ECONOMY", "SMALL"], _tag=["red", "bolt"], _domain=["size_1"])).select("key")


@query("q AS (SELECT 1) SELECT nid, CASE WHEN nid = 'supplier' THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM tm WHERE nid <> 'brand' GROUP BY ALL")
def s6_replace_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers get a new version, brands go; new rows whose key is unknown are not taken."""
    old = dictionary(spark, sf_dir).terms.select("_key", F.col("_code._nid").alias("nid"), F.lit("old").alias("version"))
    new = old.where("nid = 'supplier'").withColumn("version", F.lit("new"))
    unknown = new.withColumn("_key", F.concat("_key", F.lit("x")))
    kept = tables.remove(tables.replace(old, new.unionByName(unknown), "_key"), old.where("nid = 'brand'").select("_key"), "_key")
    return kept.where("nid IS NOT NULL").groupBy("nid", "version").agg(F.count("*").alias("n"))


# Nested values, corrected documents, faults of definitions


_NESTED_RULES = {
    **{n: _MORE_RULES[n] for n in ("anysize", "anytext", "box", "pair", "flag")},
    "crates": '{"_array": {"_dict": {"_dict_key": {"_type_key": "_type_string"}, "_dict_value": {"_scalar": {"_type": "_type_object", "_kind": ["boxed"]}}}}}',
    "made": '{"_scalar": {"_type": "_type_number_timestamp"}}',
    "origin": '{"_scalar": {"_type": "_type_string_enum", "_kind": ["geo"]}}',
    "byplace": '{"_dict": {"_dict_key": {"_type_key": "_type_string_enum", "_kind": ["geo"]}, "_dict_value": {"_array": {"_scalar": {"_type": "_type_number_timestamp"}}}}}',
    "bag": '{"_array": {"_set": {"_set_scalar": {"_set_type": "_type_string_enum", "_kind": ["geo"]}}}}',
    "trip": '{"_tuple": {"_tuple_types": ["made", "byplace"]}}',
}
_BOXED = """SELECT 'boxed' AS structure, parse_json('{"_required": {"_selection-descriptors_all": ["anysize"]}}') AS definition"""


def _definitions(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS descriptor, parse_json('{v}') AS definition" for n, v in named.items()))


def _nested_options(spark: SparkSession) -> dict[str, DataFrame]:
    """Structures, and names that are terms: all descriptors of ``_NESTED_RULES``, and ``plain``, which is none."""
    known = spark.createDataFrame([*((n, True) for n in _NESTED_RULES), ("plain", False)], "term string, is_descriptor boolean")
    return {"structures": validate.structure_rules(spark.sql(_BOXED)), "descriptors": known}


def _nested_values(spark: SparkSession, sf_dir: str, name: str, text: Column, **options) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.lit(name).alias("descriptor"), F.parse_json(text).alias("value"))
    rules_ = validate.descriptor_rules(_definitions(spark, _NESTED_RULES))
    return validate.validate(dictionary(spark, sf_dir), rules_, rows, **_nested_options(spark), **options)


@query("""
SELECT p_partkey AS row_id, CASE p_partkey % 8 WHEN 0 THEN 34 WHEN 1 THEN CASE WHEN p_size > 40 THEN 13 ELSE 32 END WHEN 2 THEN CASE WHEN p_size > 40 THEN 13 ELSE 29 END
 WHEN 5 THEN 31 WHEN 6 THEN 34 WHEN 7 THEN 31 ELSE CASE WHEN p_size > 40 THEN 13 ELSE 0 END END AS code FROM part
""", dictionary_sql=False)
def v29_objects_in_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    wrap = lambda a, b: F.concat(F.lit(a), size, F.lit(b))
    text = F.when(k == 0, F.lit('[{"a": {"other": 1}}]')).when(k == 1, wrap('[{"a": {"anysize": ', ', "what": 1}}]')).when(k == 2, wrap('[{"a": {"anysize": ', ', "plain": 1}}]'))
    text = text.when(k == 3, wrap('[{}, {"b": {"anysize": ', "}}]")).when(k == 4, wrap('[{"a": {"anysize": 1, "box": {"anysize": 2, "box": {"anysize": ', "}}}}]")).when(k == 5, '[{"a": 3}]')
    text = text.when(k == 6, '[{"a": {"anysize": 1, "box": {"anysize": 2, "box": {"box": 3}}}}]').otherwise('[{"a": {"anysize": 1}}, 5]')
    return _nested_values(spark, sf_dir, "crates", text).select("row_id", "code")


@query("SELECT p_partkey AS row_id, CASE p_partkey % 4 WHEN 0 THEN 34 WHEN 1 THEN CASE WHEN p_size > 40 THEN 13 ELSE 0 END WHEN 2 THEN 31 ELSE CASE WHEN p_size > 40 THEN 13 ELSE 32 END END AS code FROM part", dictionary_sql=False)
def v1_object_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.lit('{"other": 1}')).when(k == 1, F.concat(F.lit('{"anysize": '), size, F.lit("}"))).when(k == 2, "3").otherwise(F.concat(F.lit('{"anysize": '), size, F.lit(', "zzz": 1}')))
    return _nested_values(spark, sf_dir, "box", text).select("row_id", "code")


_TUPLES = {
    "t0": '{"_tuple": {"_tuple_types": ["anysize", "missing"]}}',
    "t1": '{"_tuple": {"_tuple_types": ["anysize", "plain"]}}',
    "t2": '{"_tuple": {}}',
    "t3": '{"_tuple": {"_tuple_types": "anysize"}}',
    "t4": '{"_tuple": {"_tuple_types": ["anysize"], "_elements": 3}}',
    "t5": '{"_tuple": {"_tuple_types": ["anysize"], "_elements": {"_min-items": 2}}}',
    "t6": '{"_tuple": {"_tuple_types": ["anysize"], "_elements": {"_max-items": 2}}}',
    "t7": '{"_tuple": {"_tuple_types": ["anysize", "pair"]}}',
}


@query("""
SELECT p_partkey AS row_id, CASE p_partkey % 8 WHEN 0 THEN 30 WHEN 1 THEN 5 WHEN 2 THEN 48 WHEN 3 THEN 47 WHEN 4 THEN 52 WHEN 5 THEN 50 WHEN 6 THEN 51
 ELSE CASE WHEN p_size > 40 THEN 13 ELSE 16 END END AS code FROM part
""", dictionary_sql=False)
def v14_tuple_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("["), size, F.lit(", [1, 2]]"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("t"), (F.col("p_partkey") % 8).cast("string")).alias("descriptor"), F.parse_json(text).alias("value"))
    rules_ = validate.descriptor_rules(_definitions(spark, _NESTED_RULES | _TUPLES))
    return validate.validate(dictionary(spark, sf_dir), rules_, rows, **_nested_options(spark)).select("row_id", "code")


_BAD = [
    ("{}", None, None), ('{"x": 1}', "", -1), ('{"_scalar": {}}', None, None), ('{"_scalar": {"_unit": "m"}}', "_scalar", -2), ('{"_scalar": {"_type": "_type_blob"}}', "_scalar", 15),
    ('{"_scalar": {"_type": 5}}', "_scalar", 15), ('{"_scalar": 5}', "", -2), ('{"_array": {"_elements": {"_min-items": 1}}}', "_array", -1), ('{"_array": {"_elements": 3, "_scalar": {}}}', "_array", 52),
    ('{"_array": {"_array": {"_array": {"_scalar": {"_type": "no"}}}}}', "_array._array._array._scalar", 15), ('{"_set": {}}', "_set", -3), ('{"_set": {"_set_scalar": []}}', "_set", -3),
    ('{"_set": {"_set_scalar": {"_set_type": "_type_object"}}}', "_set._set_scalar", 15), ('{"_set": {"_set_scalar": {"_kind": []}}}', "_set._set_scalar", -2), ('{"_tuple": {}}', "_tuple", 48),
    ('{"_tuple": {"_tuple_types": "a"}}', "_tuple", 47), ('{"_tuple": {"_tuple_types": ["anysize"], "_elements": []}}', "_tuple", 52), ('{"_tuple": {"_tuple_types": ["anysize"], "_elements": {"_min-items": 2}}}', "_tuple", 50),
    ('{"_tuple": {"_tuple_types": ["anysize"], "_elements": {"_max-items": 2}}}', "_tuple", 51), ('{"_tuple": {"_tuple_types": ["anysize", "nobody"]}}', "_tuple", 30), ('{"_tuple": {"_tuple_types": ["plain"]}}', "_tuple", 5),
    ('{"_dict": {"_dict_value": {}}}', "_dict", -4), ('{"_dict": {"_dict_key": 1, "_dict_value": {}}}', "_dict", -6), ('{"_dict": {"_dict_key": {"_regexp": "a"}, "_dict_value": {}}}', "_dict._dict_key", -6),
    ('{"_dict": {"_dict_key": {}}}', "_dict", -5), ('{"_dict": {"_dict_key": {}, "_dict_value": []}}', "_dict", -7), ('{"_dict": {"_dict_key": {"_type_key": "_type_number"}, "_dict_value": {}}}', "_dict._dict_key", 15),
    ('{"_dict": {"_dict_key": {}, "_dict_value": {"_dict": {"_dict_key": {}, "_dict_value": {"_set": {"_set_scalar": {"_unit": 1}}}}}}}', "_dict._dict_value._dict._dict_value._set._set_scalar", -2), ("[1]", "", -1),
]


@query(f"""
WITH bad(k, path, code, status) AS (VALUES {", ".join(f"({k}, '{path}', {code}, '{model.STATUS[code]}')" for k, (_, path, code) in enumerate(_BAD) if code is not None)})
SELECT 'part_' || p_partkey AS descriptor, path, code, status FROM part JOIN bad ON p_partkey % {len(_BAD)} = k
""", dictionary_sql=False)
def v41_bad_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % len(_BAD)
    text = F.element_at(F.array(*[F.lit(t) for t, *_ in _BAD]), (k + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part_"), "p_partkey").alias("descriptor"), F.parse_json(text).alias("definition"))
    return definitions.first_fault(definitions.definition_faults(rows, _nested_options(spark)["descriptors"]))


@query("""
SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 2 THEN 30 ELSE 0 END AS code,
 CASE p_partkey % 3 WHEN 0 THEN '{"nation_' || p_size % 20 || '":[0,1000]}' WHEN 1 THEN '{"nation_' || p_size % 20 || '":[' || p_size || ']}'
   ELSE '{"' || p_size % 20 || '":["1970-01-01T00:00:01Z"],"x":[]}' END AS resolved,
 CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 1 END AS n_changes
FROM part
""", dictionary_sql=False)
def v16_renamed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lid, size = F.col("p_partkey") % 3, (F.col("p_size") % 20).cast("string"), F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit('{"'), lid, F.lit('": ["1970-01-01T00:00:00Z", "1970-01-01T00:00:01Z"]}')))
    text = text.when(k == 1, F.concat(F.lit('{"'), lid, F.lit('": ['), size, F.lit("]}"))).otherwise(F.concat(F.lit('{"'), lid, F.lit('": ["1970-01-01T00:00:01Z"], "x": []}')))
    out = _nested_values(spark, sf_dir, "byplace", text, resolve_field="_lid")
    return out.select("row_id", "code", "resolved", F.size("changes").alias("n_changes"))


@query("""
SELECT p_partkey AS row_id, CASE WHEN p_size > 40 THEN 13 ELSE 0 END AS code, CASE WHEN p_size > 40 THEN 'anysize' END AS property,
 CASE WHEN p_size > 40 THEN '{"anysize":' || p_size || ',"bag":[["1","nation_1"],[]],"box":{"anysize":1,"made":"1970-01-01T00:00:02Z"},"trip":["1970-01-01T00:00:01Z",{"2":[7]}]}'
  ELSE '{"anysize":' || p_size || ',"bag":[["nation_1"],[]],"box":{"anysize":1,"made":2000},"trip":[1000,{"nation_2":[7]}]}' END AS resolved,
 CASE WHEN p_size > 40 THEN '' ELSE 'bag ["nation_1"];bag nation_1;made 2000;trip 1000;trip nation_2' END AS changed
FROM part
""", dictionary_sql=False)
def v3_corrected_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"anysize": '), F.col("p_size").cast("string"), F.lit(', "bag": [["1", "nation_1"], []], "box": {"anysize": 1, "made": "1970-01-01T00:00:02Z"}, "trip": ["1970-01-01T00:00:01Z", {"2": [7]}]}'))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.parse_json(text).alias("object"))
    rules_ = validate.descriptor_rules(_definitions(spark, _NESTED_RULES))
    out = validate.validate_objects(dictionary(spark, sf_dir), rules_, rows, **_nested_options(spark), resolve_field="_lid")
    changed = F.array_join(F.array_sort(F.transform("changes", lambda c: F.concat_ws(" ", c["field"], c["resolved"]))), ";")
    return out.select("row_id", "code", "property", "resolved", changed.alias("changed"))


@query("""
WITH w AS (SELECT p_partkey, p_size, unnest([1, 2, 3, 4, 5, 6]) AS position FROM part)
SELECT 'part_' || p_partkey AS key, position, CASE position WHEN 1 THEN 'updated' WHEN 2 THEN 'refused' WHEN 3 THEN 'updated' WHEN 4 THEN 'same' WHEN 5 THEN 'refused' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'invalid' ELSE 'updated' END END AS action,
 CASE position WHEN 1 THEN p_size - 3 WHEN 3 THEN p_size - 5 WHEN 4 THEN p_size - 5 WHEN 6 THEN CASE WHEN p_partkey % 2 = 0 THEN -99 ELSE p_size - 5 END ELSE -99 END AS low,
 CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE 'x' END AS final_title, p_size - 5 AS final_low
FROM w
""", dictionary_sql=False)
def t13_repeated_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six requests for each part: lower the bound by 3, raise it by 1 against that, lower it by 5, the same again, by 4, and another title, in a language that half may use."""
    parts = _part_terms(spark, sf_dir)
    d = dictionary(spark, sf_dir)
    old = parts.drop("p_size", "m")
    bound = "_data._array._scalar._valid-range._min-range-inclusive"
    low = lambda by: F.concat(F.lit('{"_data":{"_array":{"_scalar":{"_valid-range":{"_min-range-inclusive":'), (F.col("p_size") - by).cast("string"), F.lit("}}}}}"))
    odd = F.col("_code._lid").cast("long") % 2 == 1
    title = F.when(odd, F.lit(f'{{"_info":{{"_title":{{"{model.LANGUAGE}":"x"}}}}}}')).otherwise(F.lit('{"_info":{"_title":{"other":"y"}}}'))
    bodies = F.array(low(3), low(2), low(5), low(5), low(4), title)
    asked = parts.select("_key", F.posexplode(bodies).alias("position", "body"))
    paths = F.when(F.col("position") == 5, F.array(F.lit("_info._title"))).otherwise(F.array(F.lit(bound)))
    asked = asked.select("_key", F.parse_json("body").alias("updates"), paths.alias("references"), F.col("position").cast("long").alias("position"))
    base = type(d)(old, d.edges, d.links)
    plan = updates.plan_updates(base, asked)
    low_of = lambda data: F.try_variant_get(data, "$._array._scalar['_valid-range']['_min-range-inclusive']", "int")
    final = updates.apply_updates(old, plan).select(F.col("_key").alias("key"), F.element_at("_info._title", model.LANGUAGE).alias("title"), low_of(F.col("_data")).alias("final_low"))
    out = plan.select(F.col("_key").alias("key"), "position", "action", F.coalesce(low_of(F.col("term._data")), F.lit(-99)).alias("low"))
    return out.join(final, "key").withColumn("final_title", F.when(F.col("title") == "x", "x").otherwise("p")).drop("title")


# Search through postings, pages, first matches


@query(r"""
tok AS (SELECT DISTINCT k, unnest(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+')) AS t FROM tm),
forms AS (SELECT 'name ' || p_name AS form, p_name AS words FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT 'customer ' || c_custkey, c_name FROM customer),
wanted AS (SELECT DISTINCT form, unnest(regexp_split_to_array(lower(words), '[^\p{L}\p{N}]+')) AS t FROM forms),
n AS (SELECT form, count(*) AS n FROM wanted GROUP BY form),
every AS (SELECT form, k FROM wanted JOIN tok USING (t) JOIN n USING (form) GROUP BY form, k, n.n HAVING count(*) = n.n),
heads AS (SELECT DISTINCT left(p_name, 3) AS a FROM part),
begun AS (SELECT DISTINCT 'starts ' || a AS form, k FROM heads JOIN tok ON t LIKE a || '%'),
ended AS (SELECT DISTINCT 'ends ' || right(p_name, 2) AS form, k FROM part JOIN tok ON t LIKE '%' || right(p_name, 2) WHERE k LIKE 'part%' OR k LIKE 'brand%'),
both_ AS (SELECT 'both ' || p_name AS form, k FROM (SELECT DISTINCT p_name FROM part) AS x JOIN every ON every.form = 'name ' || p_name JOIN tok USING (k) WHERE t LIKE '%' || right(p_name, 1) GROUP BY ALL)
SELECT form, count(*) AS n, min(k) AS least FROM (FROM every UNION ALL FROM begun UNION ALL FROM ended UNION ALL FROM both_) GROUP BY form
""")
def s2_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms: all words of each part's name and of each customer's, words by their first letters, by their last ones, and two conditions at once."""
    d = dictionary(spark, sf_dir)
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    form = lambda df, kind, name, mode, word: df.select(F.concat(F.lit(f"{kind} "), name).alias("form_id"), F.lit("_title").alias("field"), F.lit(mode).alias("mode"), F.array(word).alias("words"))
    end = lambda n: F.right(F.col("p_name"), F.lit(n))
    forms = form(names, "name", "p_name", "all", F.col("p_name")).unionByName(form(customers, "customer", "c_custkey", "all", F.col("c_name")))
    forms = forms.unionByName(form(names, "starts", F.left("p_name", F.lit(3)), "any", F.concat(F.left("p_name", F.lit(3)), F.lit("%"))).distinct())
    forms = forms.unionByName(form(names, "ends", end(2), "any", F.concat(F.lit("%"), end(2))).distinct())
    forms = forms.unionByName(form(names, "both", "p_name", "all", F.col("p_name"))).unionByName(form(names, "both", "p_name", "any", F.concat(F.lit("%"), end(1))))
    found = search.search_tokens(search.postings(d), forms)
    found = found.where(~F.col("form_id").startswith("ends ") | F.col("key").startswith("part") | F.col("key").startswith("brand"))
    return found.groupBy(F.col("form_id").alias("form")).agg(F.count("*").alias("n"), F.min("key").alias("least"))


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (ORDER BY user_id NULLS FIRST, event_id) - 1 AS rank, count(*) OVER () AS total FROM events)
SELECT rank // 25 AS page, rank, event_id FROM r WHERE rank // 25 IN (0, total // 60, total // 25 - 1)
""", dictionary_sql=False)
def a9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 25 events by user, one in the middle and the last whole one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    pages = search.paged(events, ["user_id", "event_id"], 25)
    total = sum(n for *_, n in pages.first)
    parts = [pages.page(k).select(F.lit(k).cast("long").alias("page"), "rank", "event_id") for k in sorted({0, total // 60, total // 25 - 1})]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
w AS (
  SELECT r.root, 'terms/' || k AS target, 'terms/' || k AS node, ['terms/' || k] AS seen, 0 AS depth, CAST(NULL AS VARCHAR) AS p, CAST(NULL AS VARCHAR) AS edge_key FROM tm, (SELECT DISTINCT root FROM ep WHERE root <> 'terms/catalog') AS r
  UNION ALL
  SELECT w.root, target, ep.f, list_append(seen, ep.f), depth + 1, ep.p, ep.edge_key FROM w JOIN ep ON ep.root = w.root AND ep.t = w.node
  WHERE depth < 10 AND ep.p IN ('_predicate_enum-of', '_predicate_section-of', '_predicate_bridge-of') AND NOT list_contains(seen, ep.f)
),
own AS (SELECT DISTINCT root, f AS target FROM ep WHERE p = '_predicate_enum-of'),
best AS (SELECT *, row_number() OVER (PARTITION BY root, target ORDER BY depth, edge_key) AS n FROM w WHERE p = '_predicate_enum-of')
SELECT own.root || ' ' || own.target AS request_id, own.target AS matched, 0 AS depth FROM own JOIN tm ON own.target = 'terms/' || k WHERE own.root <> 'terms/catalog'
UNION ALL SELECT best.root || ' ' || best.target, node, depth FROM best LEFT JOIN own ON own.root = best.root AND own.target = best.target WHERE n = 1 AND own.target IS NULL
""")
def g8_through_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred node of every term in two graphs, walking on through sections and bridges."""
    d = dictionary(spark, sf_dir)
    roots = _roots(spark).where("root <> 'terms/catalog'").select("root").withColumn("one", F.lit(1))
    asked = d.terms.select(F.concat(F.lit("terms/"), "_key").alias("target"), F.lit(1).alias("one")).join(roots, "one")
    asked = asked.select(F.concat_ws(" ", "root", "target").alias("request_id"), "root", "target")
    return walk.match_nodes(d, asked, model.ENUM_OF, (model.SECTION_OF, model.BRIDGE_OF)).select("request_id", "matched", "depth")


# Distances, polygons, shapes and data sets


@query("""
WITH p AS (SELECT c_custkey, (c_custkey * 37) % 3600 / 10.0 - 180 AS lon, (c_custkey * 91) % 1801 / 10.0 - 90 AS lat FROM customer),
c AS (SELECT s_suppkey, (s_suppkey * 53) % 361 - 180.0 AS clon, 90.0 - (s_suppkey * 7) % 181 AS clat FROM supplier),
d AS (SELECT c_custkey, s_suppkey, 2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2), 1.0))) AS distance FROM p, c)
SELECT c_custkey, count(*) AS n, round(min(distance), 2) AS nearest, sum(s_suppkey)::BIGINT AS ids FROM d WHERE distance BETWEEN 1000 AND 1500000 GROUP BY c_custkey
""", dictionary_sql=False)
def x2_high_latitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and centres over the whole globe, both poles and 180 degrees included."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ((k * 37) % 3600 / 10.0 - 180).alias("lon"), ((k * 91) % 1801 / 10.0 - 90).alias("lat"))
    cells = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", ((s * 53) % 361 - 180.0).alias("clon"), (90.0 - (s * 7) % 181).alias("clat"))
    near = geo.within_distance(points, cells, 1000.0, 1_500_000.0)
    return near.groupBy("c_custkey").agg(F.count("*").alias("n"), F.round(F.min("distance"), 2).alias("nearest"), F.sum("s_suppkey").alias("ids"))


@query("""
WITH c AS (SELECT c_custkey AS k, (c_custkey * 37) % 200 / 4.0 AS x, (c_custkey * 91) % 120 / 4.0 AS y FROM customer),
corner(n, dx, dy) AS (VALUES (0, 4.0, 0.0), (1, 0.0, 4.0), (2, -4.0, 0.0), (3, 0.0, -4.0), (4, 4.0, 0.0)),
e AS (SELECT k, x, y, x + a.dx * s AS x1, y + a.dy * s AS y1, x + b.dx * s AS x2, y + b.dy * s AS y2 FROM c, corner AS a JOIN corner AS b ON b.n = a.n + 1, (VALUES (1.0), (0.5)) AS z(s) WHERE s = 1.0 OR k % 2 = 0),
g AS (SELECT i, j FROM range(-5, 56) AS a(i), range(-5, 36) AS b(j)),
t AS (SELECT e.k, i, j,
   greatest(0.0, CASE WHEN x2 = x1 THEN CASE WHEN x1 BETWEEN i AND i + 1 THEN 0 ELSE 9 END ELSE least((i - x1) / (x2 - x1), (i + 1 - x1) / (x2 - x1)) END,
            CASE WHEN y2 = y1 THEN CASE WHEN y1 BETWEEN j AND j + 1 THEN 0 ELSE 9 END ELSE least((j - y1) / (y2 - y1), (j + 1 - y1) / (y2 - y1)) END) AS t0,
   least(1.0, CASE WHEN x2 = x1 THEN 1 ELSE greatest((i - x1) / (x2 - x1), (i + 1 - x1) / (x2 - x1)) END, CASE WHEN y2 = y1 THEN 1 ELSE greatest((j - y1) / (y2 - y1), (j + 1 - y1) / (y2 - y1)) END) AS t1,
   CASE WHEN (y1 > j + 0.5) <> (y2 > j + 0.5) AND i + 0.5 < (x2 - x1) * (j + 0.5 - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END AS crosses
  FROM e JOIN g ON i BETWEEN x - 9 AND x + 9 AND j BETWEEN y - 9 AND y + 9),
m AS (SELECT k, i, j FROM t GROUP BY k, i, j HAVING bool_or(t0 <= t1) OR sum(crosses) % 2 = 1)
SELECT k AS c_custkey, count(*) AS n, sum(i * 1000 + j)::BIGINT AS cells FROM m GROUP BY k
""", dictionary_sql=False)
def x3_cells_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds around points, half of them with a hole; some share edges with others and run along corners of cells."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ((k * 37) % 200 / 4.0).alias("x"), ((k * 91) % 120 / 4.0).alias("y"))
    ring = lambda s: F.array(*[F.struct((F.col("x") + dx * s).alias("lon"), (F.col("y") + dy * s).alias("lat")) for dx, dy in ((4.0, 0.0), (0.0, 4.0), (-4.0, 0.0), (0.0, -4.0), (4.0, 0.0))])
    polygons = c.select(F.col("c_custkey").alias("polygon_id"), F.when(k % 2 == 0, F.array(ring(1.0), ring(0.5))).otherwise(F.array(ring(1.0))).alias("rings"))
    met = geo.cells_in_polygons(polygons, 1.0)
    return met.groupBy(F.col("polygon_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("i") * 1000 + F.col("j")).alias("cells"))


@query("""
SELECT c_nationkey AS shape, md5('(' || c_nationkey || '.0 0.0,' || c_nationkey || '.0 9.0,40.0 9.0,40.0 0.0)(30.0 1.0,30.0 2.0,31.0 1.0)(32.0 1.0,32.0 2.0,33.0 1.0)') AS hash, count(*) AS n FROM customer GROUP BY ALL
""", dictionary_sql=False)
def x4_geometry_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles with two holes, begun at any corner, in either direction, closed or open, holes in either order: one hash for each nation."""
    west, turn = F.col("c_nationkey").cast("double"), F.col("c_custkey") % 4
    point = lambda x, y: F.struct((x if isinstance(x, Column) else F.lit(x)).alias("lon"), F.lit(y).alias("lat"))
    outer = F.array(point(west, 0.0), point(west, 9.0), point(40.0, 9.0), point(40.0, 0.0))
    turned = F.concat(F.slice(outer, (turn + 1).cast("int"), F.lit(4)), F.slice(outer, F.lit(1), turn.cast("int")))
    turned = F.when(F.col("c_custkey") % 3 == 0, F.reverse(turned)).otherwise(turned)
    closed = F.when(F.col("c_custkey") % 5 > 0, F.concat(turned, F.slice(turned, 1, 1))).otherwise(turned)
    hole = lambda x: F.array(point(x + 1, 1.0), point(x, 1.0), point(x, 2.0), point(x + 1, 1.0))
    holes = F.when(F.col("c_custkey") % 2 == 0, F.array(hole(30.0), hole(32.0))).otherwise(F.array(hole(32.0), hole(30.0)))
    rows = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet")).select(F.col("c_nationkey").alias("shape"), geo.polygon_hash(F.concat(F.array(closed), holes)).alias("hash"))
    return rows.groupBy("shape", "hash").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT p_partkey AS id, (p_partkey * 37) % 340 - 170.0 AS w, (p_partkey * 91) % 160 - 80.0 AS s, CASE p_partkey % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.5 WHEN 2 THEN 4.0 ELSE 9.5 END AS side, p_size AS area, p_type AS ds FROM part),
q AS (SELECT c_custkey AS id, (c_custkey * 53) % 330 - 165.0 AS w, (c_custkey * 29) % 150 - 75.0 AS s, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 7.0 ELSE 14.0 END AS side, c_nationkey AS n FROM customer)
SELECT q.id AS search_id, count(*) AS n, sum(s.id)::BIGINT AS ids FROM q JOIN s ON s.w <= q.w + q.side AND q.w <= s.w + s.side AND s.s <= q.s + q.side AND q.s <= s.s + s.side
 AND (q.n % 2 = 0 OR s.ds IN ('SMALL', 'ECONOMY')) AND (q.n % 3 = 0 OR s.area >= q.n) AND (q.n % 5 = 0 OR s.area <= q.n + 20) GROUP BY q.id
""", dictionary_sql=False)
def x6_shape_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes from a hundredth of a degree to ten, searched by boxes, data sets and ranges of area."""
    k, c, n = F.col("p_partkey"), F.col("c_custkey"), F.col("c_nationkey")
    west, south, side = (k * 37) % 340 - 170.0, (k * 91) % 160 - 80.0, F.when(k % 4 == 0, 0.01).when(k % 4 == 1, 0.5).when(k % 4 == 2, 4.0).otherwise(9.5)
    box = lambda w, s, d: (w.alias("west"), s.alias("south"), (w + d).alias("east"), (s + d).alias("north"))
    shapes = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("shape_id"), *box(west, south, side), F.array("p_type").alias("datasets"), F.col("p_size").alias("area"))
    side = F.when(c % 3 == 0, 1.0).when(c % 3 == 1, 7.0).otherwise(14.0)
    lists = F.when(n % 2 != 0, F.array(F.lit("SMALL"), F.lit("ECONOMY"))).alias("datasets")
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").where(n.isNotNull()).select(
        c.alias("search_id"), *box((c * 53) % 330 - 165.0, (c * 29) % 150 - 75.0, side), lists, F.when(n % 3 != 0, n).alias("area_min"), F.when(n % 5 != 0, n + 20).alias("area_max")
    )
    return geo.search_totals(shapes, asked, ("area",))


@query("""
WITH v AS (SELECT p_partkey AS id, 'word' AS field, unnest(string_split(p_name, ' ')) AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part),
f AS (SELECT DISTINCT p_name, p_brand FROM part),
every AS (SELECT DISTINCT p_name, p_brand, a.id FROM f JOIN v AS a ON a.field = 'word' AND a.value = split_part(p_name, ' ', 1) JOIN v AS b ON b.id = a.id AND b.field = 'word' AND b.value = split_part(p_name, ' ', 2)),
brand AS (SELECT p_name, p_brand, id FROM f JOIN v ON field = 'brand' AND value IN (p_brand, 'Brand#1'))
SELECT 'and ' || p_name || p_brand AS form_id, count(*) AS n, sum(id)::BIGINT AS ids FROM every JOIN brand USING (p_name, p_brand, id) GROUP BY 1
UNION ALL SELECT 'or ' || p_name || p_brand, count(*), sum(id)::BIGINT FROM (FROM every UNION FROM brand) GROUP BY 1
""", dictionary_sql=False)
def x13_dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as data sets: both words of a name, and one of two brands, joined by AND and by OR, for each name and brand that occurs."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    value = lambda field, v: F.struct(F.lit(field).alias("field"), v.alias("value"))
    words = part.select(F.col("p_partkey").alias("dataset_id"), F.lit("word").alias("field"), F.explode(F.split("p_name", " ")).alias("value"))
    values = words.unionByName(part.select(F.col("p_partkey").alias("dataset_id"), F.explode(F.array(value("brand", F.col("p_brand")), value("type", F.col("p_type")))).alias("x")).select("dataset_id", "x.*"))
    named = part.select("p_name", "p_brand").distinct().withColumn("op", F.explode(F.array(F.lit("AND"), F.lit("OR"))))
    named = named.withColumn("form_id", F.concat(F.lower("op"), F.lit(" "), "p_name", "p_brand"))
    clause = lambda field, mode, wanted: named.select("form_id", "op", F.lit(field).alias("field"), F.lit(mode).alias("mode"), wanted.alias("wanted"))
    forms = clause("word", "all", F.split("p_name", " ")).unionByName(clause("brand", "any", F.array(F.col("p_brand"), F.lit("Brand#1"))))
    return geo.query_datasets(values, forms).groupBy("form_id").agg(F.count("*").alias("n"), F.sum("dataset_id").alias("ids"))


# Rows of their own for forms of the operators above


@query("h AS (SELECT DISTINCT root, f FROM ep WHERE p = '_predicate_enum-of') SELECT root AS request_id, k AS key, nid FROM h JOIN tm ON 'terms/' || k = f")
def f6_enumeration_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _roots(spark).withColumn("predicate", F.lit(model.ENUM_OF))
    out = flat.functional_terms(dictionary(spark, sf_dir), asked)
    return out.select("request_id", F.col("term._key").alias("key"), F.col("term._code._nid").alias("nid"))


@query(f"""{_PATHS},
h AS (SELECT tm.k, r.node, row_number() OVER (PARTITION BY tm.k ORDER BY depth, md5(concat_ws('/', node, p, split_part(path, '>', -2)))) AS n FROM tm JOIN r ON r.root = 'terms/geo' AND p = '_predicate_enum-of'
      AND (r.node = 'terms/' || tm.k OR split_part(path, '>', -2) = 'terms/' || tm.k))
SELECT h.k AS request_id, split_part(node, '/', 2) AS key, e.name AS title FROM h JOIN tm AS e ON 'terms/' || e.k = node WHERE n = 1
""")
def g10_matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record and key of the first element that a term leads to."""
    d = dictionary(spark, sf_dir)
    asked = d.terms.select(F.col("_key").alias("request_id"), F.lit("terms/geo").alias("root"), F.concat(F.lit("terms/"), "_key").alias("target"))
    found = flat.with_terms(d, walk.match_enumeration(d, asked).select("request_id", F.col("node").alias("handle")))
    return found.select("request_id", handle_key(F.col("handle")).alias("key"), F.col("term._code._name").alias("title"))


@query("q AS (SELECT 1) SELECT DISTINCT name AS request_id, k AS key, lid FROM tm JOIN ep ON ep.f = 'terms/' || k AND root = 'terms/catalog' AND p = '_predicate_enum-of'")
def g13_elements_by_official_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and records by an official code."""
    d = dictionary(spark, sf_dir)
    asked = _names(spark, sf_dir).withColumn("root", F.lit("terms/catalog"))
    found = flat.with_terms(d, walk.match_enumeration_code(d, asked).select("request_id", F.col("node").alias("handle")).distinct())
    return found.select("request_id", F.col("term._key").alias("key"), F.col("term._code._lid").alias("lid"))


@query(f"{_PATHS} SELECT DISTINCT k AS request_id, depth, path FROM r JOIN tm ON 'terms/' || k = node WHERE root = 'terms/geo' AND p = '_predicate_enum-of'")
def g20_paths_by_global_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by a scalar code field."""
    d = dictionary(spark, sf_dir)
    asked = d.terms.select(F.col("_key").alias("request_id"), F.lit("terms/geo").alias("root"), F.lit("_gid").alias("field"), F.col("_code._gid").alias("code"))
    return walk.match_enumeration_code(d, asked).select("request_id", "depth", F.array_join("vertices", ">").alias("path"))


@query("SELECT 'part_' || p_partkey AS key, p_partkey % 3 > 0 AS found FROM part UNION ALL SELECT 'no_' || p_partkey, false FROM part", dictionary_sql=False)
def i10_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of descriptors alone (I10, I11): a term without a data section counts as missing."""
    d, parts = dictionary(spark, sf_dir), _part_terms(spark, sf_dir)
    some = parts.withColumn("_data", F.when(F.col("_code._lid").cast("long") % 3 > 0, F.col("_data"))).drop("p_size", "m")
    keys = some.select(F.col("_key").alias("key")).unionByName(some.select(F.concat(F.lit("no_"), "_code._lid").alias("key")))
    return flat.lookup(type(d)(some, d.edges, d.links), keys, descriptors=True).select("key", "found")


@query("""
c AS (SELECT f, p, t, count(*) AS n, bool_or(root = 'terms/geo') AS hit FROM ep WHERE p = '_predicate_section-of' GROUP BY ALL),
k AS (SELECT md5(concat_ws('/', f, p, t)) AS edge_key, n, hit FROM c)
SELECT edge_key, CASE WHEN NOT hit THEN 'ignored' WHEN n = 1 THEN 'deleted' ELSE 'updated' END AS action FROM k
""")
def w4_delete_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    sections = d.edges.where(F.col("predicate") == model.SECTION_OF)
    asked = sections.select(F.col("from").alias("request_id"), F.lit("terms/geo").alias("root"), F.col("to").alias("parent"), F.col("from").alias("child"), F.lit(None).cast("map<string,string>").alias("data"))
    return edits.plan_delete_edges(d, edits.children(edits.containers(asked))).select("edge_key", "action")


@query("""
b AS (SELECT DISTINCT root AS a, r2 AS b FROM (SELECT DISTINCT root FROM ep) AS x, (SELECT DISTINCT root AS r2 FROM ep) AS y WHERE root <> r2)
SELECT b.a || ' ' || b.b AS request_id, CASE WHEN ep.f IS NULL THEN 'ignored' ELSE 'deleted' END AS action
FROM b LEFT JOIN ep ON ep.root = b.a AND ep.t = b.a AND ep.f = b.b AND ep.p = '_predicate_bridge-of'
""")
def w6_delete_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ordered pair of roots as a bridge to delete; the pairs follow from a join on a constant of the few roots."""
    d = dictionary(spark, sf_dir)
    roots = _roots(spark).select("root").withColumn("one", F.lit(1))
    pairs = roots.join(roots.withColumnRenamed("root", "bridged"), "one").where("root <> bridged").drop("one")
    asked = pairs.select(F.concat_ws(" ", "root", "bridged").alias("request_id"), "root", "bridged", F.lit(None).cast("map<string,string>").alias("data"))
    return edits.plan_delete_edges(d, edits.children(edits.bridges(asked))).select("request_id", "action")


@query("""
rq AS (SELECT DISTINCT l_returnflag AS request_id, 'terms/part_' || l_partkey AS a, 'terms/ship_' || l_suppkey AS b FROM lineitem), h AS (SELECT request_id, a AS handle FROM rq UNION SELECT request_id, b FROM rq)
SELECT request_id, handle FROM h LEFT JOIN tm ON 'terms/' || k = handle WHERE k IS NULL
""")
def w10_link_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    asked = lines.select(F.col("l_returnflag").alias("request_id"), F.concat(F.lit("terms/part_"), "l_partkey").alias("parent"), F.concat(F.lit("terms/ship_"), "l_suppkey").alias("child")).distinct()
    return edits.orphans(dictionary(spark, sf_dir), asked)


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a.b=1,a.c=9,d=' || event_type WHEN 1 THEN 'a=x,d=' || event_type WHEN 2 THEN 'd=' || event_type ELSE 'a.b=1,a.c=2,d=' || event_type END AS merged, event_id % 4 <> 3 AS changed FROM events
""", dictionary_sql=False)
def w12_merged_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data of edges as leaf maps: replace a leaf, replace an object by a value, remove an object, change nothing."""
    events, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 4
    entry = lambda *pairs: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in pairs for x in pair])
    old = entry(("a.b", "1"), ("a.c", "2"), ("d", F.col("event_type")))
    new = F.when(k == 0, entry(("a.c", "9"))).when(k == 1, entry(("a", "x"))).when(k == 2, entry(("a", F.lit(None).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    merged_ = columns.merged(old, new)
    text = F.array_join(F.array_sort(F.transform(F.map_entries(merged_), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return events.select("event_id", text.alias("merged"), (~columns.same_map(old, merged_)).alias("changed"))


@query("SELECT p_partkey AS row_id, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 27 WHEN 2 THEN 19 WHEN 3 THEN 30 ELSE 21 END AS code FROM part", dictionary_sql=False)
def v25_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    value = F.when(k == 0, F.lit("nation_1")).when(k == 1, F.concat(F.lit("part_"), "p_partkey")).when(k == 2, "geo").when(k == 3, F.concat(F.lit("no_"), "p_partkey")).otherwise(";")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.lit("origin").alias("descriptor"), value.cast("variant").alias("value"))
    return validate.validate(dictionary(spark, sf_dir), validate.descriptor_rules(_definitions(spark, {"origin": _NESTED_RULES["origin"]})), rows).select("row_id", "code")


@query("SELECT p_partkey AS row_id, CASE WHEN p_name <= 'blue gear' THEN 12 WHEN p_name > 'red pipe' THEN 13 ELSE 0 END AS code FROM part", dictionary_sql=False)
def v36_string_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = '{"_scalar": {"_type": "_type_string", "_valid-range_string": {"_min-range-exclusive_string": "blue gear", "_max-range-inclusive_string": "red pipe"}}}'
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.lit("n").alias("descriptor"), F.col("p_name").cast("variant").alias("value"))
    return validate.validate(dictionary(spark, sf_dir), validate.descriptor_rules(_definitions(spark, {"n": rule})), rows).select("row_id", "code")


@query("""
WITH w AS (SELECT p_partkey, unnest(['one', 'one_none', 'any', 'one_none_of', 'all', 'banned']) AS selector, p_partkey % 4 AS n FROM part)
SELECT p_partkey AS row_id, selector, CASE WHEN CASE selector WHEN 'one' THEN n = 1 WHEN 'one_none' THEN n <= 1 WHEN 'any' THEN n >= 1 WHEN 'one_none_of' THEN n < 2 WHEN 'all' THEN n = 3 ELSE n = 0 END THEN 0 ELSE 34 END AS code FROM w
""", dictionary_sql=False)
def v31_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each selector of the required rule, and the banned list, against objects with none to three of its members."""
    names = {"anysize": _MORE_RULES["anysize"], "anytext": _MORE_RULES["anytext"], "flag": _MORE_RULES["flag"]}
    members = '["anysize", "anytext", "flag"]'
    rule = {k: f'{{"_required": {{"{s}": {f"[{members}]" if k == "one_none_of" else members}}}}}' for k, s in model.SELECTORS.items()} | {"banned": f'{{"_banned": {members}}}'}
    structures = validate.structure_rules(spark.sql(" UNION ALL ".join(f"SELECT '{k}' AS structure, parse_json('{v}') AS definition" for k, v in rule.items())))
    n = F.col("p_partkey") % 4
    text = F.when(n == 0, "{}").when(n == 1, '{"anysize": 1}').when(n == 2, '{"anysize": 1, "anytext": "a"}').otherwise('{"anysize": 1, "anytext": "a", "flag": true}')
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.parse_json(text).alias("object"), F.explode(F.array(*map(F.lit, rule))).alias("selector"))
    rows = rows.select(F.struct("p_partkey", "selector").alias("row_id"), "object", F.array("selector").alias("kinds"))
    out = validate.validate_objects(dictionary(spark, sf_dir), validate.descriptor_rules(_definitions(spark, names)), rows, structures)
    return out.select(F.col("row_id.p_partkey").alias("row_id"), "row_id.selector", "code")


@query("""
SELECT 'part_' || p_partkey AS key, CASE p_partkey % 6 WHEN 0 THEN 'type changed' WHEN 1 THEN 'num lower bound raised' WHEN 2 THEN 'type changed' WHEN 3 THEN 'minimum elements raised' END AS violation FROM part WHERE p_partkey % 6 < 4
""", dictionary_sql=False)
def u7_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets, keys of dictionaries and limits of elements (U5, U7, U8, U13): the first four forms restrict, the last two relax."""
    part, k, size = dealt(spark.read.parquet(f"{sf_dir}/part.parquet")), F.col("p_partkey") % 6, F.col("p_size").cast("string")

    def version(type_: Column, low: Column, key: Column, least: Column) -> DataFrame:
        sets = F.concat(F.lit('{"_set": {"_set_scalar": {"_set_type": "'), type_, F.lit('", "_valid-range": {"_min-range-inclusive": '), low.cast("string"), F.lit("}}}}"))
        dicts = F.concat(F.lit('{"_dict": {"_dict_key": {"_type_key": "'), key, F.lit('"}, "_dict_value": {"_array": {"_scalar": {"_type": "_type_number"}, "_elements": {"_min-items": '), least.cast("string"), F.lit("}}}}}"))
        return part.select(F.concat(F.lit("part_"), "p_partkey").alias("descriptor"), F.parse_json(F.when(k.isin(0, 1, 4), sets).otherwise(dicts)).alias("definition"))

    number, text, least = F.lit("_type_number"), F.lit("_type_string"), F.col("p_size") + 2
    old = version(number, F.col("p_size"), text, least)
    new = version(F.when(k == 0, "_type_string").otherwise(number), F.col("p_size") + F.when(k == 1, 1).when(k == 4, -1).otherwise(0), F.when(k == 2, "_type_string_key").otherwise(text), least + F.when(k == 3, 1).when(k == 5, -1).otherwise(0))
    return evolve.rule_violations(validate.descriptor_rules(old), validate.descriptor_rules(new)).select(F.col("descriptor").alias("key"), "violation")


@query("q AS (SELECT 1) SELECT count(*)::BIGINT AS n_terms, (SELECT count(*) FROM (SELECT DISTINCT edge_key FROM ep))::BIGINT AS n_edges, (SELECT count(*) FROM lk)::BIGINT AS n_links, md5(string_agg(k || name, ',' ORDER BY k)) AS terms FROM tm")
def s1_saved_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary, saved and read back."""
    folder = scratch(spark)
    tables.save(dictionary(spark, sf_dir), folder)
    d = tables.read(spark, folder)
    named = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_key", "_code._name"))), lambda x: F.concat(x["_key"], x["_name"])), ","))
    one = d.terms.agg(F.count("*").alias("n_terms"), named.alias("terms")).withColumn("one", F.lit(1))
    for name, rows in (("n_edges", d.edges), ("n_links", d.links)):
        one = one.join(rows.agg(F.count("*").alias(name)).withColumn("one", F.lit(1)), "one")
    return one.drop("one")


@query("SELECT user_id % 50 AS shape, strftime(ts, '%Y%m') AS span, count(*) AS n, min(ts)::DATE::VARCHAR AS first_date, max(ts)::DATE::VARCHAR AS last_date, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS terms FROM events GROUP BY 1, 2", dictionary_sql=False)
def x9_summary_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select((F.col("user_id") % 50).alias("shape"), geo.span_of(F.col("ts"), "month").alias("span"), F.to_date("ts").cast("string").alias("date"), F.col("event_type").alias("term"), F.lit("events").alias("dataset"))
    return geo.measurement_summary(rows, ["shape", "span"]).select("shape", "span", "n", "first_date", "last_date", _joined("terms").alias("terms"))


@query("""
WITH d AS (SELECT strftime(ts, '%Y') AS span, ts::DATE::VARCHAR AS date, event_type, max(event_id) AS v FROM events GROUP BY ALL)
SELECT span, date, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS properties FROM d GROUP BY span, date
""", dictionary_sql=False)
def x10_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of a date merged to one row."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(geo.span_of(F.col("ts"), "year").alias("span"), F.to_date("ts").cast("string").alias("date"), F.col("event_type").alias("term"), F.col("event_id").alias("value"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return geo.measurement_series(rows, ["span"]).select("span", "date", text.alias("properties"))


@query("""
r AS (SELECT DISTINCT root, root AS node, 0 AS depth FROM ep UNION SELECT r.root, ep.f, depth + 1 FROM r JOIN ep ON ep.root = r.root AND ep.t = r.node WHERE depth < 9),
n AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node)
SELECT n.root AS request_id, t AS parent, p AS predicate, f AS child, depth + 1 AS depth FROM n JOIN ep ON ep.root = n.root AND ep.t = n.node
WHERE p IN ('_predicate_enum-of', '_predicate_section-of', '_predicate_bridge-of')
""")
def g3_enumeration_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of each root as rows, a child each, with its depth."""
    return walk.tree_rows(dictionary(spark, sf_dir), _roots(spark), (model.ENUM_OF, model.SECTION_OF, model.BRIDGE_OF)).select("request_id", "parent", "predicate", "child", "depth")


@query(f"""{_PATHS},
h AS (SELECT tm.k, r.node, row_number() OVER (PARTITION BY tm.k ORDER BY depth, md5(concat_ws('/', node, p, split_part(path, '>', -2)))) AS n FROM tm JOIN r ON r.root = 'terms/supply' AND p = '_predicate_enum-of'
      AND (r.node = 'terms/' || tm.k OR split_part(path, '>', -2) = 'terms/' || tm.k))
SELECT k AS request_id, split_part(node, '/', 2) AS key FROM h WHERE n = 1
""")
def g11_matched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dictionary(spark, sf_dir)
    asked = d.terms.select(F.col("_key").alias("request_id"), F.lit("terms/supply").alias("root"), F.concat(F.lit("terms/"), "_key").alias("target"))
    return walk.match_enumeration(d, asked).select("request_id", handle_key(F.col("node")).alias("key"))


@query("""
c AS (SELECT k, unnest(['_lid', '_gid', '_name', '_aid', '_aid']) AS field, unnest([lid, k, name, lid, name]) AS code FROM tm),
h AS (SELECT DISTINCT field, code, root, k FROM c JOIN ep ON f = 'terms/' || k AND p = '_predicate_enum-of')
SELECT field, code, root, h.k AS key, nid, name AS title FROM h JOIN tm ON tm.k = h.k
""")
def g19_elements_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of all roots by every code of every term in four fields at once: keys and records."""
    d = dictionary(spark, sf_dir)
    codes = d.term_codes.where(F.col("field").isin("_lid", "_gid", "_name", "_aid")).select("field", "code").distinct()
    asked = codes.withColumn("root", F.explode(F.array(*map(F.lit, ("terms/geo", "terms/supply", "terms/catalog"))))).select(F.struct("field", "code", "root").alias("request_id"), "root", "field", "code")
    found = flat.with_terms(d, walk.match_enumeration_code(d, asked).select("request_id", F.col("node").alias("handle")).distinct())
    return found.select("request_id.field", "request_id.code", "request_id.root", F.col("term._key").alias("key"), F.col("term._code._nid").alias("nid"), F.col("term._code._name").alias("title"))


@query("q AS (SELECT 1) SELECT DISTINCT name AS request_id, k AS key, nid, lid FROM tm JOIN ep ON f = 'terms/' || k AND p = '_predicate_enum-of' AND root = 'terms/geo'")
def i7_enumeration_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of an enumeration with a code, each key with its record."""
    asked = _names(spark, sf_dir).withColumn("root", F.lit("terms/geo"))
    return flat.enum_terms_by_code(dictionary(spark, sf_dir), asked).select("request_id", "key", F.col("_code._nid").alias("nid"), F.col("_code._lid").alias("lid"))


@query("SELECT 'part_' || p_partkey AS key, true AS found, p_partkey % 3 > 0 AS is_descriptor FROM part UNION ALL SELECT 'no_' || p_partkey, false, false FROM part", dictionary_sql=False)
def i11_term_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a list of terms, descriptors or not, known or not."""
    d, parts = dictionary(spark, sf_dir), _part_terms(spark, sf_dir)
    some = parts.withColumn("_data", F.when(F.col("_code._lid").cast("long") % 3 > 0, F.col("_data"))).drop("p_size", "m")
    keys = some.select(F.col("_key").alias("key")).unionByName(some.select(F.concat(F.lit("no_"), "_code._lid").alias("key")))
    return flat.lookup(type(d)(some, d.edges, d.links), keys).select("key", "found", F.col("_data").isNotNull().alias("is_descriptor"))


@query("""
w AS (SELECT k, unnest(['iso_639_3_eng', 'iso_639_3_ita', '@']) AS language FROM tm)
SELECT w.k AS key, language, CASE WHEN language = 'iso_639_3_eng' THEN name END AS title, language = '@' AS whole FROM w JOIN tm ON tm.k = w.k
""")
def t6_term_in_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term in a language that it has, in one that it lacks, and with all its languages."""
    d = dictionary(spark, sf_dir)
    keys, out = d.terms.select("_key"), []
    for language in (model.LANGUAGE, "iso_639_3_ita", "@"):
        got = terms.get_terms(d.terms, keys, language)
        text = F.col("title_text") if "title_text" in got.columns else F.lit(None).cast("string")
        out.append(got.select(F.col("_key").alias("key"), F.lit(language).alias("language"), text.alias("title"), F.lit("title_text" not in got.columns).alias("whole")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("q AS (SELECT 1) SELECT k AS key FROM tm WHERE nid = 'supplier' AND lid LIKE '%7' ORDER BY k LIMIT 20 OFFSET 2")
def t9_search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = terms.search(dictionary(spark, sf_dir).terms, terms.selection(_nid="supplier", _lid="%7"), start=2, limit=20)
    return found.select(F.col("_key").alias("key"))


@query("q AS (SELECT 1) SELECT k AS key, '_key,_code,_info,_data,_rule' AS fields FROM tm")
def t17_for_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms as a store holds them, without what only the store needs."""
    stored = dictionary(spark, sf_dir).terms.withColumns({"_id": F.concat(F.lit("terms/"), "_key"), "_rev": F.md5("_key"), "_oldRev": F.lit(None).cast("string")})
    shown = terms.for_client(stored)
    return shown.select(F.col("_key").alias("key"), F.lit(",".join(shown.columns)).alias("fields"))


@query("SELECT p_brand AS brand, count(*) FILTER (p_partkey % 7 > 0) AS n, sum(p_size) FILTER (p_partkey % 7 > 0) AS size, count(*) FILTER (p_partkey % 7 = 0) AS n_malformed FROM part GROUP BY 1", dictionary_sql=False)
def s3_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as JSON lines, every seventh cut short, read back with the malformed lines beside the others."""
    folder, part = scratch(spark), spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.to_json(F.struct("p_partkey", "p_brand", "p_size"))
    part.select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("#"), "p_brand")).otherwise(line).alias("value")).write.text(folder)
    rows = tables.read_lines(spark, folder, "p_partkey LONG, p_brand STRING, p_size LONG")
    brand = F.coalesce("p_brand", F.substring("_corrupt", 2, 100))
    return rows.groupBy(brand.alias("brand")).agg(F.count("p_partkey").alias("n"), F.sum("p_size").alias("size"), F.count("_corrupt").alias("n_malformed"))


@query("""
k AS (SELECT md5(concat_ws('/', 'terms/customer_' || c_custkey, '_predicate_property-of', 'terms/region_' || n_regionkey)) AS edge_key FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT edge_key, true AS is_new FROM k UNION SELECT edge_key, false FROM ep
""")
def s5_bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges and, added at once, one from each customer to its region; a key that is taken would raise."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    ends = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ends = ends.select(F.concat(F.lit("terms/customer_"), "c_custkey").alias("f"), F.concat(F.lit("terms/region_"), "n_regionkey").alias("t"))
    new = ends.select(edge_key(F.col("f"), F.lit(model.PROPERTY_OF), F.col("t")).alias("edge_key"), F.lit(True).alias("is_new"))
    return tables.insert(dictionary(spark, sf_dir).edges.select("edge_key", F.lit(False).alias("is_new")), new, "edge_key")


@query(f"{_SETS} SELECT request_id, edge_key, action FROM pl WHERE action IN ('inserted', 'updated')")
def s8_rows_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run says would be written; the plan itself writes nothing."""
    plan = edits.plan_set_edges(dictionary(spark, sf_dir), edits.children(_set_requests(spark, sf_dir)))
    return tables.inserted_rows(plan).select("request_id", "edge_key", "action")


@query("""
SELECT 'part_' || p_partkey AS key, CASE p_partkey % 6 WHEN 0 THEN 'rule section added' WHEN 1 THEN 'data section removed' WHEN 2 THEN 'identifier changed' WHEN 3 THEN 'local identifier missing from official ones' END AS violation
FROM part WHERE p_partkey % 6 < 4
UNION ALL SELECT 'part_' || p_partkey || 'x', 'term added' FROM part WHERE p_partkey % 6 = 4 UNION ALL SELECT 'part_' || p_partkey, 'term removed' FROM part WHERE p_partkey % 6 = 4
""", dictionary_sql=False)
def u9_sections_of_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and sections of whole terms (U2, U3, U9); the last sixth stays as it is."""
    old = _part_terms(spark, sf_dir).drop("p_size", "m").withColumn("_rule", F.lit(None).cast("variant"))
    k = F.col("_code._lid").cast("long") % 6
    new = old.withColumns({
        "_rule": F.when(k == 0, F.parse_json(F.lit('{"_required": {"_selection-descriptors_one": ["a"]}}'))),
        "_data": F.when(k != 1, F.col("_data")),
        "_key": F.when(k == 4, F.concat("_key", F.lit("x"))).otherwise(F.col("_key")),
        "_code": F.col("_code").withField("_gid", F.when(k == 2, F.concat("_code._gid", F.lit("y"))).otherwise(F.col("_code._gid"))).withField("_aid", F.when(k == 3, F.array(F.lit("other"))).otherwise(F.col("_code._aid"))),
    })
    return evolve.code_violations(old, new).select(F.col("_key").alias("key"), "violation")


@query("""
SELECT 'part_' || p_partkey AS key, CASE p_partkey % 8 WHEN 0 THEN 'minimum elements raised' WHEN 1 THEN 'maximum elements lowered' WHEN 2 THEN 'element limit added' WHEN 3 THEN 'nesting changed' WHEN 4 THEN 'type changed' END AS violation
FROM part WHERE p_partkey % 8 < 5
""", dictionary_sql=False)
def u13_element_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of elements, containers and their scalars (U4-U6, U13): five forms restrict, three relax or stay."""
    part, m, size = dealt(spark.read.parquet(f"{sf_dir}/part.parquet")), F.col("p_partkey") % 8, F.col("p_size")

    def version(least: Column, most: Column, inner: Column, kind: Column) -> DataFrame:
        limits = F.concat(F.lit('"_elements": {'), F.concat_ws(", ", F.concat(F.lit('"_min-items": '), least.cast("string")), F.concat(F.lit('"_max-items": '), most.cast("string"))), F.lit("}"))
        text = F.concat(F.lit('{"_array": {"'), inner, F.lit('": {"'), F.when(inner == "_set", F.lit('_set_scalar": {"_set_type": "')).otherwise(F.lit('_type": "')), kind, F.when(inner == "_set", F.lit('"}}, ')).otherwise(F.lit('"}, ')), limits, F.lit("}}"))
        return part.select(F.concat(F.lit("part_"), "p_partkey").alias("descriptor"), F.parse_json(text).alias("definition"))

    scalar, number = F.lit("_scalar"), F.lit("_type_number")
    old = version(size + 1, F.when(m != 2, size + 9), scalar, number)
    least = F.when(m == 0, size + 2).when(m == 5, size).when(m != 6, size + 1)
    most = F.when(m == 1, size + 8).when(m == 6, size + 20).otherwise(size + 9)
    new = version(least, most, F.when(m == 3, "_set").otherwise(scalar), F.when(m == 4, "_type_string").otherwise(number))
    return evolve.rule_violations(validate.descriptor_rules(old), validate.descriptor_rules(new)).select(F.col("descriptor").alias("key"), "violation")


# Units and shapes


def _unit_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle with a square hole for each supplier, of sides from a fiftieth of a degree to 30 degrees, anywhere on the globe."""
    s = F.col("s_suppkey")
    side = F.element_at(F.array(*map(F.lit, (0.02, 0.3, 2.0, 7.0, 30.0))), (s % 5 + 1).cast("int"))
    west, south = (s * 7919) % 32000 / 100.0 - 170.0, (s * 104729) % 14000 / 100.0 - 80.0
    at = lambda x, y: F.struct((F.col("west") + F.col("side") * x).alias("lon"), (F.col("south") + F.col("side") * y).alias("lat"))
    ring = lambda a, b: F.array(at(a, a), at(b, a), at(b, b), at(a, b), at(a, a))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(s.alias("unit_id"), side.alias("side"), west.alias("west"), south.alias("south"))
    return rows.select("unit_id", F.array(ring(0.0, 1.0), ring(0.25, 0.75)).alias("rings"))


_UNITS = """
u AS (SELECT s_suppkey AS unit_id, [0.02, 0.3, 2.0, 7.0, 30.0][(s_suppkey % 5 + 1)::INT]::DOUBLE AS side, (s_suppkey * 7919) % 32000 / 100.0 - 170.0 AS west, (s_suppkey * 104729) % 14000 / 100.0 - 80.0 AS south FROM supplier),
p AS (SELECT c_custkey, (c_custkey * 6151) % 32000 / 100.0 - 170.0037 AS lon, (c_custkey * 3571) % 14000 / 100.0 - 80.0037 AS lat FROM customer)
"""


def _unit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(c.alias("point_id"), ((c * 6151) % 32000 / 100.0 - 170.0037).alias("lon"), ((c * 3571) % 14000 / 100.0 - 80.0037).alias("lat"))


@query(f"""WITH {_UNITS}
SELECT c_custkey AS point_id, unit_id FROM p JOIN u ON lon > west AND lon < west + side AND lat > south AND lat < south + side
WHERE NOT (lon > west + side * 0.25 AND lon < west + side * 0.75 AND lat > south + side * 0.25 AND lat < south + side * 0.75)
""", dictionary_sql=False)
def x7_shapes_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape that holds each point (X5, X7): shapes of very different sizes, with holes."""
    shapes = _unit_shapes(spark, sf_dir).select(F.col("unit_id").alias("shape_id"), "rings")
    return geo.shapes_of_points(_unit_points(spark, sf_dir), shapes).select("point_id", F.col("shape_id").alias("unit_id"))


@query(f"""WITH {_UNITS}
SELECT a.unit_id AS asked, string_agg(b.unit_id::VARCHAR, ',' ORDER BY b.unit_id) AS units FROM u AS a JOIN u AS b ON a.side = b.side AND a.west = b.west AND a.south = b.south GROUP BY 1
""", dictionary_sql=False)
def x5_units_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by the hash of a shape that they list (X5): each shape is asked for as another file would write it."""
    shapes = _unit_shapes(spark, sf_dir)
    units = shapes.select("unit_id", F.array(geo.polygon_hash(F.col("rings"))).alias("shapes"))
    asked = shapes.select(F.col("unit_id").alias("asked"), geo.polygon_hash(F.transform("rings", F.reverse)).alias("shape"))
    found = geo.units_of_shapes(units, asked)
    return found.groupBy("asked").agg(_joined(F.transform(F.array_sort(F.collect_list("unit_id")), lambda x: x.cast("string"))).alias("units"))


@query("""
WITH p AS (SELECT c_custkey, floor((c_custkey * 37) % 3600 / 100.0) AS i, floor((c_custkey * 91) % 1800 / 100.0) AS j FROM customer),
e AS (SELECT user_id % 36 AS i, user_id % 18 AS j, ts::DATE::VARCHAR AS date, event_type FROM events)
SELECT c_custkey AS point_id, count(*) AS n, min(date) AS first_date, max(date) AS last_date, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS terms FROM p JOIN e USING (i, j) GROUP BY 1
""", dictionary_sql=False)
def x11_summary_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements of the cell that holds each point (X11): cells are summed up once, whatever number of points lie in them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, j = F.col("user_id") % 36, F.col("user_id") % 18
    rows = events.select(F.concat_ws("_", i, j).alias("cell_id"), i.alias("i"), j.alias("j"), F.to_date("ts").cast("string").alias("date"), F.col("event_type").alias("term"), F.lit("events").alias("dataset"))
    cells = rows.select("cell_id", F.col("i").cast("double").alias("west"), F.col("j").cast("double").alias("south")).distinct()
    found = geo.summary_at_points(_points(spark, sf_dir).withColumnRenamed("c_custkey", "point_id"), cells, 1.0, rows)
    return found.select("point_id", "n", "first_date", "last_date", _joined("terms").alias("terms"))


@query("""
WITH d AS (SELECT user_id % 7 AS cell, 10 * (1 + user_id % 3) AS radius, ts::DATE::VARCHAR AS date, event_type, max(event_id) AS v FROM events GROUP BY ALL)
SELECT cell, radius, date, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS properties FROM d GROUP BY cell, radius, date
""", dictionary_sql=False)
def x12_series_by_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of a cell by resolution and date, the properties of a date merged."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    radius = 10 * (1 + F.col("user_id") % 3)
    rows = events.select((F.col("user_id") % 7).alias("cell"), radius.alias("radius"), F.to_date("ts").cast("string").alias("date"), F.col("event_type").alias("term"), F.col("event_id").alias("value"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return geo.measurement_series(rows, ["cell", "radius"]).select("cell", "radius", "date", text.alias("properties"))
