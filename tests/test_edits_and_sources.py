import json

from pyspark.sql import functions as F

from glossaria import model
from glossaria.functions.columns import valid_key
from glossaria.operators import edits, geo, terms, walk
from glossaria.plans.dictionary import Dictionary
from glossaria.plans.fixture import dictionary
from glossaria.sources import tables
from glossaria.streaming import checks

DATA = "map<string,string>"


def _requests(spark, rows):
    return edits.children(spark.createDataFrame(rows, f"request_id string, root string, parent string, predicate string, child string, data {DATA}"))


def _canon(edges):
    return sorted((r["edge_key"], tuple(r["roots"]), tuple(sorted((r["data"] or {}).items()))) for r in edges.select("edge_key", "roots", "data").collect())


def test_set_then_delete_restores(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    asked = _requests(spark, [("a", "terms/geo", "terms/nation_1", model.ENUM_OF, "terms/customer_1", {}), ("b", "terms/catalog", "terms/region_1", model.ENUM_OF, "terms/nation_1", {})])
    plan = edits.plan_set_edges(d, asked)
    assert {r["action"] for r in plan.collect()} == {"inserted", "updated"}
    after = Dictionary(d.terms, edits.apply_edges(d.edges, plan).cache(), d.links)
    again = edits.plan_set_edges(after, asked)
    assert {r["action"] for r in again.collect()} == {"existing"}
    back = edits.apply_edge_deletes(after.edges, edits.plan_delete_edges(after, asked))
    assert _canon(back) == _canon(d.edges)


def test_payloads(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    row = ("a", "terms/geo", "terms/region_1", model.ENUM_OF, "terms/nation_1")
    first = edits.apply_edges(d.edges, edits.plan_set_edges(d, _requests(spark, [(*row, {"x": "1", "y.z": "2"})])))
    d = Dictionary(d.terms, first.cache(), d.links)
    merged = edits.plan_set_edges(d, _requests(spark, [(*row, {"x": None, "y.w": "3"})])).first()
    assert merged["action"] == "updated" and merged["data"] == {"y.z": "2", "y.w": "3"}
    reset = edits.plan_set_edges(d, _requests(spark, [(*row, None)])).first()
    assert reset["action"] == "updated" and reset["data"] == {}


def test_paths_have_no_circles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    edges = spark.createDataFrame([(f"k{i}", f"terms/{x}", model.ENUM_OF, f"terms/{y}", ["terms/d"], {}) for i, (x, y) in enumerate(rows)], model.EDGES)
    d = Dictionary(spark.createDataFrame([], "_key string"), edges)
    asked = spark.createDataFrame([("r", "terms/d", "terms/d")], "request_id string, root string, parent string")
    found = [r["vertices"] for r in walk.level_paths(d, asked, (model.ENUM_OF,)).collect()]
    assert sorted(map(len, found)) == [2, 3, 4] and all(len(v) == len(set(v)) for v in found)
    assert walk.tree(d, asked.select("request_id", "root"), (model.ENUM_OF,)).count() == 4


def test_insert_plans(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    new = d.terms.where("_key IN ('nation_1', 'nation_2')").withColumn("_code", F.when(F.col("_key") == "nation_1", F.col("_code").withField("_lid", F.lit("new"))).otherwise(F.col("_code")))
    got = {r["_key"]: r["action"] for r in terms.plan_inserts(d.terms, new).collect()}
    assert got == {"nation_new": "inserted", "nation_2": "conflict"}
    keys = spark.createDataFrame([("nation_1",), ("none",)], "_key string")
    assert {r["_key"]: r["action"] for r in terms.plan_deletes(d.terms, keys).collect()} == {"nation_1": "removed", "none": "ignored"}


def test_save_and_read(spark, sf_dir, tmp_path):
    d = dictionary(spark, sf_dir)
    tables.save(d, f"file://{tmp_path}/d")
    back = tables.read(spark, f"file://{tmp_path}/d")
    assert _canon(back.edges) == _canon(d.edges) and back.terms.count() == d.terms.count()
    assert spark.read.parquet(f"file://{tmp_path}/d/edge_path").count() == d.edge_path.count()


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    rows = tables.read_lines(spark, f"file://{tmp_path}/x.jsonl", "a INT").collect()
    assert [r["a"] for r in rows] == [1, None] and rows[1]["_corrupt"] == "{broken"


def test_bulk_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.replace(t, new, "k").collect())) == [(1, "a"), (2, "c")]
    assert [tuple(r) for r in tables.remove(t, new, "k").collect()] == [(1, "a")]
    try:
        tables.insert(t, new, "k")
        raise AssertionError("a taken key went through")
    except ValueError as e:
        assert "2" in str(e)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from glossaria import queries

    d, rules = dictionary(spark, sf_dir), queries.rules(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_id"), F.lit("size").alias("descriptor"), F.col("p_size").alias("x"))
    part.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in").select("row_id", "descriptor", F.col("x").cast("variant").alias("value"))
    checks.validate_stream(d, rules, stream, f"{tmp_path}/out", f"{tmp_path}/cp", f"{tmp_path}/n", levels=1).awaitTermination()
    batch = queries.QUERIES["v19_size"](spark, sf_dir).where("code <> 0")
    got = spark.read.parquet(f"{tmp_path}/out").select("row_id", "code")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert spark.read.parquet(f"{tmp_path}/n").agg(F.sum("errors")).first()[0] == batch.count()


def test_columns(spark):
    rows = spark.createDataFrame([("a-b_1",), ("a b",), ("",), (None,)], "k string")
    assert [r[0] for r in rows.select(valid_key(F.col("k"))).collect()] == [True, False, False, False]


def test_polygon(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    rows = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0)], "lon double, lat double")
    assert [r[0] for r in rows.select(geo.inside_ring(F.col("lon"), F.col("lat"), ring)).collect()] == [True, False]
    assert json.loads('{"a": 1}') == {"a": 1}
