from random import Random

from glossaria import model
from glossaria.operators import geo, walk
from glossaria.plans.dictionary import Dictionary

_RINGS = "shape_id int, rings array<array<struct<lon: double, lat: double>>>"


def _box(west, south, side):
    return [(west, south), (west + side, south), (west + side, south + side), (west, south + side), (west, south)]


def _odd(lon, lat, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                n += 1
    return n % 2 == 1


def test_shapes_of_points_against_all_pairs(spark):
    rng = Random(3)
    shapes = []
    for k in range(60):
        side = rng.choice([0.01, 0.5, 4.0, 20.0, 90.0])
        west, south = rng.uniform(-180, 180 - side), rng.uniform(-90, 90 - side)
        rings = [_box(west, south, side)]
        if k % 3 == 0:
            rings.append(_box(west + side / 4, south + side / 4, side / 2))
        if k % 4 == 0:  # a triangle instead
            rings[0] = [rings[0][0], rings[0][1], rings[0][3], rings[0][0]]
        shapes.append((k, rings))
    points = [(n, rng.uniform(-180, 180), rng.uniform(-90, 90)) for n in range(300)]
    points += [(1000 + k, r[0][0][0] + 0.003, r[0][0][1] + 0.002) for k, r in shapes]
    due = {(n, k) for n, lon, lat in points for k, rings in shapes if _odd(lon, lat, rings)}
    got = geo.shapes_of_points(spark.createDataFrame(points, "point_id int, lon double, lat double"), spark.createDataFrame(shapes, _RINGS)).collect()
    assert len(got) == len(due) > 100 and {tuple(r) for r in got} == due


def test_shapes_of_points_without_rings_or_points(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5), (1, 0.5, 0.5)], "point_id int, lon double, lat double")
    shapes = spark.createDataFrame([(1, [_box(0.0, 0.0, 1.0)]), (2, None), (3, []), (4, [[]])], _RINGS)
    assert sorted(tuple(r) for r in geo.shapes_of_points(points, shapes).collect()) == [(1, 1), (1, 1)]
    assert geo.shapes_of_points(points, shapes.limit(0)).count() == 0
    assert geo.shapes_of_points(points.limit(0), shapes).count() == 0


def test_units_of_shapes(spark):
    units = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", None]), (3, None)], "unit_id int, shapes array<string>")
    asked = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c"), (13, None)], "request_id int, shape string")
    got = geo.units_of_shapes(units, asked).select("request_id", "unit_id").collect()
    assert sorted(tuple(r) for r in got) == [(10, 1), (11, 1), (11, 2)]


def test_tree_rows_walk_through_other_predicates_and_circles(spark):
    steps = [("a", "root", model.SECTION_OF), ("b", "a", model.PROPERTY_OF), ("c", "b", model.SECTION_OF), ("root", "c", model.SECTION_OF)]
    rows = [(f"e{k}", [f"terms/{'root'}"], f"terms/{f}", p, f"terms/{t}") for k, (f, t, p) in enumerate(steps)]
    edges = spark.createDataFrame(rows, "edge_key string, roots array<string>, from string, predicate string, to string")
    asked = spark.createDataFrame([("q", "terms/root"), ("none", "terms/x")], "request_id string, root string")
    got = walk.tree_rows(Dictionary(None, edges), asked, [model.SECTION_OF])
    assert sorted((r["parent"], r["child"], r["depth"]) for r in got.collect()) == [("terms/b", "terms/c", 3), ("terms/c", "terms/root", 4), ("terms/root", "terms/a", 1)]
    assert walk.tree_rows(Dictionary(None, edges), asked, [model.SECTION_OF], levels=2).count() == 1
