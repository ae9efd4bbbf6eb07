"""Walks of many requests with shared targets: the rows that they write follow the graph and the answers."""

import pytest

from glossaria import model
from glossaria.operators import walk
from glossaria.plans.dictionary import Dictionary

N = 80


@pytest.fixture
def written(monkeypatch):
    """The number of rows of each table that a walk writes."""
    counts, plain = [], walk.cut

    def counted(df):
        out = plain(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(walk, "cut", counted)
    return counts


def _bush(spark):
    """A root with four sections and N elements that all have one name."""
    steps = [(f"terms/s{k}", model.SECTION_OF, "terms/root") for k in range(4)] + [(f"terms/e{k}", model.ENUM_OF, f"terms/s{k % 4}") for k in range(N)]
    edges = spark.createDataFrame([(f"k{n}", ["terms/root"], *s) for n, s in enumerate(steps)], "edge_key string, roots array<string>, from string, predicate string, to string")
    code = "_key string, _code struct<_nid: string, _lid: string, _gid: string, _aid: array<string>, _pid: array<string>, _name: string>"
    terms = spark.createDataFrame([(f"e{k}", ("e", str(k), f"e{k}", ["same"], None, "same")) for k in range(N)], code)
    return Dictionary(terms, edges)


def test_paths_to_targets_of_one_code(spark, written):
    asked = spark.createDataFrame([("q", "terms/root", "_aid", "same")], "request_id string, root string, field string, code string")
    got = walk.code_paths(_bush(spark), asked, [model.ENUM_OF, model.SECTION_OF]).collect()
    assert sorted(r["vertices"] for r in got) == sorted(["terms/root", f"terms/s{k % 4}", f"terms/e{k}"] for k in range(N))
    assert max(written) <= 2 * N


def test_elements_of_one_code(spark, written):
    asked = [("q", "terms/root", "_aid", "same"), ("q", "terms/root", "_name", "same"), ("none", "terms/root", "_lid", "x"), ("e3", "terms/root", "_lid", "3"), ("else", "terms/other", "_lid", "3")]
    asked = spark.createDataFrame(asked, "request_id string, root string, field string, code string")
    got = walk.match_enumeration_code(_bush(spark), asked).collect()
    due = [("q", f"terms/e{k}") for k in range(N)] + [("e3", "terms/e3")]
    assert sorted((r["request_id"], r["node"]) for r in got) == sorted(due)
    assert all(r["depth"] == 2 and len(r["edges"]) == 2 for r in got) and max(written) <= 2 * N


def test_first_enumeration_edges_of_many_targets(spark, written):
    asked = [(f"q{k}", "terms/root", f"terms/e{k}") for k in range(N)] + [(f"s{k}", "terms/root", f"terms/s{k}") for k in range(4)] + [("none", "terms/root", "terms/x")]
    asked = spark.createDataFrame(asked, "request_id string, root string, target string")
    got = {r["request_id"]: r["vertices"] for r in walk.match_enumeration(_bush(spark), asked).collect()}
    assert len(got) == N + 4 and got["q7"] == ["terms/root", "terms/s3", "terms/e7"]
    least = {s: min((f"k{4 + k}", k) for k in range(N) if k % 4 == s)[1] for s in range(4)}
    assert all(got[f"s{s}"] == ["terms/root", f"terms/s{s}", f"terms/e{k}"] for s, k in least.items())
    assert max(written) <= 2 * N


def test_least_vertices_of_paths_with_one_last_edge(spark):
    steps = [("b", "root"), ("a", "root"), ("c", "a"), ("c", "b")]
    rows = [(f"k{n}", ["terms/root"], f"terms/{f}", model.SECTION_OF, f"terms/{t}") for n, (f, t) in enumerate(steps)] + [("z", ["terms/root"], "terms/d", model.ENUM_OF, "terms/c")]
    edges = spark.createDataFrame(rows, "edge_key string, roots array<string>, from string, predicate string, to string")
    asked = spark.createDataFrame([("q", "terms/root", "terms/d")], "request_id string, root string, target string")
    got = walk.match_enumeration(Dictionary(None, edges), asked).collect()
    assert [r["vertices"] for r in got] == [["terms/root", "terms/a", "terms/c", "terms/d"]]


def test_terms_of_links_that_many_requests_share(spark, monkeypatch):
    tables, plain = [], walk.cut
    monkeypatch.setattr(walk, "cut", lambda df: (lambda out: (tables.append(out), out)[1])(plain(df)))
    hub = [(f"terms/q{k}", "up", "terms/hub") for k in range(N)] + [("terms/hub", "has", f"terms/e{k}") for k in range(N)] + [("terms/q0", "has", "terms/nobody")]
    links = spark.createDataFrame(hub, "from string, predicate string, to string")
    terms = spark.createDataFrame([(f"e{k}", f"name {k}") for k in range(N)], "_key string, name string")
    asked = spark.createDataFrame([(f"q{k}", f"q{k}") for k in range(N)], "request_id string, key string")
    got = walk.linked_terms(Dictionary(terms, None, links), asked, "has").select("request_id", "key", "term._key").collect()
    due = {(f"q{q}", f"e{k}", f"e{k}") for q in range(N) for k in range(N)} | {("q0", "nobody", None)}
    assert len(got) == len(due) and {tuple(r) for r in got} == due
    assert [t.count() for t in tables if "term" in t.columns] == [N + 1]  # each term once, not once a request
    assert max(t.count() for t in tables) <= 3 * N
