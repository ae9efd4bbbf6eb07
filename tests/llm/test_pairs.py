import itertools
import random

import numpy as np
import pytest

from glossaria.llm.components import components
from glossaria.llm.embedding_dedup import CapFilters, near_vectors, plan
from glossaria.llm.ngram_join import Forest, Shingler, links_within, meeting, near_duplicates, recall, stars, tries


def _groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + k) for k in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "hub long, node long")).collect()}
    want = _groups({n for x in links for n in x}, links)
    assert got == {n: want[n] for n in got} and all(n in got for a, b in links if a != b for n in (a, b))
    assert components(spark.createDataFrame([], "hub long, node long")).count() == 0


def _shingles(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    rows = [(k, " ".join(word() for _ in range(rng.choice((3, 30, 80))))) for k in range(60)]
    base = [word() for _ in range(200)]
    for k in range(100, 140):  # a group of near copies that block-pairs must cover
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(200)] = word()
        rows.append((k, " ".join(copy)))
    rows += [(200 + k, " ".join(base)) for k in range(5)] + [(300, None), (301, ""), (302, " \n"), (303, "two words"), (304, "Two  words"), (305, "a b c d e " * 20_000), (306, "a b c d e " * 20_001)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    got = {r["doc_id"]: r for r in near_duplicates(docs, block=8).collect()}
    sets = {k: _shingles(t) for k, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    groups = _groups(sets, links)
    assert {k: r["class_id"] for k, r in got.items()} == groups
    assert all(r["n_links"] == sum(k in x for x in links) for k, r in got.items())
    assert all(r["kept"] == (groups[k] == k) for k, r in got.items())


def test_near_duplicates_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "one two three"), (1, "one two three"), (1, "one two three"), (2, "one two three")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(-1, -1, 0, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False)]
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("depth,target", [(10, 0.999), (10, 1.0), (7, 0.5)])
def test_prefixes_shortened_to_the_end(spark, depth, target):
    rows = _corpus()[:100]
    sets = {k: _shingles(t) for k, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8, depth=depth, least_depth=6, target=target).collect()
    assert all(r["n_links"] == sum(r["doc_id"] in x for x in links) for r in got)


def test_recall_of_a_depth():
    bins = np.zeros(20)
    assert recall(bins, 0.8, 10, 32) == 1.0
    bins[0] = 100  # links at the threshold: the share that meets is their probability of meeting
    assert abs(recall(bins, 0.8, 10, 32) - meeting(0.8, 10, 32)) < 1e-12
    bins[19] = 10_000
    assert recall(bins, 0.8, 10, 32) > 0.999 > recall(bins, 0.8, 10, 8)


@pytest.mark.parametrize("least_depth,step", [(4, 3), (5, 2), (9, 3), (10, 3)])
def test_tries_with_a_label_that_most_classes_share(spark, least_depth, step):
    rng = np.random.default_rng(7)
    values = rng.integers(0, 3, (90, 2, 10))
    values[:50, 0] = values[0, 0]  # a hot leaf of the first tree
    labels = (values.astype(np.int64) << (np.arange(9, -1, -1) * 6)).sum(axis=2)
    classes = spark.createDataFrame([(k, x) for k, x in enumerate(labels.tolist())], "node long, labels array<long>")
    leaves = tries(classes, 10, least_depth, step)

    def common(a, b):
        return next((k for k in range(10) if a[k] != b[k]), 10)

    best = {(t, i): max(common(values[i, t], values[j, t]) for j in range(90) if j != i) for t in (0, 1) for i in range(90)}
    assert {(r["tree"], r["node"]): r["meets"] for r in leaves.collect()} == {k: v for k, v in best.items() if v >= least_depth}
    for k in range(least_depth, 11):
        nodes = {}
        for t, i in itertools.product((0, 1), range(90)):
            nodes.setdefault((t, *values[i, t, :k]), []).append(i)
        assert {(r["hub"], r["node"]) for r in stars(leaves, 10, k).collect()} == {(x[0], y) for x in nodes.values() for y in x[1:]}


def test_a_lone_link_at_the_threshold(spark):
    # 90 of 100 shingles on either side, 80 in common: 80 / 100; without a link found the prefix goes on shortening until such a link meets
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words[:94])), (2, " ".join(words[10:104])), (3, " ".join(words[200:300]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_labels_agree_as_often_as_sets():
    forest, rng = Forest(32, 10), np.random.default_rng(3)
    rows = []
    for _ in range(60):
        s = rng.integers(0, 2**63, 500).astype(np.uint64)
        a, b = forest.labels(np.unique(s[:450])), forest.labels(np.unique(s[50:]))
        rows.append([((a >> 6 * k) & 63) == ((b >> 6 * k) & 63) for k in range(10)])
    assert abs(np.mean(rows) - meeting(0.8, 1, 1)) < 0.02
    met = np.mean([np.array(r)[::-1][:6].all(axis=0).any() for r in rows])
    assert met >= 0.9 and len(Shingler(5)("a b c")) == 1


def test_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " x"), (1, b)], "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got) == [(1, 1, 1, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 1, False), (3, 1, 2, False)]
    assert len({r["group_key"] for r in got}) == 2


def test_links_within_halves():
    sets = [np.array(sorted(s), np.uint64) for s in ({1, 2, 3, 4}, {1, 2, 3, 4}, {1, 2, 3, 4, 5}, {9})]
    weights = np.array([1, 2, 4, 8])
    assert links_within(sets, weights, 0.8, None)[0].tolist() == [6, 5, 3, 0]
    assert links_within(sets, weights, 0.8, 1)[0].tolist() == [6, 1, 1, 0]


@pytest.mark.parametrize("shared", [4, 12, 44, 396, 1204, 20_000])
def test_links_at_exactly_the_threshold(shared):
    whole = np.arange(shared * 5 // 4, dtype=np.uint64)
    over, under = whole[:shared], whole[: shared - 1]
    assert links_within([whole, over], np.array([1, 1]), 0.8, None)[0].tolist() == [1, 1]
    assert links_within([whole, under], np.array([1, 1]), 0.8, None)[0].tolist() == [0, 0]


def test_a_text_and_the_same_with_three_words_more(spark):
    words = [f"w{k}" for k in range(19)]
    docs = spark.createDataFrame([(1, " ".join(words[:16])), (2, " ".join(words))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False)]


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((20, 16))
    rows = []
    for k in range(120):
        v = base[k % 20] + rng.standard_normal(16) * rng.choice((0.05, 0.3, 0.6))
        rows.append((k, v.astype(np.float32).tolist(), k % 3))
    rows += [(500 + k, rows[0][1], 0) for k in range(4)] + [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, rows[0][1], None), (604, [None] * 16, 0), (605, [], 0), (606, rows[0][1][:5], 0), (607, [x * 3 for x in rows[0][1]], 0), (608, [float("inf")] * 16, 1)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: r for r in near_vectors(table).collect()}
    good = {k: (np.array(e, np.float32).astype(float), y) for k, e, y in rows if e and y is not None and None not in e and np.isfinite(e).all() and any(e)}
    links = []
    for a, b in itertools.combinations(sorted(good), 2):
        (x, p), (y, q) = good[a], good[b]
        if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
            links.append((a, b))
    groups = _groups({r[0] for r in rows}, links)
    assert {k: r["component_id"] for k, r in got.items()} == groups
    assert all(r["n_links"] == sum(k in x for x in links) and r["kept"] == (groups[k] == k) for k, r in got.items())
    assert near_vectors(table.limit(0)).count() == 0


def test_vectors_that_share_an_id_stay_apart(spark):
    a, b = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (1, a, 1), (9, a, 2), (9, a, 2)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (9, 1, 9), (9, 1, 9)]


def test_decoding_lists_every_cap():
    caps = CapFilters(15, blocks=3, code=6, each=5)
    x = np.random.default_rng(7).standard_normal((30, 15))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ caps.rotation
    for row, found in zip(unit, caps.decode(x), strict=True):
        want = {
            (i * 6 + j) * 6 + k
            for i, j, k in itertools.product(range(6), repeat=3)
            if sum(row[a:b] @ c[n] for a, b, c, n in zip(caps.cuts[:-1], caps.cuts[1:], caps.codes, (i, j, k), strict=True)) >= caps.least
        }
        assert set(found.tolist()) == want


@pytest.mark.parametrize("dim", [2, 3, 8, 16, 64])
def test_recall_at_the_threshold(dim):
    rng = np.random.default_rng(8)
    y = rng.standard_normal((300, dim))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = rng.standard_normal(y.shape)
    z -= (z * y).sum(axis=1, keepdims=True) * y
    z = 0.93 * y + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(len(y), bool)
    for k in range(9):
        caps = CapFilters(dim, seed=k)
        met |= [bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(caps.decode(y), caps.decode(z), strict=True)]
    assert met.mean() >= 0.98


@pytest.mark.parametrize("n", [1000, 200_000])
def test_filters_follow_the_vectors(n):
    options, codes = plan(64, n, 0.93, 0.998)
    caps = CapFilters(64, seed=20, **options)
    x = np.random.default_rng(9).standard_normal((50, 64))
    held = np.mean([len(a) for a in caps.decode(x)])
    chance = n * held**2 / caps.code**3 * codes  # pairs that meet by chance, a vector
    assert 0.5 * options["each"] < held < 2 * options["each"] and codes <= 14 and chance < 200


def test_nodes_of_many_hubs_keep_one_edge_each(spark, monkeypatch):
    from glossaria.llm import components as module

    sizes, plain = [], module.materialized

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(module, "materialized", counted)
    edges = [(h, n) for n in range(100, 400) for h in range(20)] + [(1000, 1001), (1002, 1001), (2001, 2000)]
    got = {(r["node"], r["component"]) for r in module.components(spark.createDataFrame(edges, "hub long, node long")).collect()}
    assert got == {(n, 0) for n in [*range(20), *range(100, 400)]} | {(n, 1000) for n in (1000, 1001, 1002)} | {(2000, 2000), (2001, 2000)}
    assert max(sizes) <= 325
