import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaria.llm.periodic_runs import _searched, find_runs, op12_periodic_runs


def brute(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q):
                found.setdefault((i, n), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def made(rng):
    words = []
    while len(words) < rng.randint(0, 150):
        kind = rng.random()
        if kind < 0.4:
            words += [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        else:
            unit = [rng.choice("ab" if kind < 0.7 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31]))]
            if kind > 0.9:  # a period made of repeats
                unit = unit[:3] * 5 + unit[3:5]
            words += (unit * 9)[: int(len(unit) * rng.uniform(2, 8))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(4)
    texts = [made(rng) for _ in range(1500)] + [["a"] * 5000, list("ab") * 3000, [], ["a"]]
    texts += [list("ab" * k + "a") * 6 for k in range(1, 20)] + [list("a" * k + "b") * 5 for k in range(1, 20)]
    for words, (own, found) in zip(texts, _searched([" ".join(t) for t in texts]), strict=True):
        assert own == words and found == (brute(words) if len(words) < 4000 else [(0, len(words), 1 if words[1] == "a" else 2)])


def test_small_alphabets_whole():
    texts = [format(k, "014b") * 1 for k in range(2**14)]
    rows = list(_searched([" ".join(t) for t in texts]))
    assert all(found == brute(list(t)) for t, (_, found) in zip(texts, rows, strict=True))


def rows_of(docs):
    out = []
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = brute(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        drop = {i for s, k, q in found for i in range(s + q, s + k)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        rest = sha(" ".join(w for i, w in enumerate(words) if i not in drop))
        out.append((doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), rest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").limit(120).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    rows += [(5, "a b " * 9), (5, "a b " * 9), (None, "x " * 7), (None, None), (7, None), (8, ""), (9, " \t\n"), (None, "x " * 7), (11, "  é " * 8)]
    rows += [(k, "a b c d e f g h i j") for k in range(100, 160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("key", F.lit("k"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == rows_of(rows)
    assert find_runs(frame.limit(0)).count() == 0


def test_long_text(spark):
    words = np.random.default_rng(1).integers(0, 10**6, 300_000).astype(str).tolist()
    words[1000:1000] = words[:30_000] * 5
    row = find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1000, 150_000, 30_000)]
    assert row["n_words"] == 450_000


@pytest.mark.parametrize("least", [6, 9])
def test_least(least):
    from glossaria.llm.periodic_runs import runs

    words = np.array([1] * 8 + [2, 3] * 8 + [99])
    assert runs(words, np.array([24]), least) == [r for r in [(0, 8, 1), (8, 16, 2)] if r[1] >= least]
