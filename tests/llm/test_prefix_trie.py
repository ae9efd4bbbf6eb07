import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from glossaria.llm import prefix_trie
from glossaria.llm.prefix_trie import SQL_OP11, conversation_trie, op11_prefix_trie


def brute(conversations):
    """Rows of the trie of {conv_id: [(role, text)]}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(n)) for n, m in members.items()), key=str)


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def conversations(rng, n):
    say = lambda: (rng.choice(["user", "", None, "système"]), rng.choice(["a", "", None, "é" * 5, "b", "c"]))
    return {c: [say() for _ in range(rng.choice([1, 2, 3, 5, 9, 12]))] for c in rng.sample(range(-20, 4 * n), n)}


def frame(spark, own):
    return spark.createDataFrame([(c, k, r, t) for c, turns in own.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")


def plain(own):
    return {c: [(r or "", t or "") for r, t in turns] for c, turns in own.items()}


@pytest.mark.parametrize("part", [1024, 2])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(prefix_trie, "_PART", part)
    own = conversations(random.Random(part), 60)
    frame(spark, own).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in op11_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rebuilt(plain(own)))


def test_query_equals_sql(spark, sf_dir):
    assert_same(op11_prefix_trie(spark, sf_dir), SQL_OP11, sf_dir)


def test_odd_rows(spark):
    long = "x" * 10**6
    rows = [(1, None, "user", "first"), (1, 0, None, "second"), (1, 5, "user", long), (2, 3, "user", "first"), (2, 3, "user", "first"), (None, 0, "user", "lost"), (2**60, 1, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("g", F.lit(1)).withColumn("d", F.lit("d")).withColumn("n_bytes", F.lit(7))
    own = {1: [("user", "first"), ("", "second"), ("user", long)], 2: [("user", "first")] * 2, 2**60: [("user", "")]}
    assert sorted((tuple(r) for r in conversation_trie(turns).collect()), key=str) == brute(own)
    assert conversation_trie(turns.limit(0)).count() == 0


def test_many_equal_conversations_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_TEXT", 100)
    own = {c: [("user", "hi"), ("assistant", "yes")] for c in range(2000)} | {5000: [("user", str(k)) for k in range(3000)], 5001: [("user", str(k)) for k in range(2500)]}
    got = sorted((tuple(r) for r in conversation_trie(frame(spark, own)).collect()), key=str)
    root = (0, 0, None, 2002, 2, 2, 1999 * 5 + sum(len(str(k)) for k in range(2500)), hashlib.sha256(b"").hexdigest())
    assert root in got and len(got) == 1 + 2 + 3000
    assert (0, 2, 0, 2000, 0, 1, 1999 * 3, hashlib.sha256(",".join(map(str, range(2000))).encode()).hexdigest()) in got
    assert (5000, 3000, 5000, 1, 0, 1, 0, hashlib.sha256(b"5000").hexdigest()) in got
    assert (5000, 2500, 5000, 2, 1, 1, 4, hashlib.sha256(b"5001").hexdigest()) in got
