import hashlib
import random
from collections import Counter

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from glossaria.llm.substring_dedup import SQL_OP13, op13_substring_dedup, remove_repeats


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    at = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if at[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def made(rng):
    line = [[f"p{k}_{j}" for j in range(rng.randint(3, 30))] for k in range(6)]
    out = []
    for _ in range(rng.randint(1, 60)):
        words = []
        for _ in range(rng.randint(0, 8)):
            kind = rng.random()
            if kind < 0.4:
                words += rng.choice(line)
            elif kind < 0.6:
                words += [rng.choice("ab")] * rng.randint(1, 20)
            else:
                words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))]
        out.append(rng.choice([" ", "\n", "\t "]).join(words) if rng.random() > 0.05 else None)
    return out + out[:3]


@pytest.mark.parametrize(("window", "gram", "hot"), [(6, 3, 4096), (6, 3, 1), (5, 5, 3), (12, 4, 2), (3, 1, 4096)])
def test_equals_brute_force(spark, window, gram, hot):
    rng = random.Random(window * 100 + hot)
    for _ in range(2):
        texts = made(rng)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        rows = sorted(remove_repeats(docs, window=window, gram=gram, hot=hot).collect())
        assert [(r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in rows] == brute(texts, window)


def test_query_equals_sql(spark, sf_dir):
    assert_same(op13_substring_dedup(spark, sf_dir), SQL_OP13, sf_dir)


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(40_000))
    passage = " ".join(f"q{k}" for k in range(50))
    rows = [(2**60 + 1, long), (None, passage + " x"), (None, "y " + passage), (7, None), (7, ""), (7, "a"), (8, "b c"), (8, "b c"), (None, long + " " + passage)]
    rows += [(9, "z " * 35), (10, "z " * 34)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("key", F.lit("k")).withColumn("places", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    due = [(i, n, m, sha(t)) for (i, _), (n, m, t) in zip(rows, brute([t for _, t in rows], 35), strict=True)]
    assert got == sorted(due, key=str)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_one_passage_in_every_text(spark):
    passage = " ".join(f"q{k}" for k in range(40))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), "id", F.lit(f" {passage} b"), "id").alias("text"))
    rows = remove_repeats(docs, hot=100).collect()
    assert all(r["kept"] == f"a{r['doc_id']} b{r['doc_id']}" for r in rows) and len(rows) == 3000
