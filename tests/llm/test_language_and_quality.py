import random

from pyspark.sql import functions as F

from glossaria.llm import language_id, quality_rules
from glossaria.llm.common import held_out


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_id.fit(train)
    assert list(model.content) == ["en", "fr"]
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 !! \u0301\u0302", "a"), (4, "the cat " * 60000, "a"), (4, "the cat sat", "a"), (4, "the cat sat", "a"), (None, "le chat est", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("margin", F.lit(7))
    out = language_id.identify(docs, model).collect()
    assert [r["lang_pred"] for r in out] == ["und", "und", "und", "en", "en", "en", "fr"]
    assert [r["rejected"] for r in out][:3] == [True] * 3 and all(0 <= r["score"] <= 1 for r in out)
    assert language_id.identify(docs.limit(0), model).count() == 0
    clash = language_id.identify(docs.withColumn("_letters", F.lit("l")), model)
    assert clash.columns.count("_letters") == 1 and {r["_letters"] for r in clash.collect()} == {"l"}
    nothing = language_id.fit(train.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_texts_of_two_languages_and_of_none_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 5)))
    by: dict[str, list[str]] = {}
    for r in docs.where("text IS NOT NULL AND lang IS NOT NULL AND n_chars > 300").select("lang", "text").collect():
        by.setdefault(r["lang"], []).append(r["text"])
    rng = random.Random(3)
    mixed, noise = [], []
    for _ in range(200):
        a, b = (rng.choice(by[k]) for k in rng.sample(sorted(by), 2))
        n = min(len(a), len(b))
        mixed.append(f"{a[:n]} {b[:n]}")
        noise.append(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(10, 400))))

    def rejected(texts):
        rows = spark.createDataFrame([(t,) for t in texts], "text string")
        return language_id.identify(rows, model).where("rejected").count() / len(texts)

    assert rejected(mixed) > 0.5 and rejected(noise) > 0.8
    own = language_id.identify(docs.where("text IS NOT NULL AND lang IS NOT NULL"), model)
    assert own.where("rejected").count() < 0.02 * own.count()


def test_ties_go_to_the_first_language_and_are_rejected(spark):
    model = language_id.LanguageModel({"a": b"the cat sat " * 9, "b": b"the cat sat " * 9})
    out = language_id.identify(spark.createDataFrame([("the cat",)], "text string"), model).first()
    assert (out["lang_pred"], out["margin"], out["rejected"]) == ("a", 0.0, True)


def test_large_ids_beside_nulls(spark):
    model = language_id.LanguageModel({"a": b"the cat sat ", "b": b"le chat "})
    rows = spark.createDataFrame([(2**60 + 1, "the cat"), (None, "le chat")], "doc_id long, text string")
    assert {r["doc_id"] for r in language_id.identify(rows, model).collect()} == {2**60 + 1, None}


def test_every_language_and_whole_texts_teach(spark):
    words = {f"l{k:03d}": chr(0x4E00 + k) * 3 for k in range(80)}
    train = spark.createDataFrame([(f"{'q ' * 3000}{w} {w}", lang) for lang, w in words.items()], "text string, lang string")
    model = language_id.fit(train)
    assert set(model.content) == set(words) and all(words[k].encode() in v for k, v in model.content.items())


def test_sizes_equal_the_library(spark):
    import zstandard

    model = language_id.LanguageModel({"en": b"the cat sat on the mat " * 9, "fr": b"le chat est sur la table " * 9})
    text = "the cat est sur the table " * 1500
    out = language_id.identify(spark.createDataFrame([(text,)], "text string"), model).first()
    data, sizes = f" {text.strip()} ".encode(), []
    for content in model.content.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=model.level)
        c = zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        parts = -(-len(data) // model.block_bytes)
        cuts = [len(data) * k // parts for k in range(parts + 1)]
        sizes.append([len(c.compress(data[a:b])) for a, b in zip(cuts, cuts[1:])])
    best = int(sum(sizes[1]) < sum(sizes[0]))
    margins = [(y - x) / y for x, y in zip(sizes[best], sizes[1 - best])]
    assert len(margins) > 1 and out["lang_pred"] == ["en", "fr"][best] and abs(out["margin"] - min(margins)) < 1e-12


def test_training_ignores_held_out(spark):
    row = spark.range(200).select(held_out(F.col("id"), 5).alias("h"), "id")
    import zlib

    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in row.collect())


def _brute(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(hit)


def test_quality_edges(spark):
    texts = [None, "", " \n\t ", "a b c a b c", "a a a a", "x y z\nx y z\n\nx y z", "a b c\x0bd", "é # * $ % & | < >", "one two three " * 30_000, "w " * 49, "the " + " ".join(f"word{i} of" for i in range(60))]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] * 2, "doc_id int, text string, n_words string")
    out = quality_rules.score(docs).collect()
    assert len(out) == 2 * len(texts)
    for r in out:
        n, chars, repeated = _brute(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (n, chars, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["base_failed"] and r["kept"])
    by = {r["doc_id"]: r for r in out}
    assert by[5]["n_dup_lines"] == 2 and by[7]["n_symbols"] == 8 and by[10]["kept"]
    assert quality_rules.score(docs.limit(0)).count() == 0
    assert quality_rules.score(docs.withColumn("_m", F.lit(1))).columns.count("_m") == 1
