import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossaria.llm import byte_bpe, packing, token_files
from glossaria.llm.common import shared_dir
from glossaria.llm.tokens import library_encoder

PIECES = [" ", "  ", "\n", "\t", "a", "the", "The", "é", "²", "x́", "\x1c", "\xa0", "　", "中文", "🙂", "123", "'s", "'ll", "...", "aaaa", "_", "A.", "İ", "<|endoftext|>"]


def _texts():
    random.seed(3)
    made = ["".join(random.choices(PIECES, k=random.randint(1, 40))) for _ in range(1500)]
    return ["", "a", " ", "   ", "\n \n", "a\n ", "a \nb", " " * 50 + "x", "a" * 3000, "x\x1cy \x1c z", *made]


def test_bpe_equals_tiktoken():
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges, encoder = byte_bpe._loaded(path, P.PATTERN)
    for text, ids in zip(_texts(), encoder.batch(_texts()), strict=True):
        assert ids.tolist() == whole.encode_ordinary(text)
        assert merges.decode(ids) == text.encode()


def test_merges_that_make_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 400, b"abc": 300, b"cab": 280, b"aa": 500, b"aaa": 450}
    table = byte_bpe.MergeTable(ranks)
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abc", k=rng.randint(1, 12))) for _ in range(400)]
    flat, n = table.replay(words)
    for word, ids in zip(words, np.split(flat, np.cumsum(n)[:-1]), strict=True):
        assert ids.tolist() == ([ranks[word]] if word in ranks else table.one(word))
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for seed in range(20):
        rng = random.Random(seed)
        made = [bytes(rng.choices(b"abc", k=rng.randint(2, 4))) for _ in range(12)]
        odd = {bytes([b]): b for b in range(256)} | {w: 300 + k for k, w in enumerate(dict.fromkeys(made))}
        library, own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=odd, special_tokens={}), byte_bpe.MergeTable(odd)
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 30))) for _ in range(200)]
        flat, n = own.replay(words)
        for word, ids in zip(words, np.split(flat, np.cumsum(n)[:-1]), strict=True):
            assert ids.tolist() == library.encode_ordinary(word.decode())


def test_a_run_of_a_million_letters():
    merges, _ = byte_bpe._loaded(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    for word in ("a" * 1_000_000, "ab" * 250_000):
        want = library.encode_ordinary(word)
        assert merges.replay([word.encode()])[0].tolist() == want and merges.one(word.encode()) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    for text, ids in zip(_texts(), library_encoder(name).batch(_texts()), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


ROWS = [(5, "b b"), (1, None), (3, ""), (3, "twice"), (3, "twice"), (-4, "the end. " * 20_000), (None, "nameless"), (9, "z")]


def test_bpe_round_trip(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, ids int").drop("ids").withColumn("extra", F.lit("e"))
    path = P.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in out) and len(out) == len(ROWS)
    assert byte_bpe.digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_token_files(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS + [(None, None)]], "doc_id long, text string, key string")
    root = f"{shared_dir(spark)}/t"
    written = token_files.write(docs, root, "byte_bpe_50k.json", 2, shard_bytes=60_000)
    rows = sorted(token_files.read(written, root).collect(), key=lambda r: r["start"])
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for k, t in ROWS + [(None, None)]:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((k is None, k or 0, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r["key"] is None, r["key"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert [r["key"] for r in rows] == [-4, 1, 3, 3, 3, 5, 9, None, None]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    token_files.publish_manifest(written, root)
    folder = token_files.Tokens(root)
    for key in {k for k, _ in ROWS if k is not None}:
        due = sorted(whole.encode(t or "", add_special_tokens=False).ids + [2] for k, t in ROWS if k == key)
        assert sorted(ids.tolist() for ids in folder.get(key)) == due
    assert folder.get(77) == folder.get(-(2**62)) == folder.get(2**62) == []
    empty = token_files.write(docs.limit(0), root + "0", "byte_bpe_50k.json", 2)
    assert token_files.read(empty, root + "0").count() == 0
    unknown = written.withColumn("key", F.when(F.col("key") == 5, 77).otherwise(F.col("key")))
    with pytest.raises(Exception, match="does not hold"):
        token_files.read(unknown, root).collect()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert len(token_files.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


def _packed_whole(out, docs, limits, name):
    """Every id in exactly one piece, pieces gapless in their sequences, all three limits kept."""
    whole, bears = Tokenizer.from_file(P.path(name)), packing.bears_loss(name, 2)
    for text, pieces in docs:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], np.int32)
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            mine = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(mine.astype("<u4").tobytes())
            assert p["loss_tokens"] <= bears[mine].sum()
            at += p["length"]
        assert at == len(ids)
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == (rows["length"].cumsum() - rows["length"]).tolist()
        assert rows["length"].sum() <= limits.tokens and len(rows) <= limits.segments and rows["loss_tokens"].sum() <= limits.loss_tokens


def test_packing(spark):
    docs = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id long, text string, start int")
    out = packing.pack_texts(docs, "word_bpe_49k.json", 2).toPandas()
    alone = {k: t for k, t in ROWS if k not in (3, None)}
    _packed_whole(out, [(t, out[out["doc_id"] == k].to_dict("records")) for k, t in alone.items()], packing.Limits(), "word_bpe_49k.json")
    assert out.groupby("doc_id", dropna=False)["doc_tokens"].count().sum() == len(out)
    assert packing.pack_texts(docs.limit(0), "word_bpe_49k.json", 2).count() == 0
    with pytest.raises(ValueError):
        packing.Limits(loss_tokens=0)


@pytest.mark.parametrize("limits", [packing.Limits(tokens=256, segments=3, loss_tokens=90, pool=16), packing.Limits(tokens=256, segments=64, loss_tokens=60, pool=16)])
def test_packing_with_prompts(spark, sf_dir, limits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(20).alias("prompt"))
    out = packing.pack_texts(docs, "word_bpe_49k.json", 2, limits, context_tokens="prompt").toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    _packed_whole(out, [(texts[k], rows.to_dict("records")) for k, rows in out.groupby("doc_id")], limits, "word_bpe_49k.json")
    assert set(out["doc_id"]) == set(texts)
    assert out.groupby("sequence_id")["loss_tokens"].sum().max() == limits.loss_tokens  # the limit binds


def test_op9_equals_brute_force(spark, sf_dir):
    out = packing.op9_packing(spark, sf_dir).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    _packed_whole(out, [(texts[k], rows.to_dict("records")) for k, rows in out.groupby("doc_id")], packing.Limits(), "word_bpe_49k.json")
    used = out.groupby("sequence_id")["length"].sum()
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used)
    assert set(out["doc_id"]) == set(texts) and padded < 0.02 * used.sum()


def test_op7_equals_brute_force(spark, sf_dir):
    rows = sorted(token_files.op7_token_files(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    at = 0
    for r, d in zip(rows, sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()), strict=True):
        ids = np.array(whole.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(2)
    limits = packing.Limits(tokens=64, segments=4, loss_tokens=40, pool=16)
    packer, docs, placed = packing.Packer(limits), [], []
    for k in range(300):
        ids = rng.integers(0, 1000, rng.integers(1, 150)).astype(np.int32)
        docs.append((ids, rng.random(len(ids)) < 0.6))
        placed += packer.add(k, *docs[-1])
    placed += packer.finish()
    for k, (ids, loss) in enumerate(docs):
        mine = sorted((p.start, p) for p, *_ in placed if p.row == k)
        assert np.array_equal(np.concatenate([p.ids for _, p in mine]), ids) and np.array_equal(np.concatenate([p.loss for _, p in mine]), loss)
    by = {}
    for piece, sequence, offset in placed:
        by.setdefault(sequence, []).append((offset, piece))
    for pieces in by.values():
        at = 0
        for offset, piece in pieces:
            assert offset == at
            at += len(piece.ids)
        assert at <= 64 and len(pieces) <= 4 and sum(p.loss_tokens() for _, p in pieces) <= 40
    crc = zlib.crc32(docs[0][0].tobytes())
    assert isinstance(crc, int)
