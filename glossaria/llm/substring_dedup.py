"""Removal of word windows that occur more than once, by super-k-mers.

1. The minimiser of a window is its gram of least hash, the leftmost of equals. Consecutive windows with the minimiser at one place form a
   super-k-mer, which is kept as that place's gram hash and its first window.
2. Equal windows have equal minimisers, at the same place within them. A count-min sketch of all super-k-mers' hashes proves most of them
   single; their windows occur once. The others travel, each as one packed string, to the bucket of their hash.
3. In a bucket the windows of all strings are sorted, and equal neighbours are repeats. A bucket of more than ``HOT`` strings is not
   gathered: digests of its windows are counted by Spark, which sums before it shuffles.
4. Equal strings have one digest. A task sends a string twice at most, enough to be counted as repeated, and the verdict, one bit for each window,
   goes to every place where the string stands.

Windows are compared as bytes in buckets and by 128-bit digests beyond ``HOT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import SPACES, materialized, table
from glossaria.llm.sketch import may_repeat, sketch

HOT = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_REMEMBER = 300_000


class _Hashes(dict):
    """The hashes of words seen of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class SuperKmers:
    """The first windows and the minimisers' hashes of a text's super-k-mers."""

    def __init__(self, window: int, gram: int):
        self.window, self.wide = window, window - gram + 1
        if not 1 <= gram <= window or self.wide > 63:
            raise ValueError("a window holds between 1 and 63 grams")
        self.factors = [np.uint64(pow(0x100000001B3, 2 * k + 1, 2**64)) for k in range(gram)]
        self.words = _Hashes()

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < self.window:
            return np.empty(0, np.int32), np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(h) - len(self.factors) + 1
        grams = h[:n] * self.factors[0]
        for k in range(1, len(self.factors)):
            grams += h[k : n + k] * self.factors[k]
        grams = (grams ^ (grams >> np.uint64(29))) * _ODD
        grams ^= grams >> np.uint64(32)
        least, at, width = grams, np.arange(n), 1
        while width < self.wide:
            step = min(width, self.wide - width)
            first = least[:-step] <= least[step:]
            least, at = np.where(first, least[:-step], least[step:]), np.where(first, at[:-step], at[step:])
            width += step
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        return starts.astype(np.int32), least[starts]


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _cut(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, key, text) with the number of words and, packed, the super-k-mers: ``starts`` as int32, ``keys`` as uint64."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = SuperKmers(window, gram)
        for frame in frames:
            n, starts, keys = [], [], []
            for text in frame["text"].to_pylist():
                words = _words(text)
                first, least = cut(words)
                n.append(len(words))
                starts.append(first.tobytes())
                keys.append(least.tobytes())
            packed = [pa.array(n, pa.int64()), pa.array(starts, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*frame.columns, *packed], ["row", "key", "text", "n_words", "starts", "keys"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("row", "key", "text").mapInArrow(batches, f"row long, key {kind}, text string, n_words long, starts binary, keys binary")


def _strings(rows: DataFrame, window: int, bits) -> DataFrame:
    """(row, start, n, bucket, a, b, packed) for each super-k-mer that may repeat; (a, b) is the digest of its string.

    ``packed`` is null where the task has sent the string twice.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: dict[bytes, int] = {}
        for frame in frames:
            out = []
            for row, text, n_words, starts, keys in zip(frame["row"], frame["text"], frame["n_words"], frame["starts"], frame["keys"]):
                starts, keys = np.frombuffer(starts, np.int32), np.frombuffer(keys, np.uint64)
                shared = np.flatnonzero(may_repeat(bits.value, keys)) if len(keys) else ()
                if not len(shared):
                    continue
                words, ends = _words(text), np.append(starts[1:], n_words - window + 1)
                for start, end, key in zip(starts[shared].tolist(), ends[shared].tolist(), keys[shared].view(np.int64).tolist()):
                    packed = b" ".join(words[start : end + window - 1])
                    digest = xxhash.xxh3_128_digest(packed)
                    times = sent.get(digest, 0)
                    if len(sent) > _REMEMBER:
                        sent.clear()
                    sent[digest] = times + 1
                    a, b = np.frombuffer(digest, np.int64).tolist()
                    out.append((row, start, end - start, key, a, b, packed if times < 2 else None))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    columns = ["row", "start", "n", "bucket", "a", "b", "packed"]
    chosen = rows.select("row", "text", "n_words", "starts", "keys")
    return chosen.mapInPandas(batches, "row long, start int, n int, bucket long, a long, b long, packed binary")


def _windows(packed: bytes, window: int) -> list[bytes]:
    words = packed.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends.tolist()]
    return [packed[begins[i] : begins[i + window] - 1] for i in range(len(words) - window + 1)]


def _sorted_counts(strings: DataFrame, window: int) -> DataFrame:
    """(a, b, mask) of the strings that hold repeated windows; each bucket is sorted in one task, one bucket after another."""

    def verdicts(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
        places = sorted((w, k, i) for k, (_, _, packed) in enumerate(rows) for i, w in enumerate(_windows(packed, window)))
        masks = [0] * len(rows)
        for _, same in groupby(places, lambda p: p[0]):
            same = list(same)
            if len(same) > 1:
                for _, k, i in same:
                    masks[k] |= 1 << i
        return list({(a, b): (a, b, m) for (a, b, _), m in zip(rows, masks) if m}.values())

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, rows, out = None, [], []
        for frame in frames:
            for key, a, b, packed in zip(frame["bucket"].tolist(), frame["a"].tolist(), frame["b"].tolist(), frame["packed"]):
                if key != bucket:
                    out += verdicts(rows) if len(rows) > 1 else []
                    bucket, rows = key, []
                    if len(out) > 20_000:
                        yield pd.DataFrame(out, columns=["a", "b", "mask"])
                        out = []
                rows.append((a, b, packed))
        out += verdicts(rows) if len(rows) > 1 else []
        yield pd.DataFrame(out, columns=["a", "b", "mask"])

    dealt = strings.select("bucket", "a", "b", "packed").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(batches, "a long, b long, mask long")


def _hashed_counts(strings: DataFrame, window: int) -> DataFrame:
    """As ``_sorted_counts``, for buckets of any size: windows are rows, known by their digests, and no bucket is gathered."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                out = []
                for a, b, packed in zip(part["a"].tolist(), part["b"].tolist(), part["packed"]):
                    for i, w in enumerate(_windows(packed, window)):
                        out.append((*np.frombuffer(xxhash.xxh3_128_digest(w), np.int64).tolist(), a, b, i))
                yield pd.DataFrame(out, columns=["wa", "wb", "a", "b", "i"])

    rows = materialized(strings.select("a", "b", "packed").mapInPandas(batches, "wa long, wb long, a long, b long, i int"))
    repeated = rows.groupBy("wa", "wb").count().where("count > 1").select("wa", "wb")
    hits = rows.join(repeated, ["wa", "wb"]).select("a", "b", "i")
    return hits.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def repeated_windows(rows: DataFrame, window: int, hot: int = HOT) -> tuple[DataFrame, object]:
    """(row, places ARRAY<STRUCT<start, mask>>): for each row with repeats, super-k-mers and the bits of their repeated windows.

    Also the broadcast sketch, by which rows without repeats can be told beforehand. ``rows`` come from ``_cut``, materialised.
    """
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(sketch(rows))
    strings = materialized(_strings(rows, window, bits))
    sent = strings.where("packed IS NOT NULL")
    large = materialized(sent.groupBy("bucket").count().where(F.col("count") > hot).select("bucket"))
    masks = _sorted_counts(sent.join(large, "bucket", "left_anti"), window)
    if not large.isEmpty():
        masks = masks.unionByName(_hashed_counts(sent.join(large, "bucket", "left_semi"), window))
    hits = strings.select("row", "start", "a", "b").join(masks, ["a", "b"]).select("row", F.struct("start", "mask").alias("place"))
    return hits.groupBy("row").agg(F.collect_list("place").alias("places")), bits


def covered(places: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Spans of words, end exclusive, that lie in a repeated window."""
    firsts = sorted(start + i for start, mask in places for i in range(mask.bit_length()) if mask >> i & 1)
    spans: list[tuple[int, int]] = []
    for at in firsts:
        if spans and at <= spans[-1][1]:
            spans[-1] = (spans[-1][0], at + window)
        else:
            spans.append((at, at + window))
    return spans


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = 8, hot: int = HOT) -> DataFrame:
    """(key, n_words, spans ARRAY<STRUCT<start, end>>, kept): each text without the words of windows that also start elsewhere.

    A window is ``window`` consecutive words, compared as they are. Every one of its places counts, in this text and in all others, and all
    places lose it, none is kept as the first. ``spans`` are the removed words, end exclusive, ``kept`` the others with one space between. Null and
    empty texts, and those of fewer words, have no window and keep all words. Rows are told apart by a number of their own, so
    repeated and null keys are fine; equal texts of enough words lose all. An empty table gives no rows, and other columns play no part.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = materialized(_cut(rows, window, gram))
    places, bits = repeated_windows(rows, window, hot)

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series([len(k) > 0 and bool(may_repeat(bits.value, np.frombuffer(k, np.uint64)).any()) for k in keys])

    kind = rows.schema["key"].dataType.simpleString()

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            spans, kept = [], []
            for text, found in zip(frame["text"].to_pylist(), frame["places"].to_pylist()):
                own = covered([(p["start"], p["mask"]) for p in found or ()], window)
                words, at, rest = _words(text), 0, []
                for start, end in own:
                    rest += words[at:start]
                    at = end
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(b" ".join(rest + words[at:]).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([frame["key"], frame["n_words"], pa.array(spans, kind), pa.array(kept, pa.string())], ["key", "n_words", "spans", "kept"])

    # texts that the sketch clears need not meet the places of others
    flagged = rows.select("row", "key", "text", "n_words", may("keys").alias("may"))
    clear = flagged.where("NOT may").select("key", "text", "n_words", F.lit(None).cast(places.schema["places"].dataType).alias("places"))
    others = flagged.where("may").drop("may").join(places, "row", "left").select("key", "text", "n_words", "places")
    schema = f"key {kind}, n_words long, spans array<struct<start:long,end:long>>, kept string"
    return clear.unionByName(others).mapInArrow(keep, schema).withColumnRenamed("key", key)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


_WORD = SPACES.replace("[", "[^", 1)
SQL_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT r, doc_id, w, len(w) AS n, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
v AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS m FROM p),
hit AS (SELECT r, i FROM v WHERE m IN (SELECT m FROM v GROUP BY m HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM hit),
lost AS (SELECT r, count(*) AS n, list(j ORDER BY j) AS js FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN lost.n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce((SELECT string_agg(w[j], ' ' ORDER BY j) FROM (SELECT unnest(range(1, len(w) + 1)) AS j) WHERE j NOT IN (SELECT unnest(js))), '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
"""
