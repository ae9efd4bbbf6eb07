"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each decision has its own context tree over the bytes before it. A node keeps how often its
decision went either way in training, its Krichevsky-Trofimov estimate, and its weighted probability, half its own estimate and half
the product of its children. The prediction mixes the estimates of all depths with the weights that this recursion leaves them.

Trained once, the model gives a byte a probability that depends on that byte and the ``depth`` bytes before it alone. So the
corpus is read as grams of ``depth + 1`` bytes: counts are summed by gram, nodes by depth, and each gram gets its code length.

Texts travel in chunks of some megabytes. A chunk asks only for the grams and words that it holds, in lists dealt over buckets by
their hash; the bucket sums each key's count over all chunks, and later answers the lists in the order of their keys. So no
table of all words or grams is ever broadcast or collected, and no task's share grows with how often a gram or word occurs.
"""

from __future__ import annotations

import ctypes
import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import bucketed, held_out, materialized, table

START, END = 0xFE, 0xFF  # bytes that UTF-8 never holds
WORD, GRAM = 0, 1
END_WORD = b""
_SLICE = 1 << 20
_UNIT = 2.0**32  # code lengths travel in this fraction of a nat


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def _release() -> None:
    """Give memory that a chunk or a bucket took back to the machine, of which the executor's JVM has the rest."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = _hash(word)
        return h


def _lower(text: str | None) -> bytes:
    """Bytes with A-Z in lower case, and no others changed."""
    return (text or "").encode("utf-8", "replace").lower()


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, size, blob): about ``chunk_bytes`` of consecutive texts with their ids and folds, compressed; ``size`` is their bytes."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def packed() -> pd.DataFrame:
            ids, folds, texts = zip(*rows, strict=True)
            whole = pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(folds, pa.bool_()), "text": pa.array(texts, pa.binary())})
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(whole)
            return pd.DataFrame({"chunk": [first + n], "size": [size], "blob": [sink.getvalue()]})

        for frame in frames:
            ids = frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None)
            for row in zip(ids, frame["held_out"], map(_lower, frame["text"]), strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= chunk_bytes:
                    yield packed()
                    n, rows, size = n + 1, [], 0
        if rows:
            yield packed()

    return docs.mapInPandas(batches, "chunk long, size long, blob binary")


def _opened(blob: bytes) -> tuple[list, np.ndarray, list[bytes]]:
    with pa.ipc.open_stream(blob) as f:
        whole = f.read_all()
    return whole["doc_id"].to_pylist(), whole["held_out"].to_numpy(), whole["text"].to_pylist()


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte to predict, ends of texts included, its gram as an integer; and how many each text has."""
    pad = bytes([START]) * depth
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    gram = np.zeros(len(data) - depth, np.int64)
    for k in range(depth, -1, -1):
        gram <<= 8
        gram |= data[depth - k : len(data) - k]
    predicted = np.ones(len(data), bool)
    predicted[((np.cumsum(sizes + depth) - (sizes + depth))[:, None] + np.arange(depth)).ravel()] = False
    return gram[predicted[depth:]], sizes


def _slices(texts: list[bytes]) -> Iterator[slice]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _SLICE:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _added(keys: np.ndarray, n: np.ndarray, more: np.ndarray, of_more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their counts, with those of another such list added."""
    at = np.searchsorted(keys, more)
    old = np.zeros(len(more), bool)
    inside = at < len(keys)
    old[inside] = keys[at[inside]] == more[inside]
    n[at[old]] += of_more[old]
    return np.insert(keys, at[~old], more[~old]), np.insert(n, at[~old], of_more[~old])


def _bucket(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """Grams that differ in their last two bytes alone share a bucket, so that neighbours stay close and pack well."""
    h = (keys.view(np.uint64) >> np.uint64(0 if kind == WORD else 16)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _dealt(keys: np.ndarray, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending keys, dealt: the order by bucket then key, the buckets that occur, and the start of each in that order."""
    bucket = _bucket(keys, kind, buckets)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return order, found, np.append(starts, len(keys))


def _pack(values: np.ndarray) -> bytes:
    """Integers, the bytes of equal weight side by side, compressed: the empty high bytes cost nothing."""
    return zstandard.compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending integers."""
    return _pack(np.diff(keys, prepend=np.int64(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob))


def _asked(chunks: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(slot, chunk, keys, counts): the distinct words and grams of a chunk, dealt over buckets, with their training counts there.

    The count is 0 where only held-out texts of the chunk have the key. ``slot`` is twice the bucket's number and the kind.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob in zip(frame["chunk"], frame["blob"], strict=True):
                _, folds, texts = _opened(blob)
                words: Counter[bytes] = Counter()
                other: set[bytes] = set()
                grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
                for held in (False, True):
                    mine = [t for t, f in zip(texts, folds, strict=True) if f == held]
                    for some in _slices(mine):
                        split = b" ".join(mine[some]).split()
                        other.update(split) if held else words.update(split)
                        keys, n = np.unique(_grams(mine[some], depth)[0], return_counts=True)
                        grams, counts = _added(grams, counts, keys, n * (not held))
                    if mine:
                        other.add(END_WORD) if held else words.update({END_WORD: len(mine)})
                del texts, mine
                words.update(dict.fromkeys(other - words.keys(), 0))
                keys = np.fromiter(map(_hash, words), np.int64, len(words))
                n = np.fromiter(words.values(), np.int64, len(words))
                del words, other
                _release()
                order = np.argsort(keys)
                for kind, keys, n in ((WORD, keys[order], n[order]), (GRAM, grams, counts)):
                    order, found, starts = _dealt(keys, kind, buckets)
                    keys, n = keys[order], n[order]
                    lists = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
                    yield pd.DataFrame(
                        {"slot": 2 * found + kind, "chunk": chunk, "keys": [_pack_keys(keys[a:b]) for a, b in lists], "counts": [_pack(n[a:b]) for a, b in lists]}
                    )
                del grams, counts, order, keys, n
                _release()

    return chunks.select("chunk", "blob").mapInPandas(batches, "slot int, chunk long, keys binary, counts binary")


def _summed(asked: DataFrame) -> DataFrame:
    """(slot, key, n): each distinct key with its count over all chunks.

    Lists wait until they hold as many keys as the sum so far, then all are sorted and added up at once: the work follows the keys, times the
    logarithm of their number, however many lists there are.
    """

    def of_slot(lists: pd.DataFrame) -> pd.DataFrame:
        waiting, held, least = [], 0, 1 << 16
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for k, (some, counts) in enumerate(zip(lists["keys"], lists["counts"], strict=True)):
            waiting.append((_unpack_keys(some), _unpack(counts)))
            held += len(waiting[-1][0])
            if held >= max(least, len(keys)) or k + 1 == len(lists):
                keys, n = (np.concatenate([own, *(w[j] for w in waiting)]) for j, own in enumerate((keys, n)))
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.empty(0, np.int64)
                keys, n = keys[starts], np.add.reduceat(n, starts) if len(starts) else n
                waiting, held = [], 0
        _release()
        return pd.DataFrame({"slot": lists["slot"].iloc[0], "key": keys, "n": n})

    return asked.groupBy("slot").applyInPandas(of_slot, "slot int, key long, n long")


def _answered(asked: DataFrame, values: DataFrame) -> DataFrame:
    """(chunk, slot, answers): for each list of keys the values (slot, key, value), integers, in its order."""

    def of_slot(lists: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        keys, value = known["key"].to_numpy(), known["value"].to_numpy()
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        found = [_pack(value[np.searchsorted(keys, _unpack_keys(x))]) for x in lists["keys"]]
        del keys, value, order
        _release()
        return pd.DataFrame({"chunk": lists["chunk"], "slot": lists["slot"], "answers": found})

    return asked.drop("counts").groupBy("slot").cogroup(values.groupBy("slot")).applyInPandas(of_slot, "chunk long, slot int, answers binary")


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones, by Stirling's series."""

    def log_gamma(x: np.ndarray) -> np.ndarray:
        y = x + 8
        shift = sum(np.log(x + k) for k in range(8))
        return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift

    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


_HALF = np.log(0.5)
_AT_ONCE = 1 << 16  # grams whose subtrees a task holds at a time, or those of one context of _CUT bytes
_CUT = 4  # contexts of so many bytes root the subtrees that a row holds whole; the levels above are tables


class _Level:
    """The nodes of one depth: ``at`` leads from each entry below (or each bit of a gram) to its node."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.names, self.at = np.unique(names, return_inverse=True)
        n = len(self.names)
        self.a, self.b = np.bincount(self.at, zeros, n), np.bincount(self.at, ones, n)
        self.kt = _log_kt(self.a, self.b)
        self.w = self.kt if below is None else np.logaddexp(self.kt, np.bincount(self.at, below, n)) + _HALF

    def mixed(self, p: np.ndarray | float, rest: np.ndarray | float, leaf: bool) -> tuple[np.ndarray, np.ndarray]:
        """Add this depth's share to the probability of a one, given that and the weight left by the depths above."""
        share = 1.0 if leaf else np.exp(self.kt + _HALF - self.w)
        return p + rest * share * (self.b + 0.5) / (self.a + self.b + 1.0), rest * (1.0 - share)


def _shorter(names: np.ndarray, depth: int) -> np.ndarray:
    """A node is named by its context above eight bits of path; cut the context to ``depth`` bytes."""
    return names & np.int64((1 << 8 * (depth + 1)) - 1)


def _levels(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[list[_Level], np.ndarray]:
    """Levels from ``depth`` down to the cut of the grams, and the bits: entry k * len(keys) + i is bit k of gram i."""
    byte, k = keys & 255, np.arange(8)[:, None]
    path, bit = (1 << k) | (byte[None, :] >> (8 - k)), (byte[None, :] >> (7 - k)) & 1
    names = ((keys >> 8)[None, :] << 8 | path).ravel()
    bit, counts = bit.ravel(), np.tile(n, 8)
    levels = [_Level(names, counts * (1 - bit), counts * bit, None)]
    for d in range(depth - 1, min(_CUT, depth) - 1, -1):
        last = levels[-1]
        levels.append(_Level(_shorter(last.names, d), last.a, last.b, last.w))
    return levels, bit


def _weighed(a: Column, b: Column, below: Column) -> Column:
    """(w, share): a node's weighted log probability, and the part of it that is the node's own estimate."""

    @F.pandas_udf("w double, share double")
    def weigh(zeros: pd.Series, ones: pd.Series, children: pd.Series) -> pd.DataFrame:
        kt = _log_kt(zeros.to_numpy(), ones.to_numpy())
        w = np.logaddexp(kt, children.to_numpy()) + _HALF
        return pd.DataFrame({"w": w, "share": np.exp(kt + _HALF - w)})

    return weigh(a, b, below)


def _context(name: Column, depth: int) -> Column:
    """A node's name, or a gram, with its context cut to ``depth`` bytes; the last byte stays."""
    return name.bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1))


def _subtrees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that together hold about ``_AT_ONCE`` grams, at least one row."""
    for frame in frames:
        before = np.cumsum(frame["keys"].map(len).to_numpy()) // _AT_ONCE
        for _, rows in frame.groupby(before, sort=False):
            yield rows


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(key, n), keys distinct, to (key, log_p): the log probability of a gram's last byte after the others, under the weighted trees.

    Grams that end in the same ``_CUT`` context bytes form one row, a subtree; it has at most 256 ** (depth - _CUT + 1) of them,
    however large the corpus. Nodes of fewer context bytes are rows of a table a level: summed upwards by the name of the
    parent, then joined downwards with the parent's mixture. Nothing is collected or broadcast by force.
    """
    cut = min(_CUT, depth)
    named = grams.select("key", "n", F.shiftright(_context(F.col("key"), cut - 1), 8).alias("upper"), F.shiftright(_context(F.col("key"), cut), 8).alias("root"))
    packed = named.repartition("upper").groupBy("upper", "root").agg(F.collect_list("key").alias("keys"), F.collect_list("n").alias("ns"))
    packed = materialized(packed.drop("root"))

    def up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _subtrees(frames):
            last = _levels(np.concatenate(rows["keys"].tolist()), np.concatenate(rows["ns"].tolist()), depth)[0][-1]
            names, at = np.unique(_shorter(last.names, cut - 1), return_inverse=True)
            yield pd.DataFrame({"name": names} | {k: np.bincount(at, v, len(names)) for k, v in (("a", last.a), ("b", last.b), ("below", last.w))})

    def level(sums: DataFrame, d: int) -> DataFrame:
        nodes = sums.groupBy(_context(F.col("name"), d).alias("name")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below"))
        nodes = nodes.withColumn("_w", _weighed(F.col("a"), F.col("b"), F.col("below")))
        return materialized(nodes.select("name", "a", "b", "_w.w", "_w.share"))

    levels = [level(packed.mapInPandas(up, "name long, a double, b double, below double"), cut - 1)]
    for d in range(cut - 2, -1, -1):
        levels.append(level(levels[-1].withColumnRenamed("w", "below"), d))
    p_one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    mixed = levels[-1].select("name", (F.col("share") * p_one).alias("q"), (1 - F.col("share")).alias("rest"))
    for d in range(1, cut):
        above = mixed.select(F.col("name").alias("parent"), F.col("q").alias("q0"), F.col("rest").alias("rest0"))
        own = levels[cut - 1 - d].withColumn("parent", _context(F.col("name"), d - 1)).join(above, "parent")
        mixed = own.select("name", (F.col("q0") + F.col("rest0") * F.col("share") * p_one).alias("q"), (F.col("rest0") * (1 - F.col("share"))).alias("rest"))
    tops = mixed.groupBy(F.shiftright("name", 8).alias("upper")).agg(F.collect_list(F.struct("name", "q", "rest")).alias("tops"))
    tops = materialized(tops.select("upper", "tops.name", "tops.q", "tops.rest"))

    def down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _subtrees(frames):
            keys = np.concatenate(rows["keys"].tolist())
            levels, bit = _levels(keys, np.concatenate(rows["ns"].tolist()), depth)
            known, first = np.unique(np.concatenate(rows["name"].tolist()), return_index=True)
            at = first[np.searchsorted(known, _shorter(levels[-1].names, cut - 1))]
            q, left = np.concatenate(rows["q"].tolist())[at], np.concatenate(rows["rest"].tolist())[at]
            for k in range(len(levels) - 1, -1, -1):
                q, left = levels[k].mixed(q, left, k == 0)
                q, left = q[levels[k].at], left[levels[k].at]
            log_p = np.log(np.where(bit == 1, q, 1.0 - q)).reshape(8, -1).sum(axis=0)
            yield pd.DataFrame({"key": keys, "log_p": log_p})

    return packed.join(tops, "upper").drop("upper").mapInPandas(down, "key long, log_p double")


def score(docs: DataFrame, depth: int = 6, chunk_bytes: int = 12 << 20) -> DataFrame:
    """Score the rows of ``docs`` (doc_id long, text string, held_out boolean), learning from those with ``held_out`` false.

    One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities),
    bits_per_byte. Contexts are of up to ``depth`` bytes, one to six, as a gram is packed into a long. A null text is empty: it has its end
    alone, and a probability for it. Repeated rows each count and are each scored. Without training rows every byte has the
    probability 1/256. Equal texts get equal scores. Other columns play no part. A task holds one chunk, or the lists of one bucket,
    of which there are two a chunk's worth of text; words are told apart by 64-bit hashes, and a gram's code length is rounded to 2 ** -32.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a context has one to six bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    chunks = bucketed(_chunks(rows, chunk_bytes), "chunk", max(8, 4 * rows.rdd.getNumPartitions()))
    buckets = max(1, -(-2 * (chunks.agg(F.sum("size")).first()[0] or 0) // chunk_bytes))
    slots = min(2 * buckets, int(rows.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    asked = bucketed(_asked(chunks, depth, buckets).repartition(slots, "slot"), "slot", slots)
    summed = materialized(_summed(asked))
    is_word = F.col("slot") % 2 == WORD
    words, grams = summed.where(is_word), summed.where(~is_word)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.count_if(F.col("n") > 0), F.lit(0))).first()
    train_tokens, vocabulary = int(size[0]), int(size[1])

    @F.pandas_udf("int")
    def gram_slot(keys: pd.Series) -> pd.Series:
        return pd.Series(2 * _bucket(keys.to_numpy(), GRAM, buckets) + GRAM)

    logs = gram_scores(grams.select("key", "n"), depth)
    values = words.select("slot", "key", F.col("n").alias("value")).unionByName(
        logs.select(gram_slot("key").alias("slot"), "key", F.round(F.col("log_p") * -_UNIT).cast("long").alias("value"))
    )
    answers = _answered(asked, values)
    whole = train_tokens + 0.1 * (vocabulary + 1)

    def of_chunk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("slot")
        given = [right.loc[right["slot"] % 2 == kind, "answers"] for kind in (WORD, GRAM)]
        hashes, out = _Hashes(), []

        def by_key(keys: np.ndarray, kind: int) -> np.ndarray:
            """The answers in the order of ``keys``, which ascend."""
            value = np.empty(len(keys), np.int64)
            value[_dealt(keys, kind, buckets)[0]] = np.concatenate([_unpack(x) for x in given[kind]])
            return value

        for blob in left["blob"]:
            ids, folds, texts = _opened(blob)
            split = [[hashes[w] for w in t.split()] for t in texts]
            of_end = hashes[END_WORD]
            n = np.fromiter(map(len, split), np.int64, len(split)) + 1
            last = np.cumsum(n) - 1
            keys = np.full(int(n.sum()), of_end, np.int64)
            inside = np.ones(len(keys), bool)
            inside[last] = False
            keys[inside] = np.fromiter((h for hs in split for h in hs), np.int64, int(n.sum()) - len(n))
            del split
            names, at = np.unique(keys, return_inverse=True)
            c = by_key(names, WORD)[at]
            known = np.add.reduceat((c > 0).astype(np.int64), last + 1 - n)
            base = np.add.reduceat(np.log10((c + 0.1) / whole), last + 1 - n)
            del keys, inside, at, c
            parts, keys, none = [], np.empty(0, np.int64), np.empty(0, np.int8)
            for some in _slices(texts):
                gram, size = _grams(texts[some], depth)
                names, at = np.unique(gram, return_inverse=True)
                parts.append((names, at.astype(np.int32), size))
                keys, none = _added(keys, none, names, np.zeros(len(names), np.int8))
            del texts, gram, at
            logs = by_key(keys, GRAM) / -_UNIT
            log_p = np.concatenate(
                [np.add.reduceat(logs[np.searchsorted(keys, names)][at], np.cumsum(size) - size) for names, at, size in parts]
            )
            size = np.concatenate([p[2] for p in parts])
            del parts, keys, none, logs, names
            _release()
            out.append(
                pd.DataFrame(
                    {"doc_id": pd.Series(ids, dtype="Int64"), "held_out": folds, "n_tokens": n, "n_known": known, "train_tokens": train_tokens, "base_score": base, "score": log_p / np.log(10.0), "bits_per_byte": -log_p / np.log(2.0) / size}
                )
            )
        return pd.concat(out, ignore_index=True)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return chunks.select("chunk", "blob").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(of_chunk, schema)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 10).alias("held_out")))
