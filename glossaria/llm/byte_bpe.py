"""Byte-level BPE by corpus-level merge replay.

The distinct pretokens of a block of rows form one array of symbols. An inverted index leads from the rank of a pair of neighbours
to all positions where it stands; ranks are taken in ascending order, each merge is applied at all its positions at once, and
only the pairs that the merge touches are looked up again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from glossaria.llm.common import table
from glossaria.llm.tokens import PieceEncoder, blocks, gather

_NONE = np.int32(2**31 - 1)


class MergeTable:
    """Ranks of byte strings, a rank being the id too, as in ``.tiktoken`` files."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.token[rank] = token
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.rank = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], _NONE)
        self.pairs = pairs
        self.bytes_n = np.array([len(t) for t in self.token], np.int64)
        self.bytes_at = np.cumsum(self.bytes_n) - self.bytes_n
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.bytes_at[ids], self.bytes_n[ids]).tobytes()

    def one(self, word: bytes) -> list[int]:
        """A single word, merge by merge; for the rare words in which a merge makes a pair of lower rank than its own."""
        ids, n = [int(self.byte_id[b]) for b in word], len(word)
        after, before, none = [*range(1, n), -1], list(range(-1, n - 1)), int(_NONE)

        def rank_at(k: int) -> int:
            return self.pairs.get(ids[k] << 32 | ids[after[k]], none) if k >= 0 and after[k] >= 0 else none

        waiting = [(r, k) for k in range(n) if (r := rank_at(k)) != none]
        heapify(waiting)
        while waiting:
            r, k = heappop(waiting)
            if ids[k] < 0 or rank_at(k) != r:  # merged or changed since
                continue
            right = after[k]
            ids[k], ids[right], after[k] = r, -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for p in (before[k], k):
                if (found := rank_at(p)) != none:
                    heappush(waiting, (found, p))
        return [x for x in ids if x >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = len(data)
        token, word = self.byte_id[data], np.repeat(np.arange(len(words)), size)
        after = np.arange(1, n + 1)
        after[np.cumsum(size)[size > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(np.cumsum(size) - size)[size > 0]] = -1
        alive, rank = np.ones(n, bool), np.full(n, _NONE, np.int32)
        inside = np.flatnonzero(after >= 0)
        rank[inside] = self.pair_rank(token[inside], token[inside + 1])
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(at: np.ndarray) -> None:
            found = rank[at]
            at, found = at[found != _NONE], found[found != _NONE]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, positions in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heappush(ranks, r)

        add(inside)
        odd: list[np.ndarray] = []
        while ranks:
            r = heappop(ranks)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = after[at]
            if (rank[right] == r).any():  # overlapping pairs: the leftmost goes first
                keep, used = [], -1
                for k, (p, q) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                    if p != used:
                        keep.append(k)
                        used = q
                at, right = at[keep], right[keep]
            following = after[right]
            if len(at) > 1 and (touching := following[:-1] == at[1:]).any():  # between two such merges stands a pair that is gone after both
                passing = self.pair_rank(np.full(int(touching.sum()), r), token[following[:-1][touching]])
                if (passing < r).any():
                    odd.append(word[at[:-1][touching][passing < r]])
            token[at], alive[right], rank[right] = r, False, _NONE
            after[at] = following
            before[following[following >= 0]] = at[following >= 0]
            left = before[at]
            rank[at[following < 0]] = _NONE
            touched = np.unique(np.concatenate((at[following >= 0], left[left >= 0])))
            rank[touched] = self.pair_rank(token[touched], token[after[touched]])
            if (rank[touched] < r).any():
                odd.append(word[touched[rank[touched] < r]])
            add(touched)
        flat, count = token[alive], np.bincount(word[alive], minlength=len(words))
        whole = [k for k, w in enumerate(words) if count[k] > 1 and w in self.ranks]
        again = {k: [self.ranks[words[k]]] for k in whole} | {int(k): self.one(words[k]) for o in odd for k in set(o.tolist()) - set(whole)}
        if again:
            parts = np.split(flat, np.cumsum(count)[:-1])
            for k, ids in again.items():
                parts[k], count[k] = np.array(ids, np.int32), len(ids)
            flat = np.concatenate(parts)
        return flat.astype(np.int32), count.astype(np.int64)


_LOADED: dict[tuple[str, str], tuple[MergeTable, PieceEncoder]] = {}


def _loaded(path: str, pattern: str) -> tuple[MergeTable, PieceEncoder]:
    if (path, pattern) not in _LOADED:
        merges = MergeTable.load(path)
        _LOADED[path, pattern] = merges, PieceEncoder(pattern, lambda words: merges.replay([w.encode() for w in words]), True)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, an array of token ids, to every row; a null or empty text has none. Other columns pass through."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, encoder = _loaded(path, pattern)
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            for a, b in blocks(texts):
                yield frame.iloc[a:b].assign(**{ids: encoder.batch(texts[a:b])})

    kept = docs.drop(ids)
    return kept.mapInPandas(batches, StructType([*kept.schema.fields, StructField(ids, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add ``data``, the bytes that the ids stand for; null ids give no bytes."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges, _ = _loaded(path, pattern)
        for frame in frames:
            yield frame.assign(**{data: [merges.decode(np.asarray(x, np.int64)) if x is not None else b"" for x in frame[ids]]})

    kept = docs.drop(data)
    return kept.mapInPandas(batches, StructType([*kept.schema.fields, StructField(data, BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass and keep only the number of tokens and two digests, so ids never leave the task."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges, encoder = _loaded(path, pattern)
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            for a, b in blocks(texts):
                rows = []
                for ids in encoder.batch(texts[a:b]):
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(merges.decode(ids)).hexdigest()))
                out = frame.iloc[a:b].drop(columns=[text])
                out["n_tokens"], out["ids_sha256"], out["decoded_sha256"] = zip(*rows, strict=True)
                yield out

    kept = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    schema = kept.drop(text).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return kept.mapInPandas(batches, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
