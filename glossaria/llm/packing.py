"""Vector bin packing of token sequences.

Every sequence obeys three limits at once: tokens, segments (pieces of documents) and loss-bearing tokens. A task keeps a bounded
pool of pieces; for the open sequence it takes the piece that fits and has the largest dot product of its demand with what is left,
each dimension as a share of its limit. When nothing fits whole, a piece is cut to fill the gap. What remains at the end of a
task is dealt into sequences whose lengths are powers of two, which need no padding.

Tasks pack what they read, so nothing is shuffled and no task holds more than its pool.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from glossaria.llm.common import table
from glossaria.llm.tokens import blocks, library_encoder, vocabulary


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096
    pool: int = 1024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens, self.pool) < 1:
            raise ValueError("every limit is at least 1")


@dataclass
class _Piece:
    row: int
    ids: np.ndarray
    loss: np.ndarray | None
    start: int
    doc_tokens: int

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        a = _Piece(self.row, self.ids[:n], None if self.loss is None else self.loss[:n], self.start, self.doc_tokens)
        return a, _Piece(self.row, self.ids[n:], None if self.loss is None else self.loss[n:], self.start + n, self.doc_tokens)

    def loss_tokens(self) -> int:
        return len(self.ids) if self.loss is None else int(np.count_nonzero(self.loss))

    def __len__(self) -> int:
        return len(self.ids)


class Packer:
    """Feed documents with ``add``; each call and ``finish`` yield placed pieces as (piece, sequence number, offset)."""

    def __init__(self, limits: Limits):
        self.limits, self.next, self.pool = limits, 0, []
        self.tokens, self.loss = np.zeros(limits.pool * 2 + 2), np.zeros(limits.pool * 2 + 2)

    def _put(self, piece: _Piece) -> None:
        k = len(self.pool)
        if k == len(self.tokens):
            self.tokens, self.loss = np.concatenate((self.tokens, self.tokens)), np.concatenate((self.loss, self.loss))
        self.pool.append(piece)
        self.tokens[k], self.loss[k] = len(piece.ids), piece.loss_tokens()

    def _take(self, k: int) -> _Piece:
        piece, last = self.pool[k], len(self.pool) - 1
        self.pool[k], self.tokens[k], self.loss[k] = self.pool[last], self.tokens[last], self.loss[last]
        self.pool.pop()
        return piece

    def _most(self, piece: _Piece, tokens: int, loss: int) -> int:
        """The longest start of a piece within both limits."""
        n = min(tokens, len(piece.ids))
        if piece.loss is None:
            return min(n, loss)
        return n if loss >= np.count_nonzero(piece.loss[:n]) else int(np.searchsorted(np.cumsum(piece.loss[:n] != 0), loss, side="right"))

    def add(self, row: int, ids: np.ndarray, loss: np.ndarray | None = None):
        x = self.limits
        piece = _Piece(row, ids, loss, 0, len(ids))
        while len(piece.ids) >= x.tokens and (n := self._most(piece, x.tokens, x.loss_tokens)) == x.tokens:
            head, piece = piece.cut(n)
            yield head, self.next, 0
            self.next += 1
        while len(piece.ids) > x.tokens or piece.loss_tokens() > x.loss_tokens:
            head, piece = piece.cut(max(1, self._most(piece, x.tokens, x.loss_tokens)))
            self._put(head)
        if len(piece.ids):
            self._put(piece)
        while len(self.pool) >= x.pool:
            yield from self._fill(x.tokens)

    def _fill(self, size: int):
        """Close one sequence of at most ``size`` tokens."""
        x, tokens, segments, loss, offset = self.limits, size, self.limits.segments, self.limits.loss_tokens, 0
        while self.pool and tokens and segments:
            t, m = self.tokens[: len(self.pool)], self.loss[: len(self.pool)]
            fits = (t <= tokens) & (m <= loss)
            if segments > 1 and fits.any():
                score = t * (tokens / x.tokens**2) + m * (loss / x.loss_tokens**2) + segments / x.segments**2
                k = int(np.argmax(np.where(fits, score, -1.0)))
                piece = self._take(k)
            else:
                k = int(np.argmax(t))
                n = self._most(self.pool[k], tokens, loss)
                if n <= 0:
                    break
                piece = self._take(k)
                if n < len(piece.ids):
                    piece, rest = piece.cut(n)
                    self._put(rest)
            yield piece, self.next, offset
            offset, tokens, segments, loss = offset + len(piece.ids), tokens - len(piece.ids), segments - 1, loss - piece.loss_tokens()
        self.next += 1

    def finish(self):
        while left := int(self.tokens[: len(self.pool)].sum()):
            yield from self._fill(self.limits.tokens if left >= self.limits.tokens else 1 << (left.bit_length() - 1))


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_BEARS: dict[str, np.ndarray] = {}


def bears_loss(tokenizer: str, end_id: int) -> np.ndarray:
    """For each id whether it is a target: those with a letter or digit are, while marks, spaces and the end are context alone."""
    if tokenizer not in _BEARS:
        import public_tokenizers
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        out = np.zeros(vocabulary(tokenizer), bool)
        for token, k in whole.get_vocab(with_added_tokens=True).items():
            out[k] = any(c.isalnum() for c in token)
        _BEARS[tokenizer] = out
    out = _BEARS[tokenizer].copy()
    out[end_id] = False
    return out


def pack_texts(
    docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", context_tokens: str | None = None
) -> DataFrame:
    """One row for each placed piece of a document: ``key`` and the columns of ``SCHEMA``.

    Ids that ``bears_loss`` names are targets; of these, the first ``context_tokens`` of a document, if a column of that name is given, are
    not, as in instruction data the prompt's are not. A null there is none.
    A null or empty text is its end token alone. Null, equal and repeated keys are packed row by row; other columns are
    dropped, so none can clash. An empty table gives no rows.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer, bears = library_encoder(tokenizer), Packer(limits), bears_loss(tokenizer, end_id)
        first = TaskContext.get().partitionId() << 36
        keys: dict[int, object] = {}
        out: list[tuple] = []
        n = 0

        def note(placed) -> None:
            for piece, sequence, offset in placed:
                crc = zlib.crc32(piece.ids.astype("<u4").tobytes())
                out.append((keys[piece.row], piece.start, len(piece.ids), crc, piece.doc_tokens, first + sequence, offset, piece.loss_tokens()))

        def frame() -> pd.DataFrame:
            names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]
            made = pd.DataFrame(out, columns=names)
            made[key] = pd.Series([r[0] for r in out], dtype=object)
            out.clear()
            return made

        for rows in frames:
            texts, ks = rows[text].fillna("").tolist(), rows[key].astype(object).where(rows[key].notna(), None).tolist()
            given = rows[context_tokens].fillna(0).astype(int).tolist() if context_tokens else [0] * len(ks)
            for a, b in blocks(texts):
                for k, context, ids in zip(ks[a:b], given[a:b], encoder.batch(texts[a:b]), strict=True):
                    keys[n] = k
                    ids = np.append(ids, np.int32(end_id))
                    loss = bears[ids]
                    loss[: max(0, context)] = False
                    note(packer.add(n, ids, loss))
                    n += 1
            waiting = {p.row for p in packer.pool}
            keys = {k: v for k, v in keys.items() if k in waiting}
            yield frame()
        note(packer.finish())
        yield frame()

    kept = docs.select(key, text, *([context_tokens] if context_tokens else []))
    schema = kept.select(key).schema
    for column in SCHEMA.split(", "):
        schema = schema.add(*column.split())
    return kept.mapInPandas(batches, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2)
