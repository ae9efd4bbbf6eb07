"""Token ids of whole texts, a batch of rows at a time.

Byte-level tokenizers cut a text into pretokens, each encoded by itself. A text falls apart into pieces at spaces, and equal
pieces get equal ids, so each distinct piece is encoded once and texts become arrays of piece numbers. A cut before a space is
safe where a non-space stands on its left, or on its right; texts with other cuts are split by the first rule alone.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

_LEFT = re.compile(r"(?<=\S)(?= )")
_MARKS = frozenset(".,;:!?|")


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``flat[start : start + size]`` one after the other."""
    total = int(sizes.sum())
    shift = starts - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(total)]


class PieceEncoder:
    """Encodes texts; ``encode`` turns a list of distinct pretokens into their ids, flat, and the number of each.

    ``pattern`` yields the pretokens; ``spaced`` says that a space belongs to the pretoken after it, otherwise pieces are
    normalized first. At most about ``limit`` pieces are remembered between batches.
    """

    def __init__(
        self, pattern: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], spaced: bool, normalize: Callable[[str], str] | None = None, limit: int = 400_000
    ):
        self.split, self.encode, self.spaced, self.normalize, self.limit = regex.compile(pattern).findall, encode, spaced, normalize, limit
        self.clear()

    def clear(self) -> None:
        self.after: dict[str, int] = {}  # pieces that follow a space, without it
        self.first: dict[str, int] = {}  # pieces that follow none
        self.pretokens: dict[str, int] = {}
        self.ids, self.id_at, self.id_n = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.at, self.n, self.odd = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def _learn(self, pieces: set[str], known: dict[str, int], space: str) -> None:
        """Number the pieces that are new, and look up the ids of each."""
        new = list(pieces.difference(known))
        if not new:
            return
        parts, odd = [], []
        for k, piece in enumerate(new):
            if piece.isalpha() and (self.spaced or piece.isascii()):
                parts.append((space + piece if self.spaced else piece.lower(),))
            elif self.spaced:
                parts.append(self._matches(space + piece))
                if not piece or piece[0].isspace():
                    odd.append(k)
            else:
                parts.append(self._matches(self.normalize(piece)))
        sizes, flat = np.fromiter(map(len, parts), np.int64, len(parts)), list(chain.from_iterable(parts))
        fresh = list(set(flat).difference(self.pretokens))
        if fresh:
            self.pretokens.update(zip(fresh, range(len(self.pretokens), len(self.pretokens) + len(fresh)), strict=True))
            ids, lengths = self.encode(fresh)
            at = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids, self.id_at, self.id_n = np.concatenate((self.ids, ids)), np.concatenate((self.id_at, at)), np.concatenate((self.id_n, lengths))
        numbers = np.fromiter(map(self.pretokens.__getitem__, flat), np.int64, len(flat))
        ids = gather(self.ids, self.id_at[numbers], self.id_n[numbers])
        ends = np.concatenate(([0], np.cumsum(self.id_n[numbers])))[np.concatenate(([0], np.cumsum(sizes)))]
        known.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
        strange = np.zeros(len(new), bool)
        strange[odd] = True
        self.at, self.n = np.concatenate((self.at, len(self.flat) + ends[:-1])), np.concatenate((self.n, np.diff(ends)))
        self.flat, self.odd = np.concatenate((self.flat, ids)), np.concatenate((self.odd, strange))

    def _matches(self, piece: str) -> list[str] | tuple[str, ...]:
        """The matches of the pattern; letters before one mark need no regular expression."""
        if piece[-1:] in _MARKS and (piece[1:-1] if self.spaced and piece[0] == " " else piece[:-1]).isalpha():
            return piece[:-1], piece[-1]
        return self.split(piece)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, in order."""
        gc.disable()  # millions of short-lived lists and no cycles
        try:
            return self._batch(texts)
        finally:
            gc.enable()

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.n) > self.limit:
            self.clear()
        cut = [t.split(" ") for t in texts]
        self._learn(set(chain.from_iterable(cut)), self.after, " ")
        numbered = [np.fromiter(map(self.after.__getitem__, parts), np.int64, len(parts)) for parts in cut]
        if self.spaced:
            self._learn({parts[0] for parts in cut}, self.first, "")
            for x, parts in zip(numbered, cut, strict=True):
                x[0] = self.first[parts[0]]
            unsafe = {k: _LEFT.split(texts[k]) for k, x in enumerate(numbered) if self.odd[x[1:]].any()}
            self._learn(set(chain.from_iterable(unsafe.values())), self.first, "")
            for k, parts in unsafe.items():
                numbered[k] = np.fromiter(map(self.first.__getitem__, parts), np.int64, len(parts))
        return [gather(self.flat, self.at[x], self.n[x]) for x in numbered]


def blocks(texts: list[str], most_chars: int = 4 << 20):
    """Consecutive ranges of texts of about ``most_chars`` characters, at least one text each."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _byte_letters() -> tuple[list[str], list[int]]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [*map(chr, plain), *(chr(256 + k) for k in range(len(rest)))], plain + rest


def vocabulary(name: str) -> int:
    """How many ids a public tokenizer may give."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(public_tokenizers.path(name)).get_vocab(with_added_tokens=True).values()) + 1


_ENCODERS: dict[str, PieceEncoder] = {}


def library_encoder(name: str) -> PieceEncoder:
    """The encoder of a public tokenizer of the ``tokenizers`` library, kept by the worker process."""
    if name in _ENCODERS:
        return _ENCODERS[name]
    import json
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    spec = json.load(open(path))["pre_tokenizer"]
    spaced = spec["type"] == "ByteLevel"
    pattern = public_tokenizers.PATTERN if spaced else spec["pretokenizers"][0]["pattern"]["Regex"]

    model, shown = tokenizer.model, {b: c for c, b in zip(*_byte_letters(), strict=True)}

    def encode(pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, space = model.tokenize, shown[0x20]
        spelled = [(space + x[1:] if x[0] == " " else x) if x.isascii() and x[1:].isalpha() else x.encode().decode("latin-1").translate(shown) for x in pretokens]
        found = [[t.id for t in tokenize(x)] for x in spelled]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def normalize(piece: str) -> str:
        return piece.lower() if piece.isascii() else tokenizer.normalizer.normalize_str(piece)

    _ENCODERS[name] = PieceEncoder(pattern, encode, spaced, normalize)
    return _ENCODERS[name]
