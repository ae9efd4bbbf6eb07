"""Runs of repeated words by string synchronising sets.

At each scale t = 1, 2, 4, ... a position is selected if the hash of its t-word gram is the least of some t consecutive grams. That
depends on the words nearby alone, so within a run of period q both ends of a step q are selected together. Selected positions whose next
2 t words are equal form pairs; a pair q apart, t <= q < 2 t, proposes the period q, and comparing words settles where it holds.

Every run of at least four periods is found: the grams of its first q + t positions all recur q later inside it, so does one selected
position with its context of 2 t words, and no nearer place has that context, else the run had a smaller period (Fine and Wilf).
Grams that themselves have a period of at most t / 4 lie in runs that smaller scales have found. They are the highly periodic regions: no
position is selected there, and what they omit are the runs known already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import SPACES, let, table

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)
_CHUNK = 400_000  # words that are searched together; a longer text is searched alone


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` over every ``width`` consecutive values, a power of two."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def selected(grams: np.ndarray, t: int) -> np.ndarray:
    """Positions whose gram is the least of some ``t`` consecutive ones; grams equal to ``_NONE`` are never selected."""
    least = _sliding(np.minimum, grams, t)
    reach = np.concatenate([np.zeros(t - 1, np.uint64), least, np.zeros(t - 1, np.uint64)])
    return np.flatnonzero((_sliding(np.maximum, reach, t) == grams) & (grams != _NONE))


def _pairs(at: np.ndarray, contexts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of neighbouring positions with one context that lie t to 2 t - 1 apart."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = at[order], contexts[order]
    apart = np.diff(places)
    good = (contexts[1:] == contexts[:-1]) & (apart >= t) & (apart < 2 * t)
    return places[:-1][good], apart[good]


def _matching(words: np.ndarray, at: int, period: int, way: int) -> int:
    """How many positions from ``at`` on, going ``way`` (1 or -1), equal the word ``period`` later."""
    n, step = 0, 64
    while True:
        a, b = (at + n, at + n + step) if way > 0 else (at - n - step + 1, at - n + 1)
        a, b = max(a, 0), min(b, len(words) - period)
        if b <= a:
            return n
        differ = np.flatnonzero(words[a:b] != words[a + period : b + period])
        if len(differ):
            return n + int(differ[0] if way > 0 else b - a - 1 - differ[-1])
        n, step = n + b - a, step * 2


def runs(words: np.ndarray, ends: np.ndarray, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least four periods and ``least`` words, 6 or more.

    ``words`` are ids, those of several texts one after another, each text closed by an id that occurs nowhere else at a position of
    ``ends``; no run reaches over one.
    """
    found: dict[tuple[int, int], int] = {}
    sizes = np.diff(ends, prepend=-1) - 1
    owner = np.repeat(np.arange(len(ends)), sizes + 1)
    place, x, t = np.arange(len(words)), _mixed(words.astype(np.uint64)), 1
    while len(x) >= 4 * t:
        # x: hashes of t words from each place on; whatever reaches over the end of a text holds an id of its own and equals nothing else
        contexts = _mixed(x[:-t] * _ODD + x[t:])
        grams = np.minimum(x, _NONE - np.uint64(1))
        if t >= least:
            grams[_within(found, t, len(words))[place]] = _NONE
        at = selected(grams, t)
        at = at[at < len(contexts)]
        starts, periods = _pairs(at, contexts[at], t)
        reached: dict[int, int] = {}
        for i, q in sorted(zip(place[starts].tolist(), periods.tolist())):
            if i < reached.get(q, 0):
                continue
            left, right = _matching(words, i, q, -1), _matching(words, i, q, 1)
            reached[q] = i + right
            start, length = i - left + 1, left - 1 + right + q
            if length >= max(least, 4 * q):
                found.setdefault((start, length), q)  # the smaller period comes first
        t *= 2
        stay = (sizes >= 4 * t)[owner[place[: len(contexts)]]]
        x, place = contexts[stay], place[: len(contexts)][stay]
    return sorted((s, n, q) for (s, n), q in found.items())


def _within(found: dict[tuple[int, int], int], t: int, n: int) -> np.ndarray:
    """Where ``t`` words with a period of at most t / 4 begin."""
    steps = np.zeros(n + 1, np.int64)
    for (start, length), q in found.items():
        if 4 * q <= t <= length:
            steps[start] += 1
            steps[start + length - t + 1] -= 1
    return np.cumsum(steps)[:n] > 0


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that some run holds after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, period in found:
        drop[start + period : start + length] = True
    return [w for w, d in zip(words, drop) if not d]


def _searched(texts: list[str | None]) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """The words and runs of each text; texts are searched together, up to ``_CHUNK`` words at once."""
    waiting: list[list[str]] = []
    held = 0
    for k, text in enumerate(texts):
        waiting.append([w.decode() for w in text.encode().split()] if text else [])
        held += len(waiting[-1])
        if held < _CHUNK and k + 1 < len(texts):
            continue
        ids: dict[str, int] = {}
        ends = np.cumsum([len(w) + 1 for w in waiting]) - 1
        joined = np.empty(ends[-1] + 1, np.int64)
        begin = 0
        for words, end in zip(waiting, ends.tolist()):
            joined[begin:end] = [ids.setdefault(w, len(ids)) for w in words]
            begin = end + 1
        joined[ends] = len(ids) + np.arange(len(ends))
        owned: list[list[tuple[int, int, int]]] = [[] for _ in waiting]
        for start, length, period in runs(joined, ends):
            j = int(np.searchsorted(ends, start))
            owned[j].append((start - (int(ends[j - 1]) + 1 if j else 0), length, period))
        yield from zip(waiting, owned)
        waiting, held = [], 0


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs ARRAY<STRUCT<start, length, period>>, collapsed) for each row.

    Words are what stands between blanks. ``runs`` holds all maximal runs of four periods and six words or more, by start, then period;
    ``collapsed`` is the text without the repeats, one space between words. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Rows are looked at one by one, so repeated and null keys are kept as they are, an empty table gives none,
    and other columns, whatever their names, play no part. A text of any length is searched whole, in memory of about 100 bytes a word.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in frames:
            for at in range(0, whole.num_rows, 2000):
                frame, n, found, rest = whole.slice(at, 2000), [], [], []
                for words, own in _searched(frame["text"].to_pylist()):
                    n.append(len(words))
                    found.append([{"start": s, "length": k, "period": q} for s, k, q in own])
                    rest.append(" ".join(collapsed(words, own)))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([frame["key"], pa.array(n, pa.int64()), pa.array(found, kind), pa.array(rest, pa.string())], ["key", "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(search, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("key", key)


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose tail is made periodic where crc32 of the id ends in 0; other texts, and those of a null id, stay."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(words, (a + (i - a) % p + 1).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")

    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(text))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    found = found.withColumn("_longest", longest)
    length, period = -F.col("_longest.less"), F.col("_longest.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_longest.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
