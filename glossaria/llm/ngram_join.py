"""Near-duplicate join on word n-grams by a MinHash LSH forest.

1. Each text becomes the set of its five-word shingles. Texts with equal sets form a class, known by a 128-bit fingerprint.
2. Each class has one label in each tree of the forest: ``depth`` MinHash values of six bits. Labels sorted within a tree are its
   prefix trie: the longer prefix that a label shares with a neighbour is the deepest node in which its class meets another. Sorting
   goes a few values at a time over distinct prefixes, so it stays bounded where a third of all classes has one label.
3. Matched prefixes start at full depth. Classes that share a prefix are joined to the least of them, a star; all pairs of a
   component of stars are verified exactly, and the links found, by their true similarity, tell what share of all links meets
   at that depth. While it is below the target, the prefix is shortened by one value; then only pairs that the deeper nodes
   kept apart are verified.
4. Large components are dealt into blocks, and a task takes one pair of blocks; it returns one row for each class with the
   number of its links, never a row for each pair. Components of the verified links are the groups.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.llm.common import materialized, table
from glossaria.llm.components import components

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 6
_BINS = 20  # verified links are counted by similarity in so many steps between the threshold and 1


def meeting(similarity: np.ndarray | float, k: int, trees: int) -> np.ndarray | float:
    """The probability that two classes share ``k`` values in one of the trees."""
    return 1 - (1 - (similarity + (1 - similarity) / 2**_BITS) ** k) ** trees


def recall(bins: np.ndarray, threshold: float, k: int, trees: int) -> float:
    """The share of all links that meets at depth ``k``: a link found stands for 1 / p links, p being its probability of meeting."""
    lowest = threshold + (1 - threshold) * np.arange(len(bins)) / len(bins)
    return float(bins.sum() / (bins / meeting(lowest, k, trees)).sum()) if bins.sum() else 1.0


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Distinct hashes of the ``n``-word windows of a text, ascending; a text of fewer words is one window, one without words none."""

    def __init__(self, n: int, remember: int = 500_000):
        self.n, self.remember, self.words = n, remember, _WordHash()
        self.factors = [np.uint64(pow(0x100000001B3, 2 * k + 1, 2**64)) for k in range(n)]

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "replace").split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > self.remember:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out += h[k : len(h) - n + 1 + k] * self.factors[k]
        out = (out ^ (out >> np.uint64(29))) * _ODD
        return np.unique(out ^ (out >> np.uint64(32)))


class Forest:
    """One label for each tree: ``depth`` MinHash values, the first in the highest bits of a long."""

    def __init__(self, trees: int, depth: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factors = (rng.integers(0, 2**31, trees * depth, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.turns = rng.integers(0, 2**32, (trees * depth, 1), np.uint32)
        self.shifts = np.arange(depth - 1, -1, -1, dtype=np.int64) * _BITS

    def labels(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(16)).astype(np.uint32)[None, :]
        least = np.full(len(self.factors), 2**32 - 1, np.uint32)
        for at in range(0, x.shape[1], 512):
            y = x[:, at : at + 512] ^ self.turns
            y *= self.factors
            np.minimum(least, y.min(axis=1), out=least)
        mixed = ((least.astype(np.uint64) * _ODD) >> np.uint64(64 - _BITS)).astype(np.int64)
        return (mixed.reshape(self.trees, self.depth) << self.shifts).sum(axis=1)


def _sketch(rows: DataFrame, n: int, forest: Forest) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                s = shingler(text)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                rows.append((len(s), int(digest[0]), int(digest[1]), forest.labels(s) if len(s) else np.empty(0, np.int64)))
            out = frame[["row", "doc_id"]].copy()
            out["n_shingles"], out["f1"], out["f2"], out["labels"] = zip(*rows) if rows else ([], [], [], [])
            yield out

    return rows.mapInPandas(batches, "row long, doc_id long, n_shingles long, f1 long, f2 long, labels array<long>")


def tries(classes: DataFrame, depth: int, least_depth: int, step: int = 3) -> DataFrame:
    """(tree, label, node, meets): the leaves that meet another at ``least_depth`` or deeper, and how deep.

    The tries are sorted ``step`` values at a time, from the leaves up: distinct prefixes within the subtree that they share without those
    values, which holds at most ``64 ** step`` of them, so no window grows with the data however often a label occurs.
    """
    leaves = classes.select("node", F.posexplode("labels").alias("tree", "label"))
    counted = leaves.groupBy("tree", F.col("label").alias("prefix")).agg(F.when(F.count("*") > 1, depth).alias("meets"))
    nodes = found = materialized(counted)
    for high in range(depth, least_depth, -step):
        low = max(least_depth, high - step)
        ordered = Window.partitionBy("tree", F.shiftright("prefix", _BITS * (high - low))).orderBy("prefix")

        def shared(other: Column, high: int = high) -> Column:
            return high - F.ceil(F.length(F.bin(F.col("prefix").bitwiseXOR(other))) / _BITS)

        near = F.greatest(shared(F.lag("prefix").over(ordered)), shared(F.lead("prefix").over(ordered))).cast("int")
        near = nodes.select("tree", F.col("prefix").alias("node_prefix"), near.alias("near")).where("near is not null")
        up = found.withColumn("node_prefix", F.shiftright("prefix", _BITS * (depth - high))).join(near, ["tree", "node_prefix"], "left")
        found = materialized(up.select("tree", "prefix", F.coalesce("meets", "near").alias("meets")))
        nodes = nodes.select("tree", F.shiftright("prefix", _BITS * (high - low)).alias("prefix")).distinct()
    return leaves.join(found.where("meets is not null").withColumnRenamed("prefix", "label"), ["tree", "label"]).select("tree", "label", "node", "meets")


def stars(leaves: DataFrame, depth: int, k: int) -> DataFrame:
    """(hub, node): each class of a node of depth ``k`` with the least class there."""
    inside = leaves.where(F.col("meets") >= k).select("tree", F.shiftright("label", _BITS * (depth - k)).alias("prefix"), "node")
    hubs = inside.groupBy("tree", "prefix").agg(F.min("node").alias("hub"))
    return inside.join(hubs, ["tree", "prefix"]).where("hub < node").select("hub", "node").distinct()


def links_within(
    sets: list[np.ndarray], weights: np.ndarray, threshold: float, half: int | None, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set the weight of the others linked to it, and the first set of its component; and the links counted by similarity.

    With ``half``, only pairs of one of the first ``half`` sets and one of the others count; with ``known``, only pairs of
    sets that differ there.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    owner, column = owner[common], column[common]
    both = np.zeros((len(sets), len(sets)), np.float32 if sizes.max() < 1 << 24 else np.float64)
    if len(column):
        column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
        for at in range(0, int(column[-1]) + 1, 2048):
            a, b = np.searchsorted(column, (at, at + 2048))
            x = np.zeros((len(sets), 2048), both.dtype)
            x[owner[a:b], column[a:b] - at] = 1
            both += x @ x.T
    least = Fraction(str(threshold)).limit_denominator(1_000_000)  # counts are compared as integers, so equality is a link
    linked = both.astype(np.int64) * (least.numerator + least.denominator) >= least.numerator * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if half is not None:
        linked[:half, :half] = linked[half:, half:] = False
    if known is not None:
        linked &= known[:, None] != known[None, :]
    i, j = np.nonzero(np.triu(linked))
    similar = both[i, j] / (sizes[i] + sizes[j] - both[i, j])
    bins = np.bincount(np.clip((similar - threshold) / (1 - threshold) * _BINS, 0, _BINS - 1).astype(int) if threshold < 1 else np.zeros(len(i), int), minlength=_BINS)
    label = np.arange(len(sets))
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], len(sets)).min(axis=1))
        if (lower == label).all():
            return linked @ weights, label, bins
        label = lower


def _verify(dealt: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links, hub) for each class with links in a pair of blocks, and (null, n, null, bin) for the links by similarity.

    ``dealt`` has component, pair, second, node, known, copies and shingles, the rows of a (component, pair) next to each other.
    """

    def flush(group: list[tuple]) -> Iterator[tuple]:
        group = sorted(group, key=lambda r: (r[2], r[3]))
        sets = [np.frombuffer(r[6], np.uint64) for r in group]
        n = sum(not r[2] for r in group)
        weights, label, bins = links_within(
            sets, np.array([r[5] for r in group], np.int64), threshold, n if n < len(group) else None, np.array([r[4] for r in group], np.int64)
        )
        for r, w, first in zip(group, weights.tolist(), label.tolist(), strict=True):
            if w:
                yield r[3], w, group[first][3], None
        yield from ((None, n, None, k) for k, n in enumerate(bins.tolist()) if n)

    def framed(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({k: pd.Series([r[i] for r in out], dtype="Int64") for i, k in enumerate(("node", "n_links", "hub", "bin"))})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream():
            for frame in frames:
                yield from frame.itertuples(index=False, name=None)

        out = []
        for _, group in groupby(stream(), key=lambda r: r[:2]):
            out += flush(list(group))
            if len(out) > 10_000:
                yield framed(out)
                out = []
        yield framed(out)

    return dealt.mapInPandas(batches, "node long, n_links long, hub long, bin int")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(component, node, known, family, part) of the components that join several known ones.

    A known component of ``block`` classes or more is a family with parts of its own, for its pairs among itself are verified; smaller
    ones are mixed in family -1, each whole in one part.
    """
    sizes = members.groupBy("component", "known").agg(F.count("*").alias("n"))
    mixed = F.coalesce(F.sum(F.when(F.col("n") < block, F.col("n"))), F.lit(0))
    wholes = sizes.groupBy("component").agg(mixed.alias("n_mixed"), F.count("*").alias("n_known")).where("n_known > 1")
    large = F.col("n") >= block
    placed = members.join(sizes.join(wholes, "component"), ["component", "known"])
    hashed = F.when(large, F.xxhash64("node")).otherwise(F.xxhash64("known"))
    parts = F.ceil(F.when(large, F.col("n")).otherwise(F.col("n_mixed")) / block)
    return placed.select("component", "node", "known", F.when(large, F.col("known")).otherwise(-1).alias("family"), F.pmod(hashed, parts).alias("part"))


def _dealt(members: DataFrame, shingled: DataFrame, block: int) -> DataFrame:
    """The classes of each pair of blocks that may hold links not known yet, next to each other."""
    placed = materialized(_blocks(members, block).select("component", "node", "known", F.struct("family", "part").alias("block")))
    blocks = placed.select("component", "block").distinct()
    other = blocks.withColumnRenamed("block", "other")
    fresh = (F.col("block") <= F.col("other")) & ((F.col("block.family") != F.col("other.family")) | (F.col("block.family") == -1))
    pairs = blocks.join(other, "component").where(fresh).withColumn("pair", F.struct("block", "other"))
    sides = pairs.select("component", "pair", "block", F.lit(False).alias("second")).unionByName(
        pairs.where("block <> other").select("component", "pair", F.col("other").alias("block"), F.lit(True).alias("second"))
    )
    rows = placed.join(shingled, "node").join(sides, ["component", "block"])
    rows = rows.select("component", F.xxhash64("pair").alias("pair"), "second", "node", "known", "copies", "shingles")
    return rows.repartition("component", "pair").sortWithinPartitions("component", "pair")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    depth: int = 10,
    least_depth: int = 4,
    target: float = 0.999,
    block: int = 256,
    unique: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, class_id, copy_of, n_links, kept, group_key).

    Words are split at ASCII white space and compared in lower case. ``copy_of`` is the least id with the same set of shingles,
    ``class_id`` the least id reachable by links of Jaccard similarity ``threshold`` or more, ``n_links`` the number of other
    documents linked directly, copies included, and ``kept`` says that the row has its group's least id. Null texts and texts
    without words link with nothing. Rows with a null key link with nothing and have null ids and ``kept`` true. Rows that repeat
    a key are documents of their own: classes are told apart by text alone, and ``group_key`` tells apart groups whose
    least ids agree. Other columns play no part; an empty table gives no rows. With ``unique`` the caller vouches for keys that
    are not null, occur once and stay the same when ``docs`` is read again; otherwise rows are copied with a number of their own.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.col("doc_id")) if unique else materialized(rows.withColumn("row", F.monotonically_increasing_id()))
    sketches = materialized(_sketch(rows, n, Forest(trees, depth)))
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("f1", "f2").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.min("row").alias("row"), F.first("labels").alias("labels")
    )
    classes = materialized(classes.withColumn("node", F.monotonically_increasing_id()))
    leaves = materialized(tries(classes, depth, least_depth))

    known, found, shingled, reach, bins = None, None, None, depth + 1, np.zeros(_BINS)
    for k in range(depth, least_depth - 1, -1):
        if k < reach:  # texts are fetched for the classes that meet at this depth or the two above it
            deepest, reach = leaves.groupBy("node").agg(F.max("meets").alias("meets")), max(least_depth, k - 2)
            fresh = deepest.where((F.col("meets") >= reach) & (F.col("meets") < k + 1 if shingled is not None else F.lit(True))).select("node")
            more = materialized(_shingled(rows.join(fresh.join(classes.select("node", "row", "copies"), "node"), "row"), n))
            shingled = more if shingled is None else shingled.unionByName(more)
        members = components(stars(leaves, depth, k))
        joined = members.withColumn("known", F.col("node")) if known is None else members.join(known, "node", "left").withColumn("known", F.coalesce("known", "node"))
        more = materialized(_verify(_dealt(joined, shingled, block), threshold))
        for r in more.where("bin is not null").groupBy("bin").agg(F.sum("n_links").alias("n")).collect():
            bins[r["bin"]] += r["n"]
        found = more if found is None else found.unionByName(more)
        met = recall(bins, threshold, k, trees) if bins.sum() else meeting(threshold, k, trees)  # without a link found, that of the hardest to meet
        if met >= target:
            break
        known = members.withColumnRenamed("component", "known")
    else:
        warnings.warn(f"prefixes of {least_depth} values meet {met:.4f} of the links, not {target}", stacklevel=2)

    found = found.where("node is not null")
    groups = components(found.select("hub", "node"))
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = classes.select("f1", "f2", "node", "copies", "least_id").join(links, "node", "left").join(groups, "node", "left")
    known = materialized(known.withColumn("group_key", F.coalesce("component", "node")).drop("component"))
    least = known.groupBy("group_key").agg(F.min("least_id").alias("class_id"))
    known = known.join(least, "group_key").select("f1", "f2", "group_key", "class_id", "least_id", "copies", "n_links")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("f1"))
    out = sketches.select("doc_id", own.alias("f1"), "f2").join(known, ["f1", "f2"], "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("least_id", "doc_id").alias("copy_of"),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        "group_key",
    )


def _shingled(texts: DataFrame, n: int) -> DataFrame:
    """(node, copies, shingles) of the representatives."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for frame in frames:
            yield frame[["node", "copies"]].assign(shingles=[shingler(t).tobytes() for t in frame["text"]])

    return texts.select("node", "copies", "text").mapInPandas(batches, "node long, copies long, shingles binary")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
