"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a structured random product code: after a random rotation the coordinates fall into blocks, each block has
a small random spherical code, and a filter is one codeword from each block. A vector is decoded to the list of all filters whose
cap holds it, by branch and bound over the blocks, never by a scan of all filters. Vectors of one label that share a filter
are candidates; the cosine of each candidate pair is then computed in double precision.

The number of filters follows the number of vectors of the largest label, so chance pairs a vector stay as many however large
the table; the number of independent codes is what the target recall needs, measured on made pairs at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import materialized, table
from glossaria.llm.components import components


class CapFilters:
    """``code ** blocks`` filters in ``dim`` dimensions; a cap holds a unit vector whose inner product with the direction is ``least`` or
    more, and ``least`` is set so that a random vector lies in ``each`` caps on average, in any dimension.

    In 64 dimensions, a code of 64 ** 3 filters with its own rotation misses a pair of cosine 0.93 with probability 0.46, one of 0.98 with
    0.02; codes miss independently.
    """

    def __init__(self, dim: int, blocks: int = 3, code: int = 64, each: float = 13.5, seed: int = 5, least: float | None = None):
        rng = np.random.default_rng([seed, dim])
        if dim <= 12:  # too few coordinates to share out: one plain code
            blocks, code = 1, code**2
        self.blocks = blocks
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((code, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.blocks))
        self.code, self.least = code, -np.inf
        self.least = 0.93
        if least is not None:
            self.least = least
            return
        x, step = rng.standard_normal((400, dim)), 0.02
        while self.least > -1 and (found := sum(map(len, self.decode(x)))) < each * len(x) or step > 1e-4:
            if found >= each * len(x):
                self.least, step = self.least + step, step / 4
            self.least -= step

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each row (not zero) the numbers of all filters that hold it."""
        x = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.rotation
        parts = [x[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]
        best = np.stack([p.max(axis=1) for p in parts])
        rest = np.concatenate((np.cumsum(best[::-1], axis=0)[::-1][1:], np.zeros((1, len(x)))))
        out = []
        for i in range(len(x)):
            names, sums = np.zeros(1, np.int64), np.zeros(1)
            for k, p in enumerate(parts):
                grown = sums[:, None] + p[i][None, :]
                keep = grown + rest[k, i] >= self.least
                names, sums = (names[:, None] * self.code + np.arange(self.code)[None, :])[keep], grown[keep]
            out.append(names)
        return out


def plan(dim: int, n: int, cosine: float, target: float) -> tuple[dict, int]:
    """Filters for ``n`` vectors of one label, and how many codes find a pair of that cosine with probability ``target``."""
    grown = max(1.0, n / 5000) ** (1 / 3)
    options = {"code": int(64 * grown), "each": 13.5 * grown**0.75}
    options["least"] = CapFilters(dim, seed=0, **options).least
    rng = np.random.default_rng([11, dim])
    y, z = rng.standard_normal((2, 300, dim))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z -= (z * y).sum(axis=1, keepdims=True) * y
    z = cosine * y + np.sqrt(max(0.0, 1 - cosine**2)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    met = [
        bool(np.intersect1d(a, b).size) for caps in (CapFilters(dim, seed=k, **options) for k in range(3)) for a, b in zip(caps.decode(y), caps.decode(z), strict=True)
    ]
    missed = min(max(1 - float(np.mean(met)), 0.01), 0.95)
    return options, int(np.ceil(np.log(1 - target) / np.log(missed))) + 1


def _usable(embedding: Column, label: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, target: float = 0.998
) -> DataFrame:
    """One row for each row of ``vectors``: (vec_id, n_links, component_id, kept).

    Only vectors of equal label and length are compared. Null labels, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing and are kept. Equal vectors of a label are compared once and count as links of each
    other. Rows with a null key link with nothing. Rows that repeat a key are vectors of their own, linked only by what they hold; the least
    key of a component names it. Other columns play no part.

    Vectors that share a filter meet in a join by label and filter, whose hot keys adaptive execution splits.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("e"), F.col(label).alias("label"))
    usable = rows.where(_usable(F.col("e"), F.col("label")) & F.col("vec_id").isNotNull())
    classes = usable.groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialized(classes.withColumn("node", F.monotonically_increasing_id()))

    largest = classes.groupBy("label", F.size("e").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    plans = {r["dim"]: plan(r["dim"], r["n"], least, target) for r in largest}

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, list[CapFilters]] = {}
        for frame in frames:
            for dim, part in frame.groupby(frame["e"].map(len), sort=False):
                if dim not in known:
                    options, codes = plans[dim]
                    known[dim] = [CapFilters(dim, seed=k, **options) for k in range(codes)]
                for at in range(0, len(part), 1000):
                    some = part.iloc[at : at + 1000]
                    x = np.stack(some["e"].to_numpy()).astype(np.float64)
                    each = zip(*[[f + (k << 40) for f in caps.decode(x)] for k, caps in enumerate(known[dim])], strict=True)
                    lists = [np.concatenate(y) for y in each]
                    n = [len(y) for y in lists]
                    yield pd.DataFrame(
                        {"label": some["label"].to_numpy().repeat(n), "dim": dim, "filter": np.concatenate(lists), "node": some["node"].to_numpy().repeat(n)}
                    )

    kind = classes.schema["label"].dataType.simpleString()
    held = materialized(classes.select("label", "e", "node").mapInPandas(decoded, f"label {kind}, dim int, filter long, node long"))
    other = held.withColumnRenamed("node", "other")
    pairs = held.join(other, ["label", "dim", "filter"]).where("node < other").select("node", "other").distinct()
    left = classes.select("node", "copies", F.col("e").alias("e1"))
    right = classes.select(F.col("node").alias("other"), F.col("copies").alias("other_copies"), F.col("e").alias("e2"))
    full = pairs.join(left, "node").join(right, "other")
    cosine = _inner(F.col("e1"), F.col("e2")) / F.sqrt(_inner(F.col("e1"), F.col("e1")) * _inner(F.col("e2"), F.col("e2")))
    linked = materialized(full.where(cosine >= least).select("node", "copies", "other", "other_copies"))

    both = linked.select("node", F.col("other_copies").alias("n")).unionByName(linked.select(F.col("other").alias("node"), F.col("copies").alias("n")))
    links = both.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(linked.select(F.col("node").alias("hub"), F.col("other").alias("node")))
    # classes are known by numbers, as several may share an id; a component is named by the least id of its classes
    whole = materialized(groups.join(classes.select("node", "least"), "node"))
    named = whole.groupBy("component").agg(F.min("least").alias("c"))
    known = classes.join(links, "node", "left").join(whole.select("node", "component"), "node", "left").join(named, "component", "left")
    known = materialized(known.select("label", "e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("c", "least").alias("c")))
    good = usable.join(known, ["label", "e"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    rest = rows.where(~_usable(F.col("e"), F.col("label")) | F.col("vec_id").isNull())
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
