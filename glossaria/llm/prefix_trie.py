"""The trie of conversation prefixes.

1. Turns become digests where they are read; texts go no further. The turns of a conversation, in order, chain into one digest for each
   prefix, a task streaming over sorted rows.
2. A count-min sketch of all prefix digests proves most prefixes single. From the first such prefix on, a conversation is alone: its tail
   of nodes is emitted where it stands.
3. Only prefixes that may be shared are grouped by digest, exactly. The least member of a node owns it. What a node adds to all nodes above is
   added up along its owner's own prefixes, from the deepest up, and then for each digest over all conversations, so no step
   walks the trie level by level, and each sum is partly made before it is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.llm.common import materialized, table
from glossaria.llm.sketch import may_repeat, sketch

_ROOT = bytes(16)
_PART = 1024  # prefixes in one row
_TEXT = 64_000  # characters of joined ids in one row
_SHARED, _ALONE, _END = 0, 1, 2


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, d, n_bytes) of each row: the digest of role and text, and the UTF-8 bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text)))
    return turns.where("conv_id IS NOT NULL").select("conv_id", "turn", d.alias("d"), F.octet_length(text).cast("long").alias("n_bytes"))


Events = Iterator[tuple[int, int, bytes | None, int]]


def _events(frames: Iterator[pd.DataFrame]) -> Events:
    """(group, conv_id, digest, n_bytes) of each turn; a null digest opens each conversation."""
    conv = None
    for frame in frames:
        for g, c, d, size in zip(frame["g"].tolist(), frame["conv_id"].tolist(), frame["d"], frame["n_bytes"].tolist()):
            if c != conv:
                conv = c
                yield g, c, None, 0
            yield g, c, d, size


def prefixes(turns: DataFrame, group: str = "conv_id", rebuild: Callable[[Events], Events] | None = None) -> DataFrame:
    """(conv_id, start, before, digests, sizes, ends): the prefixes of each conversation, packed, some of them in a row.

    ``turns`` come from ``digests``, in order of turn, null first, then digest. ``rebuild`` may change the turns of the conversations of a
    ``group``, that of the group's own id coming first. ``before`` is the digest of the prefix before the first one, ``ends`` says that
    the conversation ends with the last one. What a task holds is one row, however long the conversation.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, conv, state, start, before, some, sizes = [], None, _ROOT, 0, _ROOT, [], []
        columns = ["conv_id", "start", "before", "digests", "sizes", "ends"]

        def part(ends: bool) -> tuple:
            return conv, start, before, b"".join(some), np.array(sizes, "<i8").tobytes(), ends

        for _, c, d, size in (rebuild or iter)(_events(frames)):
            if d is None:
                if conv is not None:
                    out.append(part(True))
                conv, state, start, before, some, sizes = c, _ROOT, 0, _ROOT, [], []
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
                continue
            if len(some) == _PART:
                out.append(part(False))
                start, before, some, sizes = start + _PART, state, [], []
            state = hashlib.md5(state + d).digest()
            some.append(state)
            sizes.append(size)
        if conv is not None:
            out.append(part(True))
        yield pd.DataFrame(out, columns=columns)

    rows = turns.withColumn("g", F.expr(group))
    dealt = rows.repartition("g").sortWithinPartitions("g", F.col("conv_id") != F.col("g"), "conv_id", F.asc_nulls_first("turn"), "d")
    return dealt.select("g", "conv_id", "d", "n_bytes").mapInPandas(batches, "conv_id long, start long, before binary, digests binary, sizes binary, ends boolean")


def _screened(parts: DataFrame, bits) -> DataFrame:
    """One row for each prefix (a, b) and its parent (pa, pb): shared, perhaps, or alone for certain; and one for each end that is alone."""

    def pairs(packed: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2)

    def repeated(digests: np.ndarray) -> np.ndarray:
        return may_repeat(bits.value, np.ascontiguousarray(digests[:, 0]).view(np.uint64))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            conv, start, ends = (frame[c].to_numpy() for c in ("conv_id", "start", "ends"))
            n = frame["digests"].map(len).to_numpy() // 16
            own, before, sizes = pairs(frame["digests"]), pairs(frame["before"]), np.frombuffer(b"".join(frame["sizes"]), "<i8")
            offset = np.cumsum(n) - n
            part = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(own)) - offset[part]
            first = place == 0
            parent = np.where(first[:, None], before[part], np.roll(own, 1, axis=0)) if len(own) else own
            left = (~repeated(before) & (start > 0))[part]
            single = ~repeated(own)
            so_far = np.cumsum(single)
            alone = left | (so_far - (so_far - single)[offset[part]] > 0)
            top = alone & ~np.where(first, left, np.roll(alone, 1))
            last = (place == n[part] - 1) & ends[part]
            nodes = pd.DataFrame({"kind": np.where(alone, _ALONE, _SHARED), "conv_id": conv[part], "depth": start[part] + place + 1})
            nodes["a"], nodes["b"], nodes["pa"], nodes["pb"] = own[:, 0], own[:, 1], parent[:, 0], parent[:, 1]
            nodes["size"], nodes["ends"], nodes["top"] = sizes, last, top
            opens = start == 0
            roots = pd.DataFrame({"kind": _SHARED, "conv_id": conv[opens], "depth": 0, "a": 0, "b": 0, "pa": 0, "pb": 0, "size": 0, "ends": (ends & (n == 0))[opens], "top": False})
            marks = nodes[last & alone].assign(kind=_END, depth=2**62, ends=False, top=False)
            yield pd.concat([nodes, roots, marks], ignore_index=True)

    return parts.mapInPandas(batches, "kind int, conv_id long, depth long, a long, b long, pa long, pb long, size long, ends boolean, top boolean")


def _joined_ids(shared: DataFrame) -> DataFrame:
    """(a, b, sha256) of the ids of the conversations that end in a node, ascending, with commas.

    Ranges of ids are joined where they lie, then a task reads the texts of a node one after another: no list of ids is held.
    """

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, ids, size, out = None, [], 0, []
        for frame in frames:
            for a, b, c in zip(frame["a"].tolist(), frame["b"].tolist(), frame["conv_id"].tolist()):
                if (a, b) != node or size > _TEXT:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids, size = (a, b), [], 0
                ids.append(c)
                size += 12
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=["a", "b", "first", "ids"])
                out = []
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        yield pd.DataFrame(out, columns=["a", "b", "first", "ids"])

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, out = None, None, []
        for frame in frames:
            for a, b, ids in zip(frame["a"].tolist(), frame["b"].tolist(), frame["ids"]):
                if (a, b) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=["a", "b", "sha256"])
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
        yield pd.DataFrame(out, columns=["a", "b", "sha256"])

    ends = shared.where("ends").select("a", "b", "conv_id")
    ranges = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInPandas(join, "a long, b long, first long, ids string")
    return ranges.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInPandas(hashed, "a long, b long, sha256 string")


def trie(parts: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node, the textless root included.

    ``parts`` come from ``prefixes``. A node is known by the 128-bit digest of its turns. A table without conversations gives no rows.
    """
    parts = materialized(parts)
    bits = parts.sparkSession.sparkContext.broadcast(sketch(parts.select(F.col("digests").alias("keys")), stride=2))
    rows = materialized(_screened(parts, bits))
    shared, alone = rows.where(F.col("kind") == _SHARED), rows.where(F.col("kind") == _ALONE)
    nodes = shared.groupBy("a", "b").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), *[F.min(c).alias(c) for c in ("depth", "pa", "pb", "size")]
    )
    nodes = materialized(nodes)
    below = nodes.where("depth > 0").select("pa", "pb").unionByName(alone.where("top").select("pa", "pb"))
    kids = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    owners = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("above"))
    nodes = nodes.join(kids, ["a", "b"], "left").join(owners, ["pa", "pb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialized(nodes)

    gains = nodes.select("a", "b", F.col("owner").alias("conv_id"), ((F.col("n_convs") - 1) * F.col("size")).alias("gain"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    steps = shared.select("conv_id", "depth", "a", "b").join(gains, ["conv_id", "a", "b"], "left")
    marks = rows.where(F.col("kind") == _END).select("conv_id", "depth", "a", "b", F.lit(0).cast("long").alias("gain"), F.lit(1).cast("long").alias("leaf"))
    steps = steps.unionByName(marks)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("a", "b", "depth", *[F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(c) for c in ("gain", "leaf")]).where(F.col("depth") < 2**62)
    sums = sums.groupBy("a", "b").agg(F.sum("gain").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    whole = nodes.join(sums, ["a", "b"]).join(_joined_ids(shared), ["a", "b"], "left")
    none = F.sha2(F.lit(""), 256)
    whole = whole.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("sha256", none).alias("ends_sha256"),
    )
    tops = alone.where("top").join(owners, ["pa", "pb"], "left")
    tails = alone.where("NOT top").withColumn("above", F.col("conv_id")).unionByName(tops, allowMissingColumns=True)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = tails.select(
        "conv_id",
        "depth",
        F.coalesce("above", "conv_id").alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(F.col("ends"), zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return whole.unionByName(tails)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations as they are; see ``trie`` for the columns.

    ``turns`` has conv_id, turn, role and text; other columns play no part. Null roles and texts are empty. Turns are ordered by turn, null
    first, then by the digest of role and text; repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are
    left out. Texts of any length are one digest; a conversation of any length streams through one task, 16 bytes a turn.
    """
    return trie(prefixes(digests(turns)))


def shared_starts(events: Events) -> Events:
    """Conversations that begin with up to eight turns of the first of their group instead of their own."""
    base, first, h, seen = None, [], 0, 0
    for g, c, d, size in events:
        if d is None:
            if g != base:
                base, first = g, []
            h, seen = zlib.crc32(str(c).encode()) % 9, 0
            yield g, c, None, 0
            if c != g:
                yield from ((g, c, *x) for x in first[:h])
            continue
        if c == g and len(first) < 8:
            first.append((d, size))
        seen += 1
        if c == g or seen > h:
            yield g, c, d, size


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(prefixes(digests(table(spark, sf_dir, "conversations")), "conv_id - conv_id % 5", shared_starts))


SQL_OP11 = """
WITH RECURSIVE bits AS (SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) AS r(b)
  UNION ALL SELECT b, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
o AS (SELECT conv_id AS c, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, turn, strlen(coalesce(text, '')) AS n
      FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS i FROM o),
ids AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
          lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM own), crc),
turns AS (SELECT ids.c, own.d, own.n, i FROM ids JOIN own ON own.c = ids.c WHERE i > h OR ids.c = base
          UNION ALL SELECT ids.c, own.d, own.n, i FROM ids JOIN own ON own.c = base WHERE ids.c <> base AND i <= h),
ranked AS (SELECT c, n, d, row_number() OVER (PARTITION BY c ORDER BY i) AS depth FROM turns),
pre AS (SELECT c, depth, n, md5(string_agg(d, ',') OVER (PARTITION BY c ORDER BY depth)) AS k FROM ranked
        UNION ALL SELECT c, 0, 0, '' FROM ids),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY c) AS is_end FROM pre),
node AS (SELECT k, any_value(up) AS up, any_value(depth) AS depth, any_value(n) AS n, count(*) AS n_convs, min(c) AS conv_id,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends_sha256 FROM linked GROUP BY k),
kids AS (SELECT up, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up),
anc AS (SELECT k, k AS top FROM node UNION ALL SELECT anc.k, node.up FROM anc JOIN node ON node.k = anc.top WHERE node.depth > 0),
sub AS (SELECT top, sum((n_convs - 1) * n)::BIGINT AS saved_tokens, count(*) FILTER (WHERE kids.up IS NULL) AS n_leaves
        FROM anc JOIN node ON node.k = anc.k LEFT JOIN kids ON kids.up = anc.k GROUP BY top)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN sub ON sub.top = node.k LEFT JOIN kids ON kids.up = node.k LEFT JOIN node AS parent ON parent.k = node.up AND node.depth > 0
"""
