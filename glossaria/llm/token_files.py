"""Token ids in binary shard files with a minimal perfect hash index.

A shard is two files in the shared folder: ``.bin`` holds nothing but ids, little-endian, 16 bits wide where the vocabulary allows it
and 32 bits otherwise; ``.idx`` maps the keys of the shard to slots without collisions or gaps, and each slot holds a fingerprint
of its key, the number of its first entry and how many entries share the key. Looking a key up takes a constant number of reads.

Shards hold consecutive ranges of keys in ascending order. Ids that precede a shard are summed over shards, never over documents.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.llm.common import materialized, shared_dir, table
from glossaria.llm.tokens import blocks, library_encoder, vocabulary


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash: levels of bits, a key's slot being the rank of the first bit that it alone has set."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        unpacked = np.unpackbits(bits)
        self.ranks = np.concatenate(([0], np.cumsum(unpacked.reshape(-1, 64).sum(axis=1, dtype=np.int64)))) if len(bits) else np.zeros(1, np.int64)
        self.set = unpacked

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 1.5) -> PerfectHash:
        """``keys``: distinct 64-bit integers."""
        sizes, levels, left = [], [], keys
        while len(left):
            size = max(64, -(-int(len(left) * spread) // 64) * 64)
            at = _mix(left, len(sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at.astype(np.int64)]]
        return cls(sizes, np.packbits(np.concatenate(levels)) if levels else np.empty(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not given to ``build``, any slot or -1."""
        out, base, open_ = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = base + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.set[at] == 1
            found = at[hit]
            within = np.arange(64)[None, :] < (found % 64)[:, None]
            out[open_[hit]] = self.ranks[found // 64] + (self.set[(found // 64 * 64)[:, None] + np.arange(64)[None, :]] * within).sum(axis=1)
            open_, base = open_[~hit], base + size
        return out


class Store:
    """Files in the shared folder, by any scheme that pyarrow knows; a file appears whole or not at all."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def publish(self, temporary: str, name: str) -> None:
        self.fs.move(self.path(temporary), self.path(name))


def _index_bytes(keys: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    """``keys`` ascending, equal keys neighbours; ``sizes`` are the tokens of their entries and of those without a key after them."""
    distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
    hashed = PerfectHash.build(distinct)
    slot = hashed.slots(distinct)
    arrays = {
        "bits": hashed.bits,
        "fingerprint": np.zeros(len(distinct), "<u4"),
        "entry": np.zeros(len(distinct), "<u4"),
        "copies": np.zeros(len(distinct), "<u4"),
        "start": (np.cumsum(sizes) - sizes).astype("<u8"),
        "tokens": sizes.astype("<u4"),
    }
    arrays["fingerprint"][slot] = (_mix(distinct, 77) >> np.uint64(32)).astype("<u4")
    arrays["entry"][slot], arrays["copies"][slot] = first, copies
    out = io.BytesIO()
    head = json.dumps({"width": width, "levels": hashed.sizes, "arrays": [[k, str(v.dtype), len(v)] for k, v in arrays.items()]}).encode()
    out.write(len(head).to_bytes(8, "little") + head)
    for v in arrays.values():
        out.write(v.tobytes())
    return out.getvalue()


class Shard:
    """An open shard. ``find`` gives entry numbers, ``ids`` the tokens of an entry."""

    def __init__(self, store: Store, name: str):
        with store.fs.open_input_stream(store.path(f"{name}.idx")) as f:
            data = f.read()
        n = int.from_bytes(data[:8], "little")
        head = json.loads(data[8 : 8 + n])
        at, self.arrays = 8 + n, {}
        for k, kind, length in head["arrays"]:
            self.arrays[k] = np.frombuffer(data, kind, length, at)
            at += self.arrays[k].nbytes
        self.hash = PerfectHash(head["levels"], self.arrays["bits"])
        self.width = head["width"]
        self.file = store.fs.open_input_file(store.path(f"{name}.bin"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first entry of each key, -1 where the fingerprint says that the shard does not hold it."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.arrays["fingerprint"][slot[known]] == (_mix(keys[known], 77) >> np.uint64(32)).astype(np.uint32)
        return np.where(known, self.arrays["entry"][slot].astype(np.int64), -1) if len(self.arrays["entry"]) else np.full(len(keys), -1)

    def ids(self, entry: int) -> np.ndarray:
        self.file.seek(int(self.arrays["start"][entry]) * self.width)
        return np.frombuffer(self.file.read(int(self.arrays["tokens"][entry]) * self.width), f"<u{self.width}")


def publish_manifest(written: DataFrame, root: str) -> None:
    """Write the range of keys of each shard beside the shards, one row for each, so that ``Tokens`` needs nothing but the folder."""
    named = written.where("copy IS NOT NULL AND key IS NOT NULL")
    ranges = named.groupBy("shard").agg(F.min("key").alias("least"), F.max("key").alias("greatest"))
    ranges.coalesce(1).sortWithinPartitions("shard").write.mode("overwrite").parquet(f"{root}/manifest")


class Tokens:
    """Keyed access to a folder of shards: the manifest says which shard may hold a key, its index where."""

    def __init__(self, root: str):
        from pyarrow import dataset

        self.store, self.open = Store(root), {}
        ranges = dataset.dataset(self.store.path("manifest"), filesystem=self.store.fs, format="parquet").to_table().sort_by("shard")
        self.shards, self.least, self.greatest = (ranges[c].to_numpy() for c in ("shard", "least", "greatest"))

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of all documents of a key, none for an unknown one (but for a false fingerprint, one in four thousand million)."""
        out, k = [], int(np.searchsorted(self.greatest, key))
        while k < len(self.shards) and self.least[k] <= key:
            name = int(self.shards[k])
            if name not in self.open:
                self.open = {name: Shard(self.store, f"shard-{name:06d}")}
            shard = self.open[name]
            entry = int(shard.find(np.array([key], np.int64))[0])
            if entry >= 0:
                copies = int(shard.arrays["copies"][shard.hash.slots(np.array([key], np.int64))[0]])
                out += [shard.ids(e) for e in range(entry, entry + copies)]
            k += 1
        return out


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int, shard_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents in ascending order of key, null keys last; the rows returned are (key, shard, copy, shard_tokens).

    Shards hold about ``shard_bytes`` of text each. One row a document says which shard has its key and, for equal keys, which of
    the shard's copies it is; one row with a null ``copy`` for each shard gives its ids. A null or empty text is the end token
    alone. Rows with a null key are not in the index; their ``copy`` is the number of their entry. Equal keys may share a shard or
    stand in neighbouring ones. Other columns play no part; an empty table gives one shard without ids.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    width = 2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, store, shard = library_encoder(tokenizer), Store(root), TaskContext.get().partitionId()
        store.fs.create_dir(store.root, recursive=True)
        name, mark = f"shard-{shard:06d}", uuid.uuid4().hex
        keys, sizes = [], []
        with store.fs.open_output_stream(store.path(f"{name}.{mark}.bin.tmp")) as payload:
            for frame in frames:
                texts = frame["text"].fillna("").tolist()
                for a, b in blocks(texts):
                    for ids in encoder.batch(texts[a:b]):
                        whole = np.append(ids, np.int32(end_id)).astype(f"<u{width}")
                        payload.write(whole.tobytes())
                        sizes.append(len(whole))
                keys += frame["key"].astype("Int64").tolist()
        nameless = sum(k is pd.NA for k in keys)
        keys, sizes = np.array(keys[: len(keys) - nameless], np.int64), np.array(sizes, np.int64)
        with store.fs.open_output_stream(store.path(f"{name}.{mark}.idx.tmp")) as index:
            index.write(_index_bytes(keys, sizes, width))
        store.publish(f"{name}.{mark}.bin.tmp", f"{name}.bin")
        store.publish(f"{name}.{mark}.idx.tmp", f"{name}.idx")
        if nameless:
            yield pd.DataFrame({"key": pd.Series([None] * nameless, dtype="Int64"), "shard": shard, "copy": np.arange(nameless) + len(keys), "shard_tokens": 0})
        if len(keys):
            starts = np.concatenate(([True], keys[1:] != keys[:-1]))
            copy = np.arange(len(keys)) - np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))
            yield pd.DataFrame({"key": keys, "shard": shard, "copy": copy.astype(object), "shard_tokens": 0})
        yield pd.DataFrame({"key": [0], "shard": [shard], "copy": pd.Series([None], dtype=object), "shard_tokens": [int(sizes.sum())]})

    order = (F.col("key").asc_nulls_last(), "h")
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("h")
    return materialized(dealt.mapInPandas(batches, "key long, shard long, copy long, shard_tokens long"))


def read(written: DataFrame, root: str) -> DataFrame:
    """Look every written key up in the files: (key, start, n_tokens, ids_crc32). A key that its shard does not hold is an error.

    The ids before a shard are summed in two steps, over the shards of a thousand and over the thousands. They are a table of their own,
    whose size Spark knows, so the join with the documents never broadcasts those.
    """
    totals = written.where("copy is null").select("shard", "shard_tokens", F.floor(F.col("shard") / 1000).alias("part"))
    parts = totals.groupBy("part").agg(F.sum("shard_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    within = F.sum("shard_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("shard_tokens")
    before = totals.withColumn("within_part", within).join(parts, "part").select("shard", (F.col("earlier") + F.col("within_part")).alias("before"))
    before = materialized(before)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, shards = Store(root), {}
        for frame in frames:
            for k, rows in frame.groupby("shard", sort=False):
                if k not in shards:
                    shards = {k: Shard(store, f"shard-{k:06d}")}
                shard = shards[k]
                named = rows["key"].notna().to_numpy()
                entry = rows["copy"].to_numpy(np.int64)
                first = shard.find(rows.loc[named, "key"].to_numpy(np.int64))
                if (first < 0).any():
                    raise KeyError(f"shard {k} does not hold {rows.loc[named, 'key'][first < 0].iloc[0]}")
                entry[named] += first
                crc = [zlib.crc32(shard.ids(e).astype("<u4").tobytes()) for e in entry.tolist()]
                yield pd.DataFrame(
                    {"key": rows["key"].astype("Int64").array, "shard": k, "within": shard.arrays["start"][entry].astype(np.int64), "n_tokens": shard.arrays["tokens"][entry].astype(np.int64), "ids_crc32": crc}
                )

    found = written.where("copy is not null").select("key", "shard", "copy")
    found = found.mapInPandas(batches, "key long, shard long, within long, n_tokens long, ids_crc32 long")
    return found.join(before, "shard").select("key", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/tokens"
    written = write(table(spark, sf_dir, "documents"), root, "byte_bpe_50k.json", 2)
    return read(written, root).withColumnRenamed("key", "doc_id")
