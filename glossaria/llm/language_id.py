"""Language identification by compression.

Each language owns a raw-content zstandard dictionary cut from a bounded sample of its texts. A text belongs
to the language whose dictionary lets it compress to the fewest bytes; where the two smallest sizes lie closer together
than they do for nearly all texts of its length that are known to be of one language, the verdict is marked as rejected.

Case and everything but letters carry no weight: texts are lower-cased and runs of other characters become one space
before they are compressed, in the JVM, the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.llm.common import held_out, materialized, table

UNDETERMINED = "und"
_HALVED = 256  # bytes from which on a text is packed in two parts at least


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language, at most ``dict_bytes`` of ``fit`` each.

    A text is packed in equal parts, two or more of at most ``block_bytes``, each against the same dictionary, so the dictionary weighs as much
    at the end of a long text as at its start, and a text of two languages shows a narrow margin in one part. ``margins``: the least margin by the bit length of a text's size in bytes; ``min_margin`` for other sizes.
    """

    content: dict[str, bytes]
    level: int = 12
    block_bytes: int = 16 << 10
    min_margin: float = 0.002
    margins: dict[int, float] = field(default_factory=dict)


def _letters(text):
    """Lower-case letters with their marks, other runs as one space; empty for null and where no letter stands."""
    return F.when(text.rlike(r"\p{L}"), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))).otherwise("")


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    samples: int = 256,
    dict_bytes: int = 110 << 10,
    keep: float = 0.99,
    **options,
) -> LanguageModel:
    """Learn one dictionary for each language, and the margins below which texts are rejected.

    The sample is bounded: at most twice ``samples`` rows of a language, the text with the least hash in each of so many slots, so it
    depends on the texts alone, and one hot language costs no more than any other (minima are combined before the shuffle). One half
    makes the dictionaries, the first row of each language among them. The other is identified with them: for texts of about a size, the margin is the largest that
    ``keep`` of those that are identified rightly reach.
    The sampled texts are read whole: cut into pieces of some 400 letters, whose hashes decide which of them make up the
    ``dict_bytes`` bytes of the dictionary. Rows with a null text or language, or a text without letters, teach nothing.
    """
    rows = labelled.select(F.col(text).alias("_t"), F.col(lang).alias("_l")).where("_t is not null and _l is not null").where(F.col("_t").rlike(r"\p{L}"))
    rows = rows.withColumn("_h", F.xxhash64("_t"))
    least = rows.groupBy("_l", F.pmod("_h", F.lit(2 * samples)).alias("_slot")).agg(F.min("_h").alias("_h"))
    texts = rows.join(materialized(least.drop("_slot")), ["_l", "_h"])  # written, so that Spark knows its size
    texts = texts.groupBy("_l", "_h").agg(F.first("_t").alias("_t"))
    sampled = materialized(texts.withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy("_h")) % 2))
    texts = sampled.where("_k = 1")
    pieces = texts.select("_l", "_h", F.posexplode(F.regexp_extract_all(_letters(F.col("_t")), F.lit(r"\S.{0,399}(?=\s|$)|\S{1,400}"), F.lit(0))).alias("_p", "_t"))
    pieces = pieces.withColumn("_o", F.xxhash64("_h", "_p")).withColumn("_n", F.octet_length("_t") + 1)
    taken = F.sum("_n").over(Window.partitionBy("_l").orderBy("_o", "_p").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("_before", F.coalesce(taken, F.lit(0))).where(F.col("_before") < dict_bytes)
    content: dict[str, bytes] = {}
    for r in pieces.orderBy("_l", "_before").select("_l", "_t").collect():
        content[r["_l"]] = (content.get(r["_l"], b"") + r["_t"].encode() + b" ")[:dict_bytes]
    model = LanguageModel(content, **options)
    return replace(model, margins=_margins(model, sampled.where("_k = 0"), keep))


def _margins(model: LanguageModel, texts: DataFrame, keep: float) -> dict[int, float]:
    """For each bit length of sizes, the margin that ``keep`` of the rightly identified texts of that and the neighbouring lengths reach."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scorer(model) if model.content else None
        for frame in frames:
            out = [(right, t, score(t)) for right, t in zip(frame["_l"], frame["_t"]) if score and t]
            yield pd.DataFrame([(_size(t), found[2]) for right, t, found in out if found[0] == right], columns=["size", "margin"])

    found = texts.select("_l", _letters(F.col("_t")).alias("_t")).mapInPandas(batches, "size int, margin double").toPandas()
    out = {}
    for size in range(2, int(found["size"].max()) + 2) if len(found) else ():
        near = found.loc[(found["size"] - size).abs() <= 1, "margin"].to_numpy()
        if len(near) * (1 - keep) >= 1:
            out[size] = max(model.min_margin, float(np.quantile(near, 1 - keep, method="lower")))
    return out


def _size(letters: str) -> int:
    return len(letters.encode()).bit_length()


def _packers(model: LanguageModel, level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in model.content.values():
        packed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packed.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=packed, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _scorer(model: LanguageModel):
    packers, names = _packers(model, model.level), list(model.content)

    def score(letters: str) -> tuple[str, float, float, bool]:
        data = f" {letters} ".encode()
        parts = max(1 + (len(data) >= _HALVED), -(-len(data) // model.block_bytes))
        cuts = [len(data) * k // parts for k in range(parts + 1)]
        sizes = np.array([[len(p.compress(data[a:b])) for p in packers] for a, b in zip(cuts, cuts[1:])])
        total = sizes.sum(axis=0)
        best = int(total.argmin())
        scale = 0.02 * total[best] + 2.0
        share = float((2.0 ** np.maximum(-60.0, (total[best] - total) / scale)).sum())
        margin = 1.0
        if len(names) > 1:
            # a part that fits another language better has a margin below 0
            others = np.delete(sizes, best, axis=1).min(axis=1)
            margin = float(((others - sizes[:, best]) / others).min())
        return names[best], 1.0 / share, margin, margin < model.margins.get(_size(letters), model.min_margin)

    return score


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected`` to every row.

    ``lang_pred`` is ``und`` with score 0, and ``rejected`` is true, where the text is null or has no letter, or where the
    model knows no language. Equal sizes go to the first language by name. ``rejected`` is also true where, in some
    part of the text, the margin to the next language's size, as a share of that, is below that of ``model`` for a text of its size. Columns of these names in
    ``docs`` are replaced; all others pass through, repeated rows and repeated ids each keep their own result.
    """

    added = {"lang_pred": pa.string(), "score": pa.float64(), "margin": pa.float64(), "rejected": pa.bool_()}
    kept, letters = docs.drop(*added), "_letters"
    while letters in kept.columns:
        letters += "_"

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model) if model.content else None
        for frame in frames:
            out = [score(t) if score and t else (UNDETERMINED, 0.0, 0.0, True) for t in frame.columns[-1].to_pylist()]
            found = [pa.array(x, kind) for x, kind in zip(zip(*out) if out else [[]] * len(added), added.values())]
            yield pa.RecordBatch.from_arrays([*frame.columns[:-1], *found], [*frame.schema.names[:-1], *added])

    out = kept.select("*", _letters(F.col(text)).alias(letters))
    schema = kept.limit(0).schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    return out.mapInArrow(batches, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
