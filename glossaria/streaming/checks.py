"""Validation and code resolution of streams: per-record joins of a stream with static rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glossaria.operators.flat import check_enum_codes
from glossaria.operators.validate import notable, summary, validate
from glossaria.plans.dictionary import Dictionary


def resolve_stream(d: Dictionary, requests: DataFrame, field: str) -> DataFrame:
    """I4 on a stream of (request_id, root, code): rows (request_id, code, key), by stream-static joins."""
    codes = d.term_codes.where(f"field = '{field}'").select("code", "key")
    members = d.enum_members.selectExpr("term AS key", "concat('terms/', root) AS root")
    return requests.join(codes, "code").join(members, ["key", "root"], "left_semi").select("request_id", "code", "key")


def validate_stream(d: Dictionary, rules: DataFrame, rows: DataFrame, reports: str, checkpoint: str, counters: str | None = None, **options) -> StreamingQuery:
    """V2 on a stream of (row_id, descriptor, value): each micro-batch is validated as a table.

    Rows that failed or changed are appended to ``reports``, counters by descriptor to ``counters``, with their batch, so a batch
    that runs again after a failure replaces its own files.
    """

    def one(batch: DataFrame, number: int) -> None:
        report = validate(d, rules, batch, **options)
        notable(report).drop("value").write.mode("overwrite").parquet(f"{reports}/batch={number}")
        if counters:
            summary(report, "descriptor").write.mode("overwrite").parquet(f"{counters}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Any batch operator over a stream, batch by batch."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


__all__ = ["check_enum_codes", "each_batch", "resolve_stream", "validate_stream"]
