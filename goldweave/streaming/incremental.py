"""Continuous arrival of records against a master."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldweave.plans.engine import Engine


def deduplicated(stream: DataFrame, *, key: str = "id", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows of a stream once per key; with a time column, state is dropped after ``delay``."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, *, time: str, window: str = "1 day", delay: str = "1 hour", by: str | None = None) -> DataFrame:
    """Rows per window, and per ``by``, as they become final."""
    keys = [F.window(time, window)] + ([F.col(by)] if by else [])
    return stream.withWatermark(time, delay).groupBy(*keys).agg(F.count("*").alias("n"))


def resolve_stream(stream: DataFrame, engine: Engine, checkpoint: str, *, name: str = "incoming", after: Callable | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Match each micro-batch; (source table, source id) makes a repeated batch harmless."""

    def batch(df: DataFrame, epoch: int) -> None:
        if df.isEmpty():
            return
        run = engine.resolve_incremental(df, name=name, epoch=f"{name}:{epoch}")
        engine.finalize(run.run_id)
        if after:
            after(run, epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
