"""Streams: upserts by micro-batch, counts by event time, and the last state of each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.merge import dedupe_last, upsert
from marlstone.sources.formats import exists, replace


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch, reduced to the last row of each key, is merged into the Parquet table at path.

    A batch that is delivered again after a failure changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        new = dedupe_last(batch, keys, [F.col(order).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in batch.columns if c != order)])
        spark = batch.sparkSession
        replace(upsert(spark.read.parquet(path), new, keys) if exists(spark, path) else new, path)

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(events: DataFrame, at: str, by: str, value: str, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, by, n, total) of tumbling or sliding windows; rows later than `late` are left out of a stream."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    src = events.withWatermark(at, late) if events.isStreaming else events
    g = src.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    src = events.withWatermark(at, late) if events.isStreaming else events
    g = src.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each micro-batch, kept as state of the stream."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.select(key, value).groupBy(key).applyInPandasWithState(step, f"key {kind}, n long, total double", "n long, total double", "update", "NoTimeout")
