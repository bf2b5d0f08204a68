"""Streams: ingestion that resumes, windowed counts with late rows, and memory carried along a document's chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesseral.sources.tables import utc_timestamps


def stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_a_batch: int = 100) -> DataFrame:
    df = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)
    return utc_timestamps(df)


def ingest(source: DataFrame, sink: str, checkpoint: str, keys: list[str], watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Append new rows of a stream to a table; a restart goes on after the last committed batch, and repeats are dropped."""
    df = source.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys) if watermark else source.dropDuplicates(keys)
    return df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", every: str = "1 day", late: str = "2 days", by: str | None = None) -> DataFrame:
    """(bin, key, events): tumbling windows; rows later than the watermark are left out."""
    e = events.withWatermark(at, late)
    keys = [F.window(at, every).alias("w"), *([F.col(by).alias("key")] if by else [])]
    g = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("bin"), *(["key"] if by else []), "events")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


MEMORY_OUT = "document_id string, chunk_index int, refs string"
MEMORY_STATE = "expected int, refs array<string>, waiting array<struct<chunk_index:int,texts:array<string>>>"


def carried_memory(chunks: DataFrame, last: int = 10, patience: str = "10 minutes") -> DataFrame:
    """(document_id, chunk_index, refs) of a stream (document_id, chunk_index, texts): the last mentions of earlier chunks.

    Chunks are taken in the order of their index: one that comes early waits in the state; after the patience the
    waiting ones go out in order, without the missing one.  A chunk that comes after that is given the memory as
    it then is.
    """
    wait_ms = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, refs, waiting = state.get if state.exists else (0, [], [])
        refs, waiting = list(refs), [(w["chunk_index"], list(w["texts"])) if not isinstance(w, tuple) else w for w in (x.asDict() if hasattr(x, "asDict") else x for x in waiting)]
        for b in batches:
            waiting += [(int(i), [t for t in ts if t]) for i, ts in zip(b["chunk_index"], b["texts"])]
        waiting.sort(key=lambda w: w[0])
        out = []
        while waiting and (waiting[0][0] <= expected or state.hasTimedOut):
            i, texts = waiting.pop(0)
            out.append((key[0], i, "; ".join(refs)))
            refs = (refs + texts)[-last:]
            expected = max(expected, i + 1)
        state.update((expected, refs, waiting))
        if waiting:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=["document_id", "chunk_index", "refs"])

    return chunks.groupBy("document_id").applyInPandasWithState(step, MEMORY_OUT, MEMORY_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
