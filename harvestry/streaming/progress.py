"""Progress events as a stream: each once, numbered without gaps within its stream, appended to a log before use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "stream_id string, event_id string, kind string, ts timestamp, payload string"


def read(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(events: DataFrame, id_: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events without repeats; what is remembered is bounded by the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_])


def numbered(events: DataFrame) -> DataFrame:
    """events (EVENT) with seq from 1 within each stream, in the order of time and id inside a batch, going on over batches."""

    # the parts of a group are the rows of one micro-batch, which read() bounds by files_per_batch
    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        frame = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        frame["seq"] = range(last + 1, last + 1 + len(frame))
        state.update((last + len(frame),))
        yield frame[["stream_id", "seq", "event_id", "kind", "ts", "payload"]]

    out = "stream_id string, seq long, event_id string, kind string, ts timestamp, payload string"
    return events.groupBy("stream_id").applyInPandasWithState(number, out, "last long", "append", GroupStateTimeout.NoTimeout)


def log(events: DataFrame, folder: str, checkpoint: str) -> None:
    """All events that are there, appended to a Parquet log; goes on where the checkpoint ends."""
    q = events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def counts(events: DataFrame, ts: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by kind and window, closed by the watermark."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), "kind").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "kind", "events")


def new_urls(found: DataFrame, url: str = "canonical_url", ts: str = "discovered_at", delay: str = "1 day") -> DataFrame:
    """Discovered URLs the first time each is seen within the watermark: incremental deduplication."""
    return found.withWatermark(ts, delay).dropDuplicatesWithinWatermark([url])
