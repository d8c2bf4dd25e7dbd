"""Structured Streaming: ingest that drops known contents, caches with an end, coalesced writes, and subscriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.functions.text import content_hash


def fresh_documents(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Documents whose content was not seen before; with a delay (of imported_at) only that far back, so that state stays bounded."""
    hashed = stream.withColumn("content_hash", content_hash("text"))
    return hashed.withWatermark("imported_at", delay).dropDuplicatesWithinWatermark(["content_hash"]) if delay else hashed.dropDuplicates(["content_hash"])


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, delay: str | None = None) -> StreamingQuery:
    """Writes fresh documents batch by batch until the source is used up."""
    return fresh_documents(stream, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ttl_cache(puts: DataFrame, seconds: int, delay: str) -> DataFrame:
    """seq, key, value, replaced: puts (seq, key, value, at) into a cache whose entries end `seconds` after they were put.

    replaced is the value that the key still held at that time. State holds one
    value per key, until the watermark passes its end. Time is the puts' own, so
    a replay gives the same rows and a run over what is available ends. A key's
    puts of one batch are sorted together: bound a batch by the source's options.
    """

    def put(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old, ends = state.get if state.exists else (None, None)
        batch = pd.concat(list(frames)).sort_values(["us", "seq"])
        replaced = []
        for value, us in zip(batch["value"], batch["us"], strict=True):
            replaced.append(old if ends is not None and ends > us else None)
            old, ends = value, int(us) + seconds * 1_000_000
        yield pd.DataFrame({"seq": batch["seq"], "key": key[0], "value": batch["value"], "replaced": replaced})
        state.update((old, ends))
        state.setTimeoutTimestamp(max(-(-ends // 1000), state.getCurrentWatermarkMs() + 1))

    timed = puts.withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return timed.groupBy("key").applyInPandasWithState(put, "seq long, key string, value string, replaced string", "value string, ends long", "append", GroupStateTimeout.EventTimeTimeout)


def coalesced_writes(writes: DataFrame, seconds: int, delay: str) -> DataFrame:
    """path, started_at, ended_at, n_writes, value: bursts of writes as one, emitted when the watermark has passed their end."""
    bursts = writes.withWatermark("at", delay).groupBy("path", F.session_window("at", f"{seconds} seconds").alias("burst"))
    return bursts.agg(F.count("*").alias("n_writes"), F.max_by("value", F.struct("at", "seq")).alias("value")).select("path", F.col("burst.start").alias("started_at"), F.col("burst.end").alias("ended_at"), "n_writes", "value")


def subscriptions(docs: DataFrame, matches: dict[str, Callable[[DataFrame], DataFrame]], notify: Callable[[str, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs saved filters over each batch of new documents."""

    def each(batch: DataFrame, number: int) -> None:
        for name, match in matches.items():
            notify(name, match(batch), number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
