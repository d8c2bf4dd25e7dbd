"""Streams of answers: deltas gathered into pieces, and the order of an answer's events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.functions.text import column
from factloom.shipping import checkpoint

#: Characters at which a buffer of deltas is passed on, and from which a piece of a whole text ends at the next word.
FLUSH_CHARS, PIECE_CHARS = 40, 60
#: The name under which allowed steps give what an answer may begin with.
START = ""

_PIECES = "answer_id string, piece long, text string"
_OFFENCE = "key string, seq long, before string, kind string"


def word_pieces(text: Column | str, size: int = PIECE_CHARS) -> Column:
    """A whole text in pieces of `size` characters, each going on to the end of its last word; joined they are the text."""
    return F.regexp_extract_all(column(text), F.lit(rf"(?s).{{{size}}}(?=\s)|.{{{size}}}[^ \n]*[ \n]|.+"), F.lit(0))


def buffered(deltas: DataFrame, delay: str, idle_seconds: int, flush_chars: int = FLUSH_CHARS) -> DataFrame:
    """answer_id, piece, text: a stream of deltas (answer_id string, seq, delta, done, at) in pieces that joined are the answer.

    What has come of an answer is held until it has flush_chars characters or a line end, then passed on. The rest is
    passed on with the delta that is done, or when for idle_seconds of the deltas' own time none came, as soon as the watermark
    (`delay` behind) has passed that. State is one short text for each open answer. Deltas of one batch are taken by seq.
    """

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        out = []

        def passed_on() -> None:
            nonlocal held, n
            if held:
                out.append((key[0], n, held))
                held, n = "", n + 1

        if state.hasTimedOut:
            passed_on()
            state.remove()
        else:
            # Plain rows: most answers have few, for which a frame that is joined and sorted costs far more than they do.
            rows = [row for f in frames for row in zip(f["seq"].tolist(), f["ms"].tolist(), f["delta"].tolist(), f["done"].tolist(), strict=True)]
            rows.sort(key=lambda row: row[:2])
            for _, _, delta, done in rows:
                held += delta or ""
                if len(held) >= flush_chars or "\n" in held or done:
                    passed_on()
            if any(row[3] for row in rows):
                state.remove()
            else:
                state.update((held, n))
                state.setTimeoutTimestamp(max(max(row[1] for row in rows) + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["answer_id", "piece", "text"])

    timed = deltas.withWatermark("at", delay).select("answer_id", "seq", F.coalesce("delta", F.lit("")).alias("delta"), F.coalesce("done", F.lit(False)).alias("done"), "at", F.unix_millis("at").alias("ms"))
    return timed.groupBy("answer_id").applyInPandasWithState(gather, _PIECES, "held string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def first_offences(events: DataFrame, steps: dict[str, tuple[str, ...]]) -> DataFrame:
    """key, seq, before, kind of the first event of each key (key, seq, kind) that may not follow the one before it.

    steps: what may follow each kind, and under START what a key may begin with; a kind that is not there ends its key.
    Events are sorted by key and seq into ranges over all partitions, so those of one key, however many, need not meet in
    one task: only the last event of each key and range is handed to the next range. Events of one seq stand by kind.
    """
    rows = checkpoint(events.select("key", "seq", "kind").repartitionByRange("key", "seq", "kind").withColumn("part", F.spark_partition_id()))
    order = [F.col("seq").asc_nulls_first(), F.col("kind").asc_nulls_first()]
    within = rows.withColumn("before", F.lag(F.struct("kind")).over(Window.partitionBy("key", "part").orderBy(*order)))
    ends = rows.groupBy("key", "part").agg(F.max_by(F.struct("kind"), F.struct("seq", "kind")).alias("last"))
    handed = ends.select("key", "part", F.lag("last").over(Window.partitionBy("key").orderBy("part")).alias("handed")).where("handed IS NOT NULL")
    same = within["key"].eqNullSafe(handed["key"]) & (within["part"] == handed["part"])
    joined = within.join(handed, same, "left").select(within["key"], "seq", "kind", F.coalesce("before", "handed")["kind"].alias("before"), (F.col("before").isNull() & F.col("handed").isNull()).alias("begins"))
    allowed = [f"{a}>{b}" for a, following in steps.items() for b in following]
    step = F.concat(F.when(F.col("begins"), START).otherwise(F.coalesce("before", F.lit("?"))), F.lit(">"), F.coalesce("kind", F.lit("?")))
    wrong = joined.where(~step.isin(allowed))
    first = wrong.groupBy("key").agg(F.min(F.struct(F.col("seq").isNotNull().alias("known"), "seq", "kind", "before")).alias("x"))
    return first.select("key", "x.seq", F.col("x.before").alias("before"), "x.kind")


def offences(events: DataFrame, steps: dict[str, tuple[str, ...]]) -> DataFrame:
    """The same of a stream (key string, seq, kind), emitted when it comes: a key's state is its last kind, and whether it has offended."""
    allowed = {(a, b) for a, following in steps.items() for b in following}

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, offended = state.get if state.exists else (START, False)
        batch = pd.concat(list(frames)).sort_values(["seq", "kind"])
        for seq, kind in zip(batch["seq"], batch["kind"], strict=True):
            if offended:
                break
            if (before, kind) not in allowed:
                offended = True
                yield pd.DataFrame([(key[0], seq, before or None, kind)], columns=["key", "seq", "before", "kind"])
            before = kind
        state.update((before, offended))

    return events.select("key", "seq", "kind").groupBy("key").applyInPandasWithState(follow, _OFFENCE, "before string, offended boolean", "append", GroupStateTimeout.NoTimeout)
