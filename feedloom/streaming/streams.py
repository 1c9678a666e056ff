"""Structured Streaming variants: sessions by event time, upserts by micro-batch, and a rate limiter with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, started_at, ended_at, events) per session; works on streams and on tables. ended_at is the last event plus the gap."""
    watermarked = events.withWatermark(ts, late) if events.isStreaming else events
    return (
        watermarked.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
        .select(user, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")
    )


def upsert_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: Sequence[str], order: str, now: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a table. Replaying a batch changes nothing, so it is effectively once."""
    from feedloom.operators.merges import upsert

    def run(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            write(upsert(read(), batch, key, now=F.lit(now).cast("timestamp_ntz"), order=F.col(order)))

    return run


def limited(requests: DataFrame, client: str, ts: str, limit: int = 20, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(client, ts, allowed) of a stream: at most `limit` requests per window, which starts at the first request after the last one ended.

    Windows and their state go by event time: a client's window is forgotten when the watermark, `late` behind the newest
    request, has passed its end, so a stall of the query forgets nothing. Within a micro-batch a client's requests are put in
    order before they are counted; one that is older than its window counts in that window. State per client: the window's
    start and its count.
    """
    schema = requests.schema
    out = f"`{client}` {schema[client].dataType.simpleString()}, `{ts}` {schema[ts].dataType.simpleString()}, allowed boolean"
    span = seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        all_ = pd.concat([*batches]).sort_values(ts)
        allowed = []
        for t in all_[ts]:
            micros = int(pd.Timestamp(t).value // 1000)
            if start is None or micros - start >= span:
                start, count = micros, 0
            count += 1
            allowed.append(count <= limit)
        state.update((start, count))
        end = (start + span) // 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({client: all_[client], ts: all_[ts], "allowed": allowed})

    return requests.withWatermark(ts, late).groupBy(client).applyInPandasWithState(run, out, "start bigint, count bigint", "append", GroupStateTimeout.EventTimeTimeout)


def published(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str, order: str) -> Callable[[DataFrame, int], bool]:
    """A foreachBatch function that unites each batch with what is published and publishes again only if that changed it.

    The new row wins by key. Whether anything changed is told by two aggregates, not by comparing rows.
    """
    from feedloom.operators.dedup import union_first_wins

    def digest(df: DataFrame) -> tuple:
        h = F.xxhash64(*sorted(df.columns))
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())

    def run(batch: DataFrame, epoch: int) -> bool:
        before = read()
        new = batch if before is None else union_first_wins([batch, before.select(batch.columns)], key, order)
        if batch.isEmpty() or (before is not None and digest(new) == digest(before)):
            return False
        write(new)
        return True

    return run


def bounded_cache(entries: DataFrame, key: str, at: str, now: Column, seconds: int = 3600, most: int = 100) -> DataFrame:
    """What a cache of `most` entries with a time to live holds: the newest entry of each key, expired ones out, first in first out."""
    newest = entries.groupBy(key).agg(F.max(at).alias(at))
    alive = newest.filter(F.col(at) > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))
    return alive.orderBy(F.desc(at), key).limit(most)
