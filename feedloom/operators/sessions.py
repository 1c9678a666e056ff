"""Sessions, streaks, levels, funnels and limits over event logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from feedloom.functions.dates import seconds_between


def numbered_sessions(events: DataFrame, user: str, ts: str, gap_seconds: int = 1800, tie: str | None = None) -> DataFrame:
    """events with session (1 .. n per user): a new one starts after more than gap_seconds without an event."""
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(user).orderBy(*order)
    idle = seconds_between(F.col(ts), F.lag(ts).over(w))
    return events.withColumn("idle", idle).withColumn("session", F.sum(F.when(F.col("idle") <= gap_seconds, 0).otherwise(1)).over(w))


def sessions(events: DataFrame, user: str, ts: str, gap_seconds: int = 1800, cap_seconds: int = 300, tie: str | None = None) -> DataFrame:
    """(user, session, started_at, ended_at, events, active_seconds): gaps count as active up to cap_seconds each."""
    active = F.when(F.col("idle") <= gap_seconds, F.least(F.col("idle"), F.lit(float(cap_seconds)))).otherwise(0.0)
    numbered = numbered_sessions(events, user, ts, gap_seconds, tie)
    return numbered.groupBy(user, "session").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("events"), F.sum(active.cast("decimal(18,6)")).cast("double").alias("active_seconds")
    )


def session_minutes(done: DataFrame, active: str = "active_seconds") -> DataFrame:
    """One row per completed active minute of a session."""
    n = F.floor(F.col(active) / 60).cast("int")
    return done.filter(n > 0).withColumn("minute", F.explode(F.sequence(F.lit(1), n)))


def bounded(events: DataFrame, per: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n events of each key, as a bounded buffer keeps them."""
    return events.withColumn("__rn", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def ratio(events: DataFrame, numerator: Column, denominator: Column, by: Sequence[str] = ()) -> DataFrame:
    counted = events.groupBy(*by).agg(F.count_if(numerator).alias("hits"), F.count_if(denominator).alias("base"))
    return counted.withColumn("ratio", F.col("hits") / F.nullif(F.col("base"), F.lit(0)))


def funnel(events: DataFrame, key: Sequence[str], ts: str, steps: Sequence[Column]) -> DataFrame:
    """(step, reached): keys that did the steps in order, each at or after the step before.

    A step's instant is the least that is not before the last step's: an aggregate that combines on the map side, so a
    key with very many events is never collected.
    """
    marked = events.select(*key, F.col(ts).alias("__ts"), *[s.alias(f"__s{i}") for i, s in enumerate(steps)])
    before, out = None, None
    for i in range(len(steps)):
        these = marked.filter(f"__s{i}").select(*key, "__ts")
        if before is not None:
            these = these.join(before, list(key)).filter(F.col("__ts") >= F.col("__t"))
        before = these.groupBy(*key).agg(F.min("__ts").alias("__t"))
        count = before.agg(F.count(F.lit(1)).alias("reached")).select(F.lit(i + 1).alias("step"), "reached")
        out = count if out is None else out.unionByName(count)
    return out


def streaks(events: DataFrame, user: str, day: Column) -> DataFrame:
    """(user, active_days, longest_streak, last_streak, last_day) of consecutive days; several events of a day count once."""
    days = events.select(user, day.alias("__d")).filter("__d is not null").distinct()
    island = F.date_sub("__d", F.row_number().over(Window.partitionBy(user).orderBy("__d")))
    runs = days.withColumn("__i", island).groupBy(user, "__i").agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("last"))
    return runs.groupBy(user).agg(F.sum("n").alias("active_days"), F.max("n").alias("longest_streak"), F.max_by("n", "last").alias("last_streak"), F.max("last").alias("last_day"))


def first_opens(events: DataFrame, user: str, item: str, ts: str, opened: Column, tie: str) -> DataFrame:
    """The first opening of each item by each user; later ones earn nothing."""
    return events.filter(opened).withColumn("__rn", F.row_number().over(Window.partitionBy(user, item).orderBy(ts, tie))).filter("__rn = 1").drop("__rn")


def level_linear(xp: Column, each: int = 500) -> Column:
    return F.floor(xp / each) + 1


def level_curve(xp: Column, scale: float = 50) -> Column:
    """The largest n with floor(scale * n^1.5) <= xp, at least 1: a root, corrected by one step either way."""
    guess = F.floor(F.pow((F.greatest(xp, F.lit(0)) + 1) / scale, F.lit(2 / 3)))
    need = lambda n: F.floor(scale * F.pow(n, F.lit(1.5)))
    n = F.when(need(guess + 1) <= xp, guess + 1).when(need(guess) <= xp, guess).otherwise(guess - 1)
    return F.greatest(F.lit(1), n).cast("int")


def level_title(level: Column, titles: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, titles)), F.greatest(F.lit(1), F.least(level.cast("int"), F.lit(len(titles)))))


def goal_share(opened: Column, goal: int = 5) -> Column:
    return F.least(F.lit(100), F.floor(100 * opened / goal + 0.5)).cast("int")


def anchored_windows(requests: DataFrame, client: str, ts: str, limit: int = 20, seconds: int = 60, tie: str | None = None) -> DataFrame:
    """requests with window_start and allowed: at most `limit` per window; a window starts at the first request after the last one ended.

    The anchors depend on the data, so this is a fold in order. Requests are sliced where a pause of at least one window
    separates them: there every window has ended, whatever came before, so slices are independent, and a busy client's log
    is folded in parallel. A slice is read in order, batch by batch, with nothing but the last window in memory, so a slice
    of any length costs one pass. Rows without an instant are in no window and are left out.
    """
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(client).orderBy(*order)
    pause = F.coalesce(seconds_between(F.col(ts), F.lag(ts).over(w)) >= seconds, F.lit(True))
    sliced = requests.filter(F.col(ts).isNotNull()).withColumn("__slice", F.sum(pause.cast("int")).over(w)).withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")))
    whole = sliced.withColumn("__key", F.xxhash64(client, "__slice"))
    ordered = whole.repartition("__key").sortWithinPartitions("__key", F.col(client), "__slice", "__at", *order[1:])
    names, span = requests.columns, seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, count = None, 0, 0
        for batch in batches:
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("__key", "__slice")]
            at = batch.column("__at").to_numpy(zero_copy_only=False)
            starts, nth = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            edges = [0, *(np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                this = (key[0][a], key[1][a])
                if this != last:
                    last, start, count = this, at[a], 0
                while a < b:  # one step per window, not per request
                    end = a + int(np.searchsorted(at[a:b], start + span))
                    starts[a:end], nth[a:end] = start, np.arange(count + 1, count + 1 + end - a)
                    count += end - a
                    a = end
                    if a < b:
                        start, count = at[a], 0
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(starts), pa.array(nth <= limit)], names=[*names, "window_start", "allowed"])

    schema = StructType([*requests.schema.fields, StructField("window_start", LongType()), StructField("allowed", BooleanType())])
    return ordered.mapInArrow(fold, schema)
