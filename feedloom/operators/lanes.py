"""Feeds put together from several sources: tagged searches, upgraded unions, ranked pools, and the choice of a lane."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.ranking import ranked, top


def tagged_search(works: DataFrame, specs: DataFrame, *, matches: Column, published: str, order: dict[str, Sequence[Column]], categories: str, now: Column, id: str) -> DataFrame:
    """The first rows of each query: specs (query, tag, sort, days, n) joined to the works that `matches` holds for.

    Only works of the last `days` take part; `order` gives the columns of each sort. The tag comes first among the
    categories and is the section. specs is a small table of queries; works are scanned once and limited per query before
    the shuffle.
    """
    within = F.col(published) >= now - F.make_dt_interval(F.col("days"))
    found = works.join(F.broadcast(specs.limit(MOST_QUERIES)), matches & within)
    out = None
    for sort, columns in order.items():
        w = Window.partitionBy("query").orderBy(*columns, F.col(id))
        part = found.filter(F.col("sort") == sort).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.col("n"))
        out = part if out is None else out.unionByName(part)
    tagged = F.concat(F.array("tag"), F.coalesce(F.col(categories), F.array().cast("array<string>")))
    return out.withColumn(categories, tagged).withColumn("section", F.col("tag")).withColumn("topical", F.lit(True))


#: The number of queries of one tagged search: what is broadcast never grows beyond it.
MOST_QUERIES = 10_000


def union_upgraded(parts: Sequence[DataFrame], key: str, order: str, flag: str, upgraded: Sequence[str]) -> DataFrame:
    """Bag union by key: the first part's row counts, but its flag and the `upgraded` columns come from the first flagged row.

    Only a row that is not flagged itself is upgraded. Ties within a part go by `order`.
    """
    tagged = None
    for i, p in enumerate(parts):
        one = p.withColumn("__part", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    others = [c for c in tagged.columns if c not in (key, "__part")]
    place = F.struct("__part", order)
    flagged = F.coalesce(F.col(flag), F.lit(False))
    both = tagged.groupBy(key).agg(F.min_by(F.struct(*others), place).alias("a"), F.min_by(F.struct(*others), F.when(flagged, place)).alias("b"))
    better = F.col("b").isNotNull() & ~F.coalesce(F.col(f"a.{flag}"), F.lit(False))
    values = [F.when(better, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) if c in (flag, *upgraded) else F.col(f"a.{c}").alias(c) for c in others]
    return both.select(key, *values)


def pool_size(limit: int, pool: int | None = None) -> int:
    """How many records a source is asked for: 40 to 50."""
    return min(50, max(pool or limit, 40))


def status_of(counts: DataFrame, provider: str, failed: Sequence[str] = ()) -> DataFrame:
    """(provider, count, status): status is partial if one of the sources failed; a source without rows is left out."""
    status = "partial" if failed else "ok"
    return counts.groupBy(provider).agg(F.count(F.lit(1)).alias("count")).withColumn("status", F.lit(status))


def first_lane(lanes: Sequence[DataFrame], key: str) -> DataFrame:
    """Per key the rows of the first lane that has any: a snapshot before the live sources, for each topic by itself.

    Nothing is collected: a key's lane is the least number among its rows.
    """
    both = None
    for i, lane in enumerate(lanes):
        one = lane.withColumn("lane", F.lit(i))
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    return both.withColumn("__least", F.min("lane").over(Window.partitionBy(key))).filter("lane = __least").drop("__least")


def assembled(df: DataFrame, *, filters: Sequence[Column] = (), order: Sequence[Column] = (), limit: int | None = None, per: Sequence[str] = ()) -> DataFrame:
    """Projected records filtered, then put in order, and only then limited, overall or per key."""
    out = df
    for f in filters:
        out = out.filter(F.coalesce(f, F.lit(False)))
    if limit is None:
        return out.orderBy(*order) if order else out
    if per:
        return ranked(out, "__place", *order, partition=list(per)).filter(F.col("__place") <= limit).drop("__place")
    return top(out, limit, *order)


def world_feed(strict: DataFrame, others: DataFrame, resolve, score: Column, *, topic: str, limit: int, pool: int | None = None, order: Sequence[Column]) -> DataFrame:
    """The ranked feed of each topic: the strict source's newest records, pooled, before the others; merged, scored, ranked.

    resolve(df): one row per work of the union, in which `source_order` is 0 for the strict source and 1 for the others.
    """
    newest = ranked(strict, "__place", F.desc_nulls_last("published_at"), F.col("id"), partition=[topic])
    pooled = newest.filter(F.col("__place") <= pool_size(limit, pool)).drop("__place").withColumn("source_order", F.lit(0))
    works = resolve(pooled.unionByName(others.withColumn("source_order", F.lit(1)), allowMissingColumns=True))
    placed = ranked(works.withColumn("score", score), "rank", *order, partition=[topic])
    return placed.filter(F.col("rank") <= limit)


def daily_goals(days: DataFrame, seen: Column, opened: Column, available: Column) -> DataFrame:
    """days with `goal`: met by a coverage of .95, or of .6 with something opened; null on a day without anything to read."""
    coverage = seen / available
    met = (coverage >= 0.95) | ((coverage >= 0.6) & (opened >= 1))
    return days.withColumn("goal", F.when(available > 0, met))


#: Points of a reading day.
POINTS = {"seen": 2, "opened": 8, "finished": 15, "goal": 25}


def day_points(seen: Column, opened: Column, finished: Column, goal: Column) -> Column:
    return seen * POINTS["seen"] + opened * POINTS["opened"] + finished * POINTS["finished"] + F.when(goal, POINTS["goal"]).otherwise(0)


def sticky_best(df: DataFrame, key: Sequence[str], entitled: Column, order: Column) -> DataFrame:
    """Per key the first entitled row, or the first of all if none is entitled: a later row replaces only an unentitled one."""
    w = Window.partitionBy(*key).orderBy(F.coalesce(entitled, F.lit(False)).desc(), order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
