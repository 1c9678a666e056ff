"""Counts, shares and strongest values. Aggregates combine on the map side; orders are total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(df: DataFrame, by: Column, order: Column, name: str = "value") -> DataFrame:
    """(value, count, first): counts with the first appearance, which breaks ties."""
    return df.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("first"))


def keyword_tally(df: DataFrame, array: str, order: Column, n: int | None = 100) -> DataFrame:
    """The n most frequent elements; 0, None or nonsense mean 100."""
    t = tally(df.select(F.explode(array).alias("__w"), order.alias("__o")), F.col("__w"), F.col("__o"), "keyword")
    return t.orderBy(F.desc("count"), "first", "keyword").limit(n if isinstance(n, int) and n > 0 else 100)


def with_dimension(counts: DataFrame, key: str, dimension: DataFrame, dimension_key: str, label: str) -> DataFrame:
    """Left join that keeps the key where the dimension does not know it."""
    d = dimension.select(F.col(dimension_key).alias("__k"), F.col(label).alias("__l"))
    return counts.join(d, F.col(key) == F.col("__k"), "left").withColumn("label", F.coalesce("__l", key)).drop("__k", "__l")


def strongest(df: DataFrame, key: Sequence[str], order: Column, *, largest: Sequence[str] = (), first: Sequence[str] = (), last: Sequence[str] = (), longest: Sequence[str] = (), collected: Sequence[str] = ()) -> DataFrame:
    """One row per key: largest values, first and last non-empty ones, longest texts (the first on ties), distinct values in order."""
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()
    aggs = [F.max(c).alias(c) for c in largest]
    aggs += [F.min_by(c, F.when(some(c), order)).alias(c) for c in first] + [F.max_by(c, F.when(some(c), order)).alias(c) for c in last]
    aggs += [F.min_by(c, F.struct(-F.length(F.coalesce(c, F.lit(""))), order)).alias(c) for c in longest]
    # Distinct first: what is collected is bounded by the different values, not by the rows.
    for c in collected:
        firsts = Window.partitionBy(*key, c)
        df = df.withColumn(f"__f_{c}", F.min(order).over(firsts))
        aggs.append(_field(F.array_sort(F.collect_set(F.when(some(c), F.struct(f"__f_{c}", c)))), c).alias(c))
    return df.groupBy(*key).agg(*aggs)


def _field(structs: Column, name: str) -> Column:
    return F.transform(structs, lambda x: x[name])


def best_version(df: DataFrame, key: Sequence[str], better: Column, order: Column) -> DataFrame:
    """The row of the highest `better` per key, the first on ties."""
    w = Window.partitionBy(*key).orderBy(better.desc_nulls_last(), order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def newest_from_canonical(df: DataFrame, family: str, created: Column, canonical: Column, order: Column) -> DataFrame:
    """Per family the newest row, the first on ties, among those from the canonical one on; all rows if there is none."""
    w = Window.partitionBy(family)
    start = F.min(F.when(canonical, order)).over(w)
    later = df.withColumn("__start", start).filter(F.col("__start").isNull() | (order >= F.col("__start")))
    return best_version(later, [family], created, order).drop("__start")


def weekday_points(df: DataFrame, user: str, ts: Column, opened: Column, opened_points: int = 8, seen_points: int = 2) -> DataFrame:
    """(user, weekday from Monday = 0, points)."""
    points = F.sum(F.when(opened, opened_points).otherwise(seen_points))
    return df.groupBy(user, F.weekday(ts).alias("weekday")).agg(points.alias("points"))


def share_of_max(counts: DataFrame, user: str, n: int, count: str = "count", tie: str = "value") -> DataFrame:
    """The n largest counts of each user with their percentage of the largest."""
    w = Window.partitionBy(user)
    out = counts.withColumn("pct", F.floor(100 * F.col(count) / F.max(count).over(w) + 0.5).cast("int"))
    return out.withColumn("__rn", F.row_number().over(w.orderBy(F.desc(count), tie))).filter(F.col("__rn") <= n).drop("__rn")


def weighted_availability(df: DataFrame, by: Sequence[str], then: Column, now: Column, hours: float = 24, half_life: float = 12) -> DataFrame:
    """Per group, the rows of the last hours, each counting half as much after every half-life."""
    from feedloom.functions.dates import seconds_between

    age = seconds_between(now, then) / 3600
    recent = df.withColumn("__age", age).filter(F.col("__age").between(0, hours))
    # Decimal sums don't depend on the order of partitions.
    return recent.groupBy(*by).agg(F.sum(F.pow(F.lit(0.5), F.col("__age") / half_life).cast("decimal(20,12)")).cast("double").alias("availability"), F.count(F.lit(1)).alias("n"))


def caught_up(df: DataFrame, seen: Column, opened: Column, available: Column, opened_categories: Column, categories: Column) -> Column:
    """Coverage .55, depth .30 (from 3 seen rows on), breadth .15, in percent; null where nothing was available."""
    coverage = F.least(F.lit(1.0), seen / available)
    depth = F.when(seen >= 3, F.least(F.lit(1.0), opened / F.greatest(seen, F.lit(1)))).otherwise(0.0)
    breadth = F.least(F.lit(1.0), opened_categories / F.greatest(categories, F.lit(1)))
    return F.when(available > 0, F.floor(100 * (0.55 * coverage + 0.30 * depth + 0.15 * breadth) + 0.5).cast("int"))
