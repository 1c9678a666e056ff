"""Orders, top-k and fair interleaving. Every order ends in a unique column, so results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, name: str, *order: Column, partition: Sequence[str] = ()) -> DataFrame:
    """1 .. n within the partition. Without one, use `top` where only the first rows are needed."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n of each key; Catalyst limits each partition before the shuffle."""
    return ranked(df, "__rn", *order, partition=keys).filter(F.col("__rn") <= n).drop("__rn")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hot_flag(df: DataFrame, name: str, n: int, *order: Column, key: str) -> DataFrame:
    """A flag on the first n rows; all rows stay. The first n are found by a top-k, not by one global window."""
    hottest = top(df, n, *order).select(F.col(key).alias("__hot"))
    return df.join(F.broadcast(hottest), F.col(key) == F.col("__hot"), "left").withColumn(name, F.col("__hot").isNotNull()).drop("__hot")


def round_robin(df: DataFrame, group: Sequence[Column], order: Column, within: Sequence[Column] = (), name: str = "turn") -> DataFrame:
    """Each row's turn among the rows of its group: ordering by (within, turn, order) interleaves the groups fairly."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within, *group).orderBy(order)))


def balanced(df: DataFrame, category: str, published: Column, now: Column, order: str) -> DataFrame:
    """(cohort, turn): categories take turns within a freshness cohort; sort by cohort, turn, order."""
    from feedloom.functions.dates import cohort

    return round_robin(df.withColumn("cohort", cohort(published, now)), [F.col(category)], F.col(order), [F.col("cohort")])


def spread(df: DataFrame, group: str, group_order: Column, order: Column, cap: int, n: int, *final: Column) -> DataFrame:
    """At most cap rows per group, taken in turns until n are chosen, then sorted anew."""
    turns = round_robin(df, [F.col(group)], order).filter(F.col("turn") <= cap)
    return turns.orderBy("turn", group_order, order).limit(n).orderBy(*final)


def capped_with_exempt(df: DataFrame, exempt: str, n: int, *order: Column) -> DataFrame:
    """Exempt rows always stay; others fill up to n in order."""
    free = df.filter(F.coalesce(F.col(exempt), F.lit(False)))
    rest = df.filter(~F.coalesce(F.col(exempt), F.lit(False)))
    return free.unionByName(rest.orderBy(*order).limit(max(0, n - free.count())))


def budgeted(df: DataFrame, budget: float, price: float, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(what the budget pays for, in order; the rest)."""
    n = int(budget / price + 1e-9) if price > 0 else 0
    paid = df.orderBy(*order).limit(n)
    return paid, df.exceptAll(paid)


def pooled_pick(items: DataFrame, pools: DataFrame, key: str, preference: str, candidate: str, seed: Column) -> DataFrame:
    """A stable choice per item among the candidates of the best preference: position hash(seed) mod their number."""
    from feedloom.functions.hashing import hash31

    best = pools.groupBy(key).agg(F.min(preference).alias("__best"))
    w = Window.partitionBy(key).orderBy(candidate)
    good = pools.join(best, key).filter(F.col(preference) == F.col("__best")).withColumn("__i", F.row_number().over(w) - 1)
    counts = good.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    chosen = items.join(counts, key, "left").withColumn("__i", F.when(F.col("__n") > 0, hash31(seed) % F.col("__n")))
    return chosen.join(good.select(key, "__i", candidate), [key, "__i"], "left").drop("__i", "__n")
