"""Dated series: spines, sparklines, deltas, growth and values as of a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(spark, end: str, days: int) -> DataFrame:
    return spark.sql(f"select explode(sequence(date_sub(date'{end}', {days - 1}), date'{end}')) as date")


def series(readings: DataFrame, key: str, date: str, value: str, dates: DataFrame) -> DataFrame:
    """(key, series): the values of the dates that have one, in order of the date. A spine bounds the length."""
    inside = readings.join(F.broadcast(dates.select(F.col("date").alias(date))), date)
    return inside.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(date, value))), lambda x: x[value]).alias("series"))


def sparkline(values: Column, current: Column) -> Column:
    """Values scaled to 0 .. 1 by their least and largest, the current one included; .5 for a flat line; two points at least."""
    points = F.when(F.size(values) >= 2, values).otherwise(F.array(current, current))
    both = F.array_append(values, current)
    lo, hi = F.array_min(both), F.array_max(both)
    return F.transform(points, lambda v: F.when(hi > lo, F.floor((v - lo) / (hi - lo) * 1e4 + 0.5) / 1e4).otherwise(0.5))


def delta(values: Column, current: Column) -> Column:
    """Current minus the first value, to a tenth; 0 without one."""
    return F.floor((current - F.coalesce(F.get(values, 0), current)) * 10 + 0.5) / 10


def growth(readings: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """readings with the change since the reading before."""
    return readings.withColumn("growth", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(date)))


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the last `value` of right at or before left_ts: one union and one window, no range join."""
    tagged = left.withColumn("__ts", F.col(left_ts)).withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(dict(right.dtypes)[value]))
    facts = right.select(key, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), value)
    w = Window.partitionBy(key).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(facts, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__side = 1").drop("__ts", "__side")


def lens_board(models: DataFrame, boards: DataFrame, model: str, lens: str, score: str, rank: str, lenses: Sequence[str]) -> DataFrame:
    """models with one column per lens: the model's first row on that board, else its own score."""
    first = boards.groupBy(model, lens).agg(F.min_by(score, rank).alias("__s"))
    wide = first.groupBy(model).pivot(lens, list(lenses)).agg(F.first("__s"))
    joined = models.join(wide, model, "left")
    for name in lenses:
        joined = joined.withColumn(name, F.coalesce(name, score))
    return joined
