"""Removal of duplicates by two keys, exactly as a sequential pass would, in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.runtime import release, stage


def greedy_two_keys(df: DataFrame, order: Column, key: Column, fingerprint: Column) -> DataFrame:
    """Rows whose key, and whose non-empty fingerprint, no earlier accepted row has. A rejected row registers nothing.

    In each round the undecided rows that come first under both their keys are accepted, and those that share a key or
    fingerprint with an accepted row are rejected. The order must be unique. A null key stands for no key: such a row can
    only clash by its fingerprint. Minima per key combine on the map side, so a key shared by very many rows costs one
    aggregate; each round is staged in the shared folder.
    """
    first = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.concat(F.lit("o"), order.cast("string")))
    second = F.coalesce(F.concat(F.lit("f"), F.nullif(fingerprint.cast("string"), F.lit(""))), F.concat(F.lit("o"), order.cast("string")))
    keyed = stage(df.select(order.alias("__o"), first.alias("__k"), second.alias("__f")), "dedup-keys")
    todo, accepted = keyed, None
    while True:
        by_k = todo.groupBy("__k").agg(F.min("__o").alias("__mk"))
        by_f = todo.groupBy("__f").agg(F.min("__o").alias("__mf"))
        marked = todo.join(by_k, "__k").join(by_f, "__f")
        new = stage(marked.filter((F.col("__o") == F.col("__mk")) & (F.col("__o") == F.col("__mf"))).select("__o", "__k", "__f"), "dedup-accepted")
        accepted = new if accepted is None else accepted.unionByName(new)
        old, todo = todo, stage(todo.join(new.select("__k"), "__k", "left_anti").join(new.select("__f"), "__f", "left_anti"), "dedup-open")
        release(old)
        if todo.isEmpty():
            break
        if new.isEmpty():
            raise ValueError("rows stay undecided: the order is not unique")
    return df.withColumn("__o", order).join(accepted.select("__o"), "__o", "left_semi").drop("__o")


def first_per_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key; rows with a null key stay."""
    w = Window.partitionBy("__key").orderBy(*order)
    ranked = df.withColumn("__key", key).withColumn("__rn", F.when(F.col("__key").isNull(), 1).otherwise(F.row_number().over(w)))
    return ranked.filter("__rn = 1").drop("__key", "__rn")


def union_first_wins(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Bag union in which the row of the earlier part counts; ties by `order`."""
    from functools import reduce

    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(both, F.col(key), F.col("__part"), F.col(order)).drop("__part")
