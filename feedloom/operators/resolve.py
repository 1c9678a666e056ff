"""Entity resolution of provider records under two keys, with field-wise merging, in the order in which they arrive."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.components import components


def assign(records: Iterable[tuple[str | None, str | None]]) -> list[int]:
    """The position each record is merged into: the first key that is known decides; the other becomes an alias if free."""
    index: dict[str, int] = {}
    out: list[int] = []
    n = 0
    for keys in records:
        own = [k for k in keys if k]
        at = next((index[k] for k in own if k in index), None)
        if at is None:
            at, n = n, n + 1
        for k in own:
            index.setdefault(k, at)
        out.append(at)
    return out


def resolve(df: DataFrame, scope: str, order: str, first_key: str, second_key: str) -> DataFrame:
    """df with `entity`, unique in the scope: records merge greedily, never two existing entities.

    The greedy rule only ever looks at records that keys connect, so each connected component is resolved by itself and in
    order; components come from a distributed contraction and are small unless the keys say otherwise. `order` must be
    unique within the scope. A record without keys is an entity of its own.
    """
    keyed = df.withColumn("__n", F.concat_ws("\u0001", F.lit("r"), F.col(scope), F.col(order).cast("string")))
    keys = lambda c, t: F.when(F.col(c).isNotNull(), F.concat_ws("\u0001", F.lit(t), F.col(scope), F.col(c)))
    edges = keyed.select("__n", F.explode(F.array_compact(F.array(keys(first_key, "a"), keys(second_key, "b")))).alias("__k")).select(F.col("__n").alias("a"), F.col("__k").alias("b"))
    # A key of a single record connects nothing.
    edges = edges.join(edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("b"), "b", "left_semi").select("a", "b")
    of = components(edges)
    joined = keyed.join(of.withColumnRenamed("node", "__n"), "__n", "left").withColumn("__c", F.coalesce("component", "__n"))
    # A record that no key connects to another is its own entity; only the others go to Python.
    shared = of.groupBy("component").agg(F.count_if(F.col("node").startswith("r\u0001")).alias("__m")).filter("__m > 1")
    need = joined.join(shared.select(F.col("component").alias("__c")), "__c", "left_semi").select("__c", "__n", F.col(order).alias("__order"), F.col(first_key).alias("__a"), F.col(second_key).alias("__b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__order")
        at = assign((a if isinstance(a, str) else None, b if isinstance(b, str) else None) for a, b in zip(pdf["__a"], pdf["__b"]))
        firsts: dict[int, str] = {}
        for p, n in zip(at, pdf["__n"]):
            firsts.setdefault(p, n)
        return pd.DataFrame({"__n": pdf["__n"], "entity": [firsts[p] for p in at]})

    entity = need.groupBy("__c").applyInPandas(run, "__n string, entity string")
    return keyed.join(entity, "__n", "left").withColumn("entity", F.coalesce("entity", "__n")).drop("__n")


def merged(df: DataFrame, entity: str, order: str) -> DataFrame:
    """One row per entity: the first record's identity, each other field's best value, providers in order of appearance."""
    o = F.col(order)
    first = lambda c: F.min_by(c, F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), o)).alias(c)
    verified = F.when(F.col("rights_status") == "verified_open_access", o)
    providers = F.transform(F.array_sort(F.collect_set(F.struct("__first", "provider"))), lambda x: x["provider"])
    seen = df.withColumn("__first", F.min(o).over(Window.partitionBy(entity, "provider")))
    return seen.groupBy(entity).agg(
        F.min_by("id", o).alias("id"), F.min_by("title", o).alias("title"), F.min_by("link", o).alias("link"), F.max(F.greatest(F.coalesce("citations", F.lit(0)), F.lit(0))).alias("citations"),
        first("published"), first("published_year"), F.min_by("summary", F.struct(-F.length(F.coalesce("summary", F.lit(""))), o)).alias("summary"), first("venue"), first("publisher"),
        first("open_access_pdf"), F.coalesce(F.min_by("rights_status", verified), F.min_by("rights_status", o)).alias("rights_status"), providers.alias("providers"),
    )
