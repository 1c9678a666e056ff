"""Maintenance of stored tables: upserts, better versions, reconciliation, pruning, and how they are written."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class EmptyRun(ValueError):
    """A run without rows must not replace what is stored."""


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], *, now: Column, first_seen: str = "first_seen_at", synced: str | None = None, order: Column | None = None) -> DataFrame:
    """Incoming rows replace stored ones of the same key; first_seen stays from the first insert.

    Repeating an upsert changes nothing but `synced`. Of several incoming rows of a key the last by `order` counts.
    """
    new = incoming
    if order is not None:
        w = Window.partitionBy(*key).orderBy(order.desc())
        new = new.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    values = [c for c in new.columns if c not in (*key, first_seen, synced)]
    old = stored.select(*key, *[F.col(c).alias(f"__old_{c}") for c in stored.columns if c not in key], F.lit(True).alias("__was"))
    both = new.withColumn("__is", F.lit(True)).join(old, list(key), "full_outer")
    keep = lambda c: F.when(F.col("__is"), F.col(c)).otherwise(F.col(f"__old_{c}")) if f"__old_{c}" in both.columns else F.col(c)
    out = both.select(*key, *[keep(c).alias(c) for c in values], F.coalesce(f"__old_{first_seen}", now).alias(first_seen), *([F.when(F.col("__is"), now).otherwise(F.col(f"__old_{synced}")).alias(synced)] if synced else []))
    return out


def upsert_counts(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """(matched, inserted) keys."""
    known = stored.select(*key, F.lit(1).alias("__was")).dropDuplicates(list(key))
    return incoming.select(*key).distinct().join(known, list(key), "left").agg(F.count("__was").alias("matched"), (F.count(F.lit(1)) - F.count("__was")).alias("inserted"))


def better_version(stored: DataFrame, incoming: DataFrame, key: str, status: str = "status", count: str = "count") -> DataFrame:
    """Per key the better of two versions: a good status beats any other, then a count at least as large wins."""
    columns = [c for c in stored.columns if c != key]
    a = stored.select(key, F.struct(*columns).alias("__a"))
    b = incoming.select(key, F.struct(*columns).alias("__b"))
    good = lambda x: F.coalesce(x[status] == "ok", F.lit(False))
    A, B = F.col("__a"), F.col("__b")
    wins = B.isNotNull() & (A.isNull() | (good(B) & ~good(A)) | ((good(B) == good(A)) & (F.coalesce(B[count], F.lit(0)) >= F.coalesce(A[count], F.lit(0)))))
    return a.join(b, key, "full_outer").select(key, F.when(wins, B).otherwise(A).alias("v")).select(key, "v.*")


def replace_scopes(stored: DataFrame, incoming: DataFrame, scope: str) -> DataFrame:
    """Scopes that came in are replaced whole, others stay."""
    return stored.join(incoming.select(scope).distinct(), scope, "left_anti").unionByName(incoming, allowMissingColumns=True)


def live_over_stored(stored: DataFrame, live: DataFrame, key: str, order: str) -> DataFrame:
    """Live rows win by key; a row keeps the place of its key's first appearance."""
    both = stored.withColumn("__p", F.lit(0)).unionByName(live.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key)
    placed = both.withColumn("place", F.min(F.struct("__p", order)).over(w)).withColumn("__rn", F.row_number().over(w.orderBy(F.desc("__p"), F.desc(order))))
    return placed.filter("__rn = 1").drop("__p", "__rn")


def departed(archived: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Archived keys that are no longer live. Refuses an empty live set, which would purge everything."""
    if live.isEmpty():
        raise EmptyRun("the live set is empty")
    return archived.join(live.select(key).distinct(), key, "left_anti")


def erased(tables: dict[str, DataFrame], column: str, value: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without one user's rows, and (table, erased) counts. Refuses a blank value."""
    if not (value or "").strip():
        raise ValueError("no user named")
    from functools import reduce

    mine = lambda: F.coalesce(F.col(column).cast("string") == value, F.lit(False))
    counts = [t.agg(F.count_if(mine()).alias("erased")).select(F.lit(n).alias("table"), "erased") for n, t in tables.items()]
    return {n: t.filter(~mine()) for n, t in tables.items()}, reduce(lambda a, b: a.unionByName(b), counts)


def pruned(cache: DataFrame, live: DataFrame, key: str, stored_at: Column, now: Column, days: int = 10, only_above: int | None = None) -> DataFrame:
    """Rows that are live or not older than so many days; with only_above, everything stays up to that many rows."""
    marked = cache.join(live.select(key).distinct().withColumn("__live", F.lit(True)), key, "left")
    keep = F.col("__live").isNotNull() | (stored_at >= now - F.make_dt_interval(F.lit(days)))
    if only_above is not None:
        total = cache.agg(F.count(F.lit(1)).alias("n"))
        return marked.filter((total.scalar() <= only_above) | F.col("__live").isNotNull()).drop("__live")
    return marked.filter(keep).drop("__live")


def overlay(df: DataFrame, cache: DataFrame, key: str, fields: Sequence[str], prefer: str = "own") -> DataFrame:
    """Fields filled from a side table: own values first, or the cache's first."""
    side = cache.select(key, *[F.col(f).alias(f"__c_{f}") for f in fields]).dropDuplicates([key])
    joined = df.join(side, key, "left")
    for f in fields:
        own, other = F.nullif(F.col(f), F.lit("")), F.nullif(F.col(f"__c_{f}"), F.lit(""))
        joined = joined.withColumn(f, F.coalesce(own, other) if prefer == "own" else F.coalesce(other, own)).drop(f"__c_{f}")
    return joined


def pending(df: DataFrame, cache: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows that the cache does not know: a run's work."""
    return df.join(cache.select(key).distinct(), key, "left_anti").orderBy(*order).limit(n)


def toggled(saved: DataFrame, toggles: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """A batch of save toggles: an odd number flips a key, and the last toggle's row is what is saved."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    count = Window.partitionBy(*key)
    flips = toggles.withColumn("__n", F.count(F.lit(1)).over(count)).withColumn("__rn", F.row_number().over(last)).filter("__rn = 1 and __n % 2 = 1").drop("__n", "__rn")
    kept = saved.join(flips.select(*key), list(key), "left_anti")
    added = flips.drop(order).join(saved.select(*key), list(key), "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def daily_readings(facts: DataFrame, key: str, date: Column, value: str, order: Column) -> DataFrame:
    """(key, date, value): the last reading of a day counts."""
    return facts.groupBy(key, date.alias("date")).agg(F.max_by(value, order).alias(value))


# --- writing ---------------------------------------------------------------------------------------------------------------

#: Keys under which stored tables are unique: what indexes are elsewhere. They choose join and bucket columns here.
MERGE_KEYS = {
    "papers": ("key",), "paper_citations": ("key", "date"), "briefings": ("date",), "articles": ("id",), "subscribers": ("email",), "users": ("user_id",),
    "saved": ("user_id", "article_id"), "reads": ("user_id", "article_id"), "quiz": ("user_id", "quiz_id"), "flashcards": ("user_id", "card_id"),
}


def write_partitions(df: DataFrame, path: str, by: str, keep_if_empty: bool = True, whole: bool = False) -> None:
    """Overwrite only the partitions that df has rows of; an empty run leaves everything as it is.

    whole: df is the full table, so partitions that it has no rows of are removed, after the others are written.
    """
    if keep_if_empty and df.isEmpty():
        raise EmptyRun(path)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if whole:
        spark = df.sparkSession
        named = {str(r[0]) for r in df.select(by).distinct().collect()}  # as many as there are partitions
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for x in fs.listStatus(p):
            folder = x.getPath().getName()
            if folder.startswith(f"{by}=") and unquote(folder[len(by) + 1 :]) not in named:
                fs.delete(x.getPath(), True)


def key_violations(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table, repeated): how many keys each table has more than once; what a unique index would refuse."""
    from functools import reduce

    counts = [
        t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("repeated")).select(F.lit(name).alias("table"), "repeated")
        for name, (t, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def snapshot_index(df: DataFrame, scope: str, status: str, refreshed: str) -> DataFrame:
    """The metadata of a partitioned snapshot: rows, status and time of each scope."""
    return df.groupBy(scope).agg(F.count(F.lit(1)).alias("count"), F.min(status).alias("status"), F.max(refreshed).alias("refreshed_at"))


def keep_latest(names: DataFrame, column: str, n: int) -> DataFrame:
    """The n last dated artefacts by name."""
    return names.orderBy(F.desc(column)).limit(n)


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write next to the old table, then take its place: readers never see half a table.

    The place is taken by two renames, between which there is no table; `publish` has no such moment.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    new, old = p.suffix(".new"), p.suffix(".old")
    for x in (new, old):
        fs.delete(x, True)
    df.write.parquet(new.toString())
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(new, p)
    fs.delete(old, True)


def publish(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write a new version next to the old ones, then name it in a pointer file, whose replacement is one rename.

    Readers (`published`) see the old version whole or the new one whole, whatever fails in between. The version before the
    last is removed, so a reader that just began can end.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(p) if x.getPath().getName().startswith("v")) if fs.exists(p) else []
    new = (versions[-1] if versions else 0) + 1
    df.write.parquet(f"{path}/v{new}")
    pointer, waiting = jvm.org.apache.hadoop.fs.Path(path, "current"), jvm.org.apache.hadoop.fs.Path(path, f"current.{new}")
    out = fs.create(waiting, True)
    out.write(bytearray(str(new), "ascii"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(waiting, pointer, options)
    for v in versions[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"v{v}"), True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by `publish`."""
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/v{version}")
