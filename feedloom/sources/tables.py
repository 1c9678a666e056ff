"""Reading stored tables. What is missing or broken reads as empty, never as an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def json_table(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """JSON files under an explicit schema. Missing paths and unreadable records yield no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(paths)
    except AnalysisException:
        return _empty(spark, schema)


def parquet_table(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """A table with pushed-down columns and predicate; empty if it does not exist."""
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        df = _empty(spark, schema)
    df = df.filter(where) if where is not None else df
    return df.select(*columns) if columns else df


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A full table read in ranges of a numeric key, in place of page after page."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
    return reader.option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).options(**options).load()


def partition(df: DataFrame, scope: str, value: str) -> DataFrame:
    """One partition of a partitioned table; other folders are not listed."""
    return df.filter(F.col(scope) == value)


def first_non_empty(candidates: DataFrame, key: str, priority: str, payload: str) -> DataFrame:
    """Per key the payload of the first priority that has one: a chain of fallbacks."""
    some = F.nullif(F.col(payload).cast("string"), F.lit("")).isNotNull()
    return candidates.groupBy(key).agg(F.min_by(payload, F.when(some, F.col(priority))).alias(payload), F.min(F.when(some, F.col(priority))).alias(priority))


def unless_stale(snapshot: DataFrame, generated_at: Column, now: Column, days: float = 3) -> DataFrame:
    """The snapshot if it is not older than so many days, else no rows."""
    from feedloom.functions.dates import seconds_between

    return snapshot.filter(F.coalesce(seconds_between(now, generated_at) <= days * 86400, F.lit(False)))


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table if it has rows, else the second: snapshot before live source."""
    return second if first.isEmpty() else first


def date_spine(spark: SparkSession, boards: Sequence[str], end: str, days: int = 7) -> DataFrame:
    """(board, date) of dated boards, the last days of each."""
    names = spark.createDataFrame([(b,) for b in boards], "board string")
    return names.withColumn("date", F.explode(F.sequence(F.date_sub(F.lit(end).cast("date"), days - 1), F.lit(end).cast("date"))))


def query_plan(topics: DataFrame, topic: str, queries: str, sorts: Sequence[str]) -> DataFrame:
    """(topic, query, sort, ord): every query of every topic in every sort order."""
    out = topics.select(topic, F.posexplode(queries).alias("q", "query"))
    out = out.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("sort")) for i, s in enumerate(sorts)])))
    return out.select(topic, "query", "s.sort", (F.col("q") * len(sorts) + F.col("s.i")).alias("ord"))
