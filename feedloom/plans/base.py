"""Registration of named queries with their SQL, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.dedup import first_per_key
from feedloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: The instant at which queries over the test tables look.
NOW = "2026-06-01 00:00:00"

#: SQL of the shared tables: each record's latest delivery.
ARTICLES = "a AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM fitness) WHERE rn = 1)"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(table(spark, sf_dir, "fitness"), F.col("id"), F.col("ingested_at").desc())


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                uses = " a " in f" {sql} " or " a)" in sql
                own = sql.lstrip()
                # A query with its own WITH shares it, recursive or not.
                for word in ("WITH RECURSIVE ", "WITH "):
                    if uses and own.startswith(word):
                        own, uses = f"{word}{ARTICLES}, {own[len(word):]}", False
                self.sql[name] = f"WITH {ARTICLES} {sql}" if uses else own
            return f

        return add


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
