"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans import eventplans, feedplans, laneplans, payloads, problems, texts

_PARTS = (texts.query, feedplans.query, eventplans.query, payloads.query, laneplans.query)
QUERIES = dict(problems.QUERIES)
SQL = dict(problems.SQL)
for _p in _PARTS:
    QUERIES |= _p.queries
    SQL |= _p.sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers ranked by world score within their topic."""
    return QUERIES["world_rank"](spark, sf_dir)
