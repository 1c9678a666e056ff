"""Queries of the training-data problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import snapdiff
from feedloom.runtime import table

COMPARED = ("title", "venue", "published", "publisher", "citations")


def numbered_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fitness_snapshots with `snap`, the index's number of the instant that `generated_at` writes."""
    index = table(spark, sf_dir, "world_snapshot").select(F.col("snap_no").alias("snap"), snapdiff.naive_micros("generated_at").alias("at")).distinct()
    rows = table(spark, sf_dir, "fitness_snapshots").select("generated_at", "id", "delivered_at", *COMPARED)
    return rows.withColumn("at", snapdiff.instant_micros(F.col("generated_at"))).join(index, "at").drop("at", "generated_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapdiff.snapshot_changes(numbered_snapshots(spark, sf_dir), COMPARED)
    return changes.select(F.col("snap").alias("snap_no"), "id", "change_kind")


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": """
WITH s AS (
  SELECT w.snap_no, f.id, f.title, f.venue, f.published, f.publisher, f.citations,
         row_number() OVER (PARTITION BY w.snap_no, f.id ORDER BY f.delivered_at DESC NULLS LAST) AS rn
  FROM fitness_snapshots f
  JOIN (SELECT DISTINCT snap_no, generated_at FROM world_snapshot) w
    ON epoch_us(CAST(replace(f.generated_at, ' ', 'T') AS TIMESTAMPTZ)) = epoch_us(w.generated_at)
  WHERE f.id IS NOT NULL
), r AS (SELECT * FROM s WHERE rn = 1),
d AS (SELECT snap_no, lag(snap_no) OVER (ORDER BY snap_no) AS prev_no FROM (SELECT DISTINCT snap_no FROM r)),
l AS (SELECT d.prev_no, r.* FROM r JOIN d USING (snap_no) WHERE d.prev_no IS NOT NULL),
e AS (SELECT d.snap_no AS at_no, r.* FROM r JOIN d ON r.snap_no = d.prev_no)
SELECT coalesce(l.snap_no, e.at_no) AS snap_no, coalesce(l.id, e.id) AS id,
       CASE WHEN e.id IS NULL THEN 'added' WHEN l.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM l FULL OUTER JOIN e ON l.snap_no = e.at_no AND l.id = e.id
WHERE e.id IS NULL OR l.id IS NULL
   OR l.title IS DISTINCT FROM e.title OR l.venue IS DISTINCT FROM e.venue OR l.published IS DISTINCT FROM e.published
   OR l.publisher IS DISTINCT FROM e.publisher OR l.citations IS DISTINCT FROM e.citations
""",
}
