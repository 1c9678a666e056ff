"""Ordered blocks of documents: offsets, budgets and cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(blocks: DataFrame, doc: str, order: str, text: str, gap: int = 1) -> DataFrame:
    """blocks with char_start and char_end in their joined text, `gap` characters between two of them."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0))
    return blocks.withColumn("char_start", start).withColumn("char_end", start + F.length(text))


def within_budget(blocks: DataFrame, doc: str, order: str, text: str, budget: int, gap: int = 1, intro: Column | None = None) -> DataFrame:
    """The longest prefix of blocks that fits, at least one. intro: length of a heading that depends on the number `n` of blocks kept."""
    w = Window.partitionBy(doc).orderBy(order)
    total = F.sum(F.length(text) + gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) - gap
    marked = blocks.withColumn("n", F.row_number().over(w))
    marked = marked.withColumn("__total", total + (intro if intro is not None else F.lit(0)))
    largest = F.max(F.when(F.col("__total") <= budget, F.col("n"))).over(Window.partitionBy(doc))
    marked = marked.withColumn("__most", F.greatest(F.lit(1), F.coalesce(largest, F.lit(1))))
    return marked.filter(F.col("n") <= F.col("__most")).drop("__total", "__most")


def cut_off(blocks: DataFrame, doc: str, order: str, text: str, chars: int = 120_000, count: int = 160) -> DataFrame:
    """Blocks up to the first that would exceed chars or count, with a flag on documents that lost some."""
    w = Window.partitionBy(doc).orderBy(order)
    running = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = blocks.withColumn("__over", (running > chars) | (F.row_number().over(w) > count))
    flagged = marked.withColumn("truncated", F.max("__over").over(Window.partitionBy(doc)))
    return flagged.withColumn("__past", F.max("__over").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("not __past").drop("__over", "__past")


def joined(blocks: DataFrame, doc: str, order: str, text: str, separator: str = " ") -> DataFrame:
    """(doc, text): the blocks of a document in order. For documents whose blocks were cut off or budgeted before."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return blocks.groupBy(doc).agg(F.array_join(parts, separator).alias(text))


def time_at(times: Column, offset: Column) -> Column:
    """The time of a character offset in an alignment, clamped to it and rounded to milliseconds."""
    at = F.greatest(F.lit(0), F.least(F.floor(offset + 0.5).cast("int"), F.size(times) - 1))
    return F.floor(F.get(times, at) * 1000 + 0.5) / 1000


def paragraphs(doc: str, text: str) -> list[Column]:
    """For a select: position and text of the non-empty lines of a document."""
    lines = F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return [F.col(doc), F.posexplode(lines).alias("block_no", "block")]
