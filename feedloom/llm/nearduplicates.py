"""Near-duplicate records by HyperMinHash sketches, banded, with collision-corrected estimates, then exact verification.

A text's sketch has `groups` hash functions of 8 buckets each. A bucket's register keeps, of the smallest hash that fell
into it, the number of leading zeros and the mantissa bits behind them, in 16 bits. An empty bucket takes the next
filled one's register (rotation), marked with the distance. Bands of `band_rows` registers are hashed; texts that share a
band are candidates. Candidates' equal registers, less the expected accidental ones, estimate the similarity; those
above the threshold less a margin of `sigmas` standard deviations are verified on their full shingle sets.

Exact copies of a text are one class: sketches are per class, and copies never meet in a band. A band that many texts
share is joined by a sort-merge join whose skewed partitions are split at run time; nothing is collected or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import WordHashes, mixed, shingles, words
from feedloom.operators.components import components
from feedloom.runtime import stage

BUCKETS = 8
#: Bits of a register: leading zeros (5, so up to 31) and mantissa.
ZEROS, MANTISSA = 5, 11
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """HyperMinHash registers, one row per set of shingle hashes; no set may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), groups * BUCKETS), np.uint16)
    for g in range(groups):
        h = mixed(flat, g + 1)
        bucket, rest = h >> np.uint64(61), h << np.uint64(3)
        least = np.stack([np.minimum.reduceat(np.where(bucket == b, rest, _TOP), starts) for b in range(BUCKETS)], axis=1)
        # The position of the leading one, from the exponent of the top 53 bits as a float: exact, as they fit.
        top = (least >> np.uint64(11)).astype(np.float64)
        _, exponent = np.frexp(top)
        zeros = np.minimum(53 - exponent, 2**ZEROS - 1).astype(np.uint64)
        mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        register = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
        empty = least == _TOP
        for step in range(1, BUCKETS):
            if not empty.any():
                break
            source = np.roll(register, -step, axis=1)
            usable = empty & ~np.roll(least == _TOP, -step, axis=1)
            register = np.where(usable, source ^ np.uint16(step), register)
            empty &= ~usable
        out[:, g::groups] = register  # neighbours in a row come from different hash functions
    return out


#: Chance that registers of different minima agree: their zeros agree with 1/3, their mantissas with 2^-MANTISSA.
ACCIDENTAL = 2.0**-MANTISSA / 3


def estimated(equal: np.ndarray, n: int) -> np.ndarray:
    """Jaccard similarity from the number of equal registers of n, without the expected accidental ones."""
    return np.maximum(0.0, (equal / n - ACCIDENTAL) / (1 - ACCIDENTAL))


def _sketcher(width: int, min_words: int, groups: int, chunk: int = 512):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            for start in range(0, len(pdf), chunk):
                part = pdf.iloc[start : start + chunk]
                classes, sets = [], []
                for k, t in zip(part["class"], part["text"]):
                    ws = words(t)
                    if len(ws) >= max(min_words, width):
                        classes.append(k)
                        sets.append(shingle_set(ws, width, known))
                if sets:
                    yield pd.DataFrame({"class": classes, "registers": [x.tobytes() for x in sketch(sets, groups)]})

    return run


def shingle_set(ws: list[str], width: int, known: WordHashes) -> np.ndarray:
    return np.unique(shingles(np.fromiter((known[w] for w in ws), np.uint64, len(ws)), width))


def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
    return pd.Series(estimated((x == y).sum(axis=1), x.shape[1]))


def _shingler(width: int):
    """(class, shingles) of the texts of classes; the hashes are sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"class": pdf["class"], "shingles": [shingle_set(words(t), width, known).view(np.int64) for t in pdf["text"]]})

    return run


def similar_texts(
    records: DataFrame, id: str, text: Column, *, width: int = 5, threshold: float = 0.8, min_words: int = 5,
    groups: int = 18, band_rows: int = 3, sigmas: float = 4.0,
) -> tuple[DataFrame, DataFrame]:
    """(members: id, class), (links: class_a, class_b, similarity) of the texts whose similarity reaches the threshold.

    Equal texts are one class; links join different classes, class_a < class_b. Similarity is the Jaccard similarity of
    the sets of runs of `width` words. Texts of less than min_words words (or width, if that is more), null and empty
    ones among them, are left out. A repeated row counts once. Other columns are ignored.

    With 48 bands of 3 registers two texts of similarity 0.5 share a band with probability 0.998, of 0.55 with 0.9998, of
    0.6 with 0.99999; raise `groups` for more. The band table holds two numbers per text and band.
    """
    source = records.select(F.col(id).cast("string").alias("id"), text.alias("text")).filter("id is not null and text is not null")
    source = source.withColumn("class", F.concat(F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(7), "text"))))
    sketched = source.select("class", "text").mapInPandas(_sketcher(width, min_words, groups), "class string, registers binary")
    of = stage(sketched.groupBy(F.unhex("class").alias("class")).agg(F.first("registers").alias("registers")), "sketches")
    # 64 bits stand for the class in the bands; the class itself decides later.
    n = groups * BUCKETS // band_rows
    size = 2 * band_rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.xxhash64(j, F.col("registers").substr(j * size + 1, F.lit(size))))
    banded = of.select(F.xxhash64("class").alias("c"), F.explode(keys).alias("band"))
    candidates = stage(
        banded.alias("x").join(banded.alias("y"), "band").filter("x.c < y.c")
        .select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct(), "candidates",
    )
    least = threshold - sigmas * (threshold * (1 - threshold) / (groups * BUCKETS)) ** 0.5
    estimate = F.pandas_udf(_estimate, "double")
    regs = of.select(F.xxhash64("class").alias("c"), "class", "registers")
    near = stage(
        candidates.join(regs.select(F.col("c").alias("a"), F.col("class").alias("class_a"), F.col("registers").alias("ra")), "a")
        .join(regs.select(F.col("c").alias("b"), F.col("class").alias("class_b"), F.col("registers").alias("rb")), "b")
        .filter(estimate("ra", "rb") >= least).select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")),
        "near",
    )
    needed = near.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    full = source.withColumn("class", F.unhex("class"))
    # The shingles of each class that is in a pair, read once, however many pairs it is in; the others' texts don't outlive this join.
    texts = full.select("class", "text").join(needed, "class", "left_semi").groupBy("class").agg(F.min("text").alias("text"))
    sets = stage(texts.mapInPandas(_shingler(width), "class binary, shingles array<bigint>"), "shingles")
    common = F.size(F.array_intersect("sa", "sb"))
    links = (
        near.join(sets.select(F.col("class").alias("class_a"), F.col("shingles").alias("sa")), "class_a")
        .join(sets.select(F.col("class").alias("class_b"), F.col("shingles").alias("sb")), "class_b")
        .select("class_a", "class_b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)
    )
    members = full.select("id", "class").join(of.select("class"), "class", "left_semi").distinct()
    return members, stage(links, "links")


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the links between records, copies included. For callers that need every pair."""
    repeated = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class")
    same = members.join(repeated, "class", "left_semi")
    copies = same.alias("x").join(same.alias("y"), "class").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    across = (
        links.join(members.select(F.col("class").alias("class_a"), F.col("id").alias("a")), "class_a")
        .join(members.select(F.col("class").alias("class_b"), F.col("id").alias("b")), "class_b")
        .select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    )
    return copies.union(across).filter("id_a < id_b").distinct()


def similar_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id, links): one row per record; a group is what links and copies connect, named by a class in it."""
    of = components(links, "class_a", "class_b")
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(of.withColumnRenamed("node", "class"), "class", "left")
        .join(degree, "class", "left")
        .select("id", F.lower(F.hex(F.coalesce("component", "class"))).alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
