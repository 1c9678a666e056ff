"""Differences between consecutive full snapshots of a table, by invertible Bloom lookup tables.

Each snapshot's keys are hashed into buckets; a bucket's lookup table holds, per cell, a signed count and the XORs of the
key hashes and row digests that fall on the cell. Tables of consecutive snapshots are subtracted, so equal rows vanish
without meeting each other, and what is left is peeled. A bucket that cannot be peeled is built again, larger and with
another seed; one that still fails at the largest size is compared by an exact join, so no difference is lost.

Only XORs and counts are shuffled for equal rows (`bit_xor` and `sum` combine on the map side), so a key that a third of
all rows share, or a snapshot of any size, makes no large group: a group never exceeds the cells of one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import stage

HASHES = 3
_SEED = 0x5BD1E995


def instant_micros(text: Column) -> Column:
    """ISO-8601 text with or without offset (then UTC) as microseconds since 1970; null if it is no instant."""
    t = F.trim(text)
    zoned = t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    return F.unix_micros(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp"))


def naive_micros(column: str) -> Column:
    """A timestamp without zone, read as UTC, as microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def row_digest(columns: Sequence[str]) -> Column:
    """Digest in which null differs from every value and neighbouring fields cannot run together."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    lengths = [F.length(p).cast("string") for p in parts]
    return F.xxhash64(F.concat_ws("\u0001", *[x for pair in zip(lengths, parts) for x in pair]))


def latest_rows(rows: DataFrame, compared: Sequence[str]) -> DataFrame:
    """(snap, id, k1, k2, dg) of each snapshot's current rows: per (snap, id) the one with the latest `delivered_at`.

    rows: snap bigint, id string, delivered_at timestamp, and the compared columns. Rows with null snap or id are left
    out. Of rows equal in `delivered_at` (null sorts first) the larger digest counts, so the result is one defined row.
    """
    return (
        rows.filter(F.col("snap").isNotNull() & F.col("id").isNotNull())
        .select("snap", "id", F.struct("delivered_at", row_digest(compared).alias("dg")).alias("v"))
        .groupBy("snap", "id")
        .agg(F.max("v").alias("v"))
        .select("snap", "id", F.xxhash64("id").alias("k1"), F.xxhash64(F.lit(_SEED), "id").alias("k2"), F.col("v.dg").alias("dg"))
    )


def _cells(rows: DataFrame, cells: int, seed: int) -> DataFrame:
    """Lookup-table cells: count and XORs per (snap, bucket, cell).

    The digest takes part in choosing the cells; else both rows of a changed key would fall on the same cells and their
    counts would cancel out. The bucket depends on the key alone, so both come out of the same table.
    """
    third = max(1, cells // HASHES)
    at = F.array(*[F.lit(i * third) + F.pmod(F.xxhash64(F.lit(seed * 7 + i).cast("bigint"), "k1", "k2", "dg"), F.lit(third)) for i in range(HASHES)])
    return (
        rows.select("snap", "bucket", "k1", "k2", "dg", F.xxhash64(F.lit(seed).cast("bigint"), "k1", "k2", "dg").alias("chk"), F.explode(at).alias("cell"))
        .groupBy("snap", "bucket", "cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.expr(f"bit_xor({c})").alias(c) for c in ("k1", "k2", "dg", "chk")],
        )
    )


def _subtracted(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells of the later snapshot of each pair minus those of the earlier one, without the cells that cancel out."""
    signed = cells.join(pairs, "snap")
    return (
        signed.groupBy("pair", "bucket", "cell")
        .agg(
            F.sum(F.col("n") * F.col("sign")).alias("n"),
            *[F.expr(f"bit_xor({c})").alias(c) for c in ("k1", "k2", "dg", "chk")],
        )
        .filter("n <> 0 or k1 <> 0 or k2 <> 0 or dg <> 0 or chk <> 0")
    )


_PEELED = "pair bigint, bucket bigint, k1 bigint, k2 bigint, later_dg bigint, earlier_dg bigint, kind string"

#: The constants of xxHash64, as published.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_longs(*columns: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of bigint columns, vectorised."""
    h = np.uint64(42)
    with np.errstate(over="ignore"):
        for c in columns:
            v = np.asarray(c, dtype=np.int64).astype(np.uint64)
            x = h + _P5 + np.uint64(8)
            x = x ^ (_rotl(v * _P2, 31) * _P1)
            x = _rotl(x, 27) * _P1 + _P4
            x = (x ^ (x >> np.uint64(33))) * _P2
            x = (x ^ (x >> np.uint64(29))) * _P3
            h = x ^ (x >> np.uint64(32))
    return np.asarray(h).astype(np.int64)


def peel(n, k1, k2, dg, chk, cells: int, seed: int):
    """Peel one bucket's subtracted table, all pure cells of a round at once.

    Returns (k1, k2, dg, sign) of the entries, or None if the table does not come out empty.
    """
    third = max(1, cells // HASHES)
    size = third * HASHES
    found: list[tuple] = []
    pure = np.flatnonzero(np.abs(n) == 1)
    for _ in range(4 * size + 4):
        if not len(pure):
            break
        real = pure[xxhash64_longs(seed, k1[pure], k2[pure], dg[pure]) == chk[pure]]
        if not len(real):
            break
        at = np.stack([i * third + np.mod(xxhash64_longs(seed * 7 + i, k1[real], k2[real], dg[real]), third) for i in range(HASHES)])
        keep = (at == real).any(axis=0)
        real, at = real[keep], at[:, keep]
        # One entry may be pure in several cells; the first cell counts.
        entry = np.stack([k1[real], k2[real], dg[real], n[real]])
        _, first = np.unique(entry, axis=1, return_index=True)
        entry, at = entry[:, first], at[:, first]
        found.append(tuple(entry))
        e1, e2, ed, en = entry
        ec = xxhash64_longs(seed, e1, e2, ed)
        for row in at:
            np.subtract.at(n, row, en)
            for target, value in ((k1, e1), (k2, e2), (dg, ed), (chk, ec)):
                np.bitwise_xor.at(target, row, value)
        touched = np.unique(at)
        pure = touched[np.abs(n[touched]) == 1]
    if n.any() or k1.any() or k2.any() or dg.any() or chk.any():
        return None
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.empty(0, np.int64) for _ in range(4))


def _peeler(cells: int, seed: int):
    size = max(1, cells // HASHES) * HASHES

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pair, bucket = int(pdf["pair"].iloc[0]), int(pdf["bucket"].iloc[0])
        table = []
        for c in ("n", "k1", "k2", "dg", "chk"):
            a = np.zeros(size, np.int64)
            a[pdf["cell"].to_numpy()] = pdf[c].to_numpy()
            table.append(a)
        got = peel(*table, cells, seed)
        if got is None:
            return pd.DataFrame({"pair": [pair], "bucket": [bucket], "k1": None, "k2": None, "later_dg": None, "earlier_dg": None, "kind": ["failed"]})
        e = pd.DataFrame(dict(zip(("k1", "k2", "dg", "sign"), got))).astype({"dg": "Int64"})  # nullable: a float would lose bits
        both = e[e.sign == 1].drop(columns="sign").merge(e[e.sign == -1].drop(columns="sign"), on=["k1", "k2"], how="outer", suffixes=("_l", "_e"), indicator=True)
        kind = both["_merge"].astype(str).map({"both": "changed", "left_only": "added", "right_only": "removed"})
        return pd.DataFrame({
            "pair": pair, "bucket": bucket, "k1": both.k1, "k2": both.k2,
            "later_dg": both.dg_l, "earlier_dg": both.dg_e, "kind": kind,
        })

    return run


def _exact(rows: DataFrame, pairs: DataFrame, failed: DataFrame) -> DataFrame:
    """The differences of the failed buckets by an exact join."""
    signed = rows.join(pairs, "snap").join(failed, ["pair", "bucket"], "left_semi")
    both = signed.groupBy("pair", "bucket", "k1", "k2").agg(
        F.max(F.when(F.col("sign") == 1, F.col("dg"))).alias("later_dg"), F.max(F.when(F.col("sign") == -1, F.col("dg"))).alias("earlier_dg")
    )
    kind = F.when(F.col("earlier_dg").isNull(), "added").when(F.col("later_dg").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("later_dg").eqNullSafe(F.col("earlier_dg"))).withColumn("kind", kind)


def snapshot_changes(
    rows: DataFrame, compared: Sequence[str], bucket_rows: int = 4096, cells: int = 2048, rounds: int = 3
) -> DataFrame:
    """(snap, id, change_kind) of each delivered snapshot against the delivered one before it.

    rows as for `latest_rows`. A snapshot without rows was not delivered and is skipped; the first yields nothing, and an
    empty table yields no rows. change_kind is 'added', 'removed' or 'changed' (a compared column differs exactly, null
    equalling only null). Repeated rows count once. Columns besides those named are ignored.
    cells: of a bucket's first lookup table; each of `rounds` makes it four times as large.
    """
    spark = rows.sparkSession
    now = stage(latest_rows(rows, compared), "snapshot-rows")
    counts = sorted(now.groupBy("snap").count().collect())  # one row per snapshot
    if len(counts) < 2:
        return spark.createDataFrame([], "snap bigint, id string, change_kind string")
    snaps = [r["snap"] for r in counts]
    buckets = max(1, -(-max(r["count"] for r in counts) // bucket_rows))
    pairs = F.broadcast(spark.createDataFrame(
        [(s, s, 1) for s in snaps[1:]] + [(later, s, -1) for s, later in zip(snaps, snaps[1:])], "pair bigint, snap bigint, sign int"
    ))
    left = now.withColumn("bucket", F.pmod(F.xxhash64(F.lit(1), "k1"), F.lit(buckets)))
    todo, done, seed, failed = left, [], 11, None
    for i in range(rounds):
        size = cells * 4**i
        tables = _subtracted(_cells(todo, size, seed + i), pairs)
        if failed is not None:  # a snapshot is in two pairs; of the one that did not fail only a side is built again
            tables = tables.join(failed, ["pair", "bucket"], "left_semi")
        peeled = stage(tables.groupBy("pair", "bucket").applyInPandas(_peeler(size, seed + i), _PEELED), "snapshot-peeled")
        failed = peeled.filter("kind = 'failed'").select("pair", "bucket")
        done.append(peeled.filter("kind <> 'failed'"))
        if failed.isEmpty():
            break
        again = failed.join(pairs, "pair").select("snap", "bucket").distinct()
        todo = left.join(again, ["snap", "bucket"], "left_semi")
        if i + 1 == rounds:
            done.append(_exact(left, pairs, failed).select(*done[0].columns))
    changes = done[0]
    for d in done[1:]:
        changes = changes.unionByName(d)
    previous = spark.createDataFrame(list(zip(snaps[1:], snaps)), "pair bigint, previous bigint")
    sides = changes.join(F.broadcast(previous), "pair").select(
        "pair", "k1", "k2", "kind", F.when(F.col("kind") == "removed", F.col("previous")).otherwise(F.col("pair")).alias("snap"),
        F.coalesce("later_dg", "earlier_dg").alias("dg"),
    )
    # The digest is verified against the row the key leads back to.
    return now.join(sides, ["snap", "k1", "k2", "dg"]).select(F.col("pair").alias("snap"), "id", F.col("kind").alias("change_kind"))
