"""Items of varying length into containers of fixed capacity, by a configuration linear program over the length histogram.

Only the histogram, of at most `capacity` rows, comes to the driver. The long items' lengths are rounded up to classes;
a configuration says how many items of each class share a container. The fractional covering program over all
configurations is solved by multiplicative weights: each step prices the classes, finds the dearest configuration that
fits by a knapsack dynamic program, and adds as much of it as its scarcest class allows. The solution is rounded down;
its containers are filled with exact lengths, their slack with the largest items that fit, and what is left is packed by
first-fit decreasing. All of this handles runs of equal containers, so its work and the size of the plan depend on the
number of different lengths, not on the number of items.

The plan assigns ranges of ranks among the items of one length; items find their rank by distributed counts in salted
parts, so a length that a third of all items share is no hot group, and their container by a range join with the plan.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.runtime import stage

#: Fixed value: the pattern that splits text before the merges of the public byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_counts(documents: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of the non-empty texts; tokenizer is the path of a rank file on every machine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({doc_id: pdf.iloc[:, 0], "tokens": [len(encode(t)) for t in pdf.iloc[:, 1]]})

    some = documents.select(F.col(doc_id).cast("bigint"), text).filter(F.col(doc_id).isNotNull() & (F.col(text) != ""))
    return some.mapInPandas(run, f"{doc_id} bigint, tokens bigint")


# --- the plan, on the driver -----------------------------------------------------------------------------------------


def dearest(prices: np.ndarray, sizes: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per class of the configuration of the highest total price that fits (knapsack; capped at the limits)."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, c, side="right"))
        gains = value[c - sizes[:n]] + prices[:n]
        best = int(np.argmax(gains))
        value[c], choice[c] = value[c - 1], -1
        if gains[best] > value[c]:
            value[c], choice[c] = gains[best], best
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return np.minimum(counts, limits)


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, eps: float = 0.25, steps: int = 6000) -> list[tuple[float, np.ndarray]]:
    """A fractional cover of the demand by configurations, by multiplicative weights. sizes ascend."""
    weight = np.ones(len(sizes))
    cover = np.zeros(len(sizes))
    used: dict[bytes, float] = {}
    kept: dict[bytes, np.ndarray] = {}
    for _ in range(steps):
        a = dearest(weight / demand, sizes, demand, capacity)
        has = a > 0
        step = float((demand[has] / a[has]).min())
        share = step * a / demand
        cover += share
        weight *= (1 - eps) ** share
        weight /= weight.max()
        key = a.tobytes()
        used[key] = used.get(key, 0.0) + step
        kept[key] = a
        if cover.min() * eps >= np.log(len(sizes) + 1):
            break
    least = cover.min()
    return [(x / least, kept[k]) for k, x in used.items()] if least > 0 else []


def plan(histogram: dict[int, int], capacity: int, classes: int = 128, small: float = 1 / 16) -> list[tuple[dict[int, int], int]]:
    """Runs of equal containers: ({length: items of it in each}, number of containers). Places every item of the histogram.

    Where there are few items, rounding costs more than it gains; the plan is never worse than first-fit decreasing.
    """
    simple = _decreasing({n: c for n, c in histogram.items() if c > 0}, capacity)
    solved = _solved(histogram, capacity, classes, small)
    return min(solved, simple, key=lambda runs: sum(times for _, times in runs))


def _solved(histogram: dict[int, int], capacity: int, classes: int, small: float) -> list[tuple[dict[int, int], int]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    unit = max(1, capacity // classes)
    runs: list[tuple[dict[int, int], int]] = []
    big = sorted(n for n in left if n > small * capacity)
    if big:
        of = {n: min(-(-n // unit), capacity // unit) for n in big}
        sizes = np.array(sorted(set(of.values())), np.int64)
        place = {s: i for i, s in enumerate(sizes.tolist())}
        members: list[list[int]] = [[] for _ in sizes]
        for n in big:
            members[place[of[n]]].append(n)
        demand = np.array([sum(left[n] for n in m) for m in members], np.int64)
        solution = sorted(fractional(sizes, demand, capacity // unit), key=lambda x: -x[0])
        for x, a in solution:
            todo = int(x)
            while todo > 0:
                taken: dict[int, int] = {}
                for k in np.flatnonzero(a):
                    need = int(a[k])
                    for n in reversed(members[k]):
                        take = min(need, left.get(n, 0))
                        if take:
                            taken[n] = take
                            need -= take
                        if not need:
                            break
                    if need:
                        taken = {}
                        break
                if not taken or sum(n * t for n, t in taken.items()) > capacity:
                    break
                times = min(todo, *(left[n] // t for n, t in taken.items()))
                _take(left, taken, times)
                runs.append((taken, times))
                todo -= times
    runs = _fill(runs, left, capacity)
    return runs + _decreasing(left, capacity)


def _decreasing(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Each container takes the largest items that still fit; equal containers are one run. Empties `left`."""
    runs = []
    while left:
        taken, room = {}, capacity
        for n in sorted(left, reverse=True):
            t = min(left[n], room // n)
            if t:
                taken[n] = t
                room -= n * t
        times = min(left[n] // t for n, t in taken.items())
        _take(left, taken, times)
        runs.append((taken, times))
    return runs


def _take(left: dict[int, int], taken: dict[int, int], times: int) -> None:
    for n, t in taken.items():
        left[n] -= t * times
        if not left[n]:
            del left[n]


def _fill(runs: list[tuple[dict[int, int], int]], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Put the largest items that fit into the slack of the runs, splitting a run where the items run out."""
    done, todo = [], sorted(runs, key=lambda r: sum(n * t for n, t in r[0].items()))
    while todo:
        taken, times = todo.pop()
        room = capacity - sum(n * t for n, t in taken.items())
        n = max((n for n in left if n <= room), default=0)
        if not n:
            done.append((taken, times))
            continue
        t = max(1, min(room // n, left[n] // times))
        fits = min(times, left[n] // t)
        _take(left, {n: t}, fits)
        if fits < times:
            todo.append((taken, times - fits))
        todo.append(({**taken, n: taken.get(n, 0) + t}, fits))
    return done


# --- items to containers -----------------------------------------------------------------------------------------------


def pack(items: DataFrame, item: str, size: str, capacity: int = 2048, rows_per_salt: int = 250_000) -> DataFrame:
    """(container, item, piece, start, size, used, unused): every item, or its pieces, with its container.

    items: one row per item, with a size of 1 or more. An item larger than the capacity is split into full pieces, each a
    container of its own, and a rest that is packed like other items; no other item is split. piece counts from 0, start
    is where the piece begins in the item. Rows with a null item or a size that is null or below 1 are left out. Equal
    rows are separate items. The same items are packed alike in every run.
    """
    spark = items.sparkSession
    cap = F.lit(capacity).cast("bigint")
    sized = items.select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("n")).filter("item is not null and n >= 1")
    pieces = stage(
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / cap))))
        .select("item", "piece", (F.col("piece") * cap).alias("start"), F.least(cap, F.col("n") - F.col("piece") * cap).alias("size"))
        .withColumn("salt", F.xxhash64("item", "piece")), "pieces",
    )
    histogram = {r[0]: r[1] for r in pieces.groupBy("size").count().collect()}  # at most `capacity` rows
    if not histogram:
        return spark.createDataFrame([], f"container bigint, {item} {dict(items.dtypes)[item]}, piece bigint, start bigint, size bigint, used bigint, unused bigint")
    full = histogram.pop(capacity, 0)
    runs = plan(histogram, capacity) + ([({capacity: 1}, full)] if full else [])
    rows, at, given = [], 0, dict.fromkeys([*histogram, capacity], 0)
    for taken, times in runs:
        used = sum(n * t for n, t in taken.items())
        for n, t in taken.items():
            rows.append((n, given[n], given[n] + t * times, t, at, used))
            given[n] += t * times
        at += times
    placed = spark.createDataFrame(rows, "size bigint, first bigint, last bigint, each bigint, container0 bigint, used bigint")
    salts = max(1, sum(histogram.values()) // rows_per_salt)
    parts = pieces.withColumn("part", F.pmod("salt", F.lit(salts)))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("size", "part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = (
        parts.withColumn("r", F.row_number().over(Window.partitionBy("size", "part").orderBy("item", "piece", "salt")) - 1)
        .join(offsets, ["size", "part"]).withColumn("rank", F.col("r") + F.col("offset"))
    )
    # The plan has a row per run and length: bounded by the number of lengths, and checked here.
    small = F.broadcast(placed) if len(rows) <= 100_000 else placed
    return (
        ranked.join(small, "size").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .select(
            (F.col("container0") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("bigint").alias("container"), F.col("item").alias(item),
            "piece", "start", "size", "used", (cap - F.col("used")).alias("unused"),
        )
    )


def totals(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, used, unused, lower_bound): one row; no packing has fewer containers than lower_bound, the sizes' sum by the capacity."""
    each = packed.groupBy("container").agg(F.sum("size").alias("size"))
    sums = each.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("used"))
    return sums.select("containers", "used", (F.col("containers") * capacity - F.col("used")).alias("unused"), F.ceil(F.col("used") / capacity).alias("lower_bound"))
