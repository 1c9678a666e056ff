"""One surviving record per group of duplicates, from consistent bundles of fields.

Fields that depend on each other form a bundle, and a bundle's values are taken whole, from one record, so dependencies
inside it hold in the survivor as they did in the record. Functional dependencies tie bundles together: what a candidate
of the determining bundle expects, the candidate of the dependent bundle must have. Branch and bound picks one candidate
per bundle so that the sum of weight times trust is largest and every dependency holds; a bundle may stay empty at no
trust, so there always is a solution. A leading bundle keeps its first candidate whatever that costs the others.

Candidates are the different values of a bundle in a group, each by its best record, not the group's records. The root of
the search, every bundle's best, comes from one aggregate per group that combines on the map side, and is checked against
the dependencies by column expressions; so a group of any size, even a third of all rows, is never collected. Only groups
whose root breaks a dependency are searched, over each bundle's `width` best candidates; a solution is final if no
candidate beyond these could give more, else the search is repeated four times as wide. So the result is exact whatever
the width.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.runtime import stage


@dataclass(frozen=True)
class Bundle:
    """fields taken together from one eligible record: the first by `order` (ascending), then by the smallest id.

    trust: what a candidate is worth, above 0, and not rising along the order; null counts as the least worth. leading: the
    first candidate is kept, and other bundles must go by it.
    """

    name: str
    fields: tuple[str, ...]
    eligible: Column
    order: tuple[Column, ...]
    trust: Column | None = None
    weight: float = 1.0
    leading: bool = False


@dataclass(frozen=True)
class Dependency:
    """A functional dependency: a record in `determinant` expects a value, a record in `dependent` has one; they must agree.

    Null on either side, or an empty bundle, contradicts nothing.
    """

    determinant: str
    dependent: str
    expects: Column
    has: Column


LEAST_TRUST = 1e-6


def branch_and_bound(
    trusts: dict[str, list[float]], clashes: Sequence[tuple[str, str, np.ndarray]], weights: dict[str, float]
) -> tuple[float, dict[str, int]]:
    """The choice of a candidate (or none, -1) per bundle with the most weighted trust in which no pair clashes.

    trusts: of each bundle's candidates, best first. clashes: (bundle a, bundle b, matrix of the candidates that exclude each
    other). Of equal choices the one that comes first along the bundles' orders is taken.
    """
    names = sorted(trusts, key=lambda n: (-weights[n], n))
    place = {n: i for i, n in enumerate(names)}
    against: list[list[tuple[int, np.ndarray]]] = [[] for _ in names]
    for a, b, matrix in clashes:
        if place[a] < place[b]:
            against[place[b]].append((place[a], matrix.T))
        else:
            against[place[a]].append((place[b], matrix))
    # The most that the bundles from here on could add.
    hope = np.zeros(len(names) + 1)
    for i in range(len(names) - 1, -1, -1):
        hope[i] = hope[i + 1] + (weights[names[i]] * trusts[names[i]][0] if trusts[names[i]] else 0.0)
    best: list = [-1.0, [-1] * len(names)]
    picked = [-1] * len(names)

    def descend(i: int, value: float) -> None:
        if value + hope[i] <= best[0]:
            return
        if i == len(names):
            best[0], best[1] = value, picked.copy()
            return
        mine = trusts[names[i]]
        for at in range(len(mine)):
            if value + weights[names[i]] * mine[at] + hope[i + 1] <= best[0]:
                break
            if all(picked[j] < 0 or not matrix[at, picked[j]] for j, matrix in against[i]):
                picked[i] = at
                descend(i + 1, value + weights[names[i]] * mine[at])
        picked[i] = -1
        descend(i + 1, value)

    descend(0, 0.0)
    return best[0], dict(zip(names, best[1]))


def _one_row_per_id(records: DataFrame, key: str, id: str, latest: str | None) -> DataFrame:
    keyed = records.filter(F.col(key).isNotNull() & F.col(id).isNotNull())
    others = [c for c in keyed.columns if c not in (key, id)]
    by = F.struct(*[F.col(c) for c in ([latest] if latest else [])], F.xxhash64(*others)) if others else F.lit(1)
    return keyed.groupBy(key, id).agg(F.max_by(F.struct(*others), by).alias("r")).select(key, id, *[F.col(f"r.{c}").alias(c) for c in others])


def _sides(name: str, dependencies: Sequence[Dependency]) -> list[Column]:
    """The columns by which candidates of a bundle differ for the dependencies."""
    expects = [d.expects.cast("string").alias(f"__x{i}") for i, d in enumerate(dependencies) if d.determinant == name]
    return expects + [d.has.cast("string").alias(f"__h{i}") for i, d in enumerate(dependencies) if d.dependent == name]


def _order(b: Bundle, id: str) -> Column:
    """Null for a record that is not eligible."""
    return F.when(b.eligible, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(b.order)], F.col(id).alias("id")))


def _parts(bundles: Sequence[Bundle], dependencies: Sequence[Dependency]) -> list[list[Bundle]]:
    """Bundles that dependencies tie together; each part is solved by itself. Bundles of no dependency are in none."""
    of = {b.name: {b.name} for b in bundles}
    for d in dependencies:
        together = of[d.determinant] | of[d.dependent]
        for n in together:
            of[n] = together
    parts: list[list[Bundle]] = []
    for b in bundles:
        if len(of[b.name]) > 1 and not any(b in p for p in parts):
            parts.append([x for x in bundles if x.name in of[b.name]])
    return parts


def survivors(
    records: DataFrame, key: str, id: str, bundles: Sequence[Bundle], dependencies: Sequence[Dependency] = (), *,
    latest: str | None = None, min_ids: int = 2, width: int = 8,
) -> DataFrame:
    """(key, n_ids, and for each bundle <name>_id and <name>, a struct of its fields); one row per key of min_ids ids or more.

    Rows with a null key or id are left out. Rows of one id count once: the one with the largest `latest` column, if it
    is given, then any fixed one. A bundle without an eligible record is null, as is one that no candidate suits. An empty
    table yields no rows. All columns of records travel, so select what the bundles need; others may have any name.
    """
    leading = {b.name for b in bundles if b.leading}
    if any(d.determinant in leading and d.dependent in leading for d in dependencies):
        raise ValueError("a dependency between leading bundles cannot be met")
    # Groups of fewer ids are in no result, so their records need not travel.
    several = records.select(key, id).filter(F.col(id).isNotNull()).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_ids)
    one = _one_row_per_id(records.join(several.select(key), key, "left_semi"), key, id, latest)
    parts = _parts(bundles, dependencies)
    if parts:
        one = stage(one, "survivor-records")  # read for the roots, the candidates and the values
    values = lambda b: F.struct(F.col(id).alias("__id"), *b.fields, *_sides(b.name, dependencies))
    best = [F.min_by(values(b), _order(b, id)).alias(b.name) for b in bundles]
    root = one.groupBy(key).agg(F.count(F.lit(1)).alias("n_ids"), *best).filter(F.col("n_ids") >= min_ids)
    if parts:
        agrees = lambda i, d: F.coalesce(F.col(f"{d.determinant}.__x{i}") == F.col(f"{d.dependent}.__h{i}"), F.lit(True))
        broken = [
            ~reduce(lambda x, y: x & y, [agrees(i, d) for i, d in enumerate(dependencies) if d.determinant in {b.name for b in p}]).alias(f"__b{k}")
            for k, p in enumerate(parts)
        ]
        sides = {b.name: [f"__{s}{i}" for i, d in enumerate(dependencies) for s, n in (("x", d.determinant), ("h", d.dependent)) if n == b.name] for b in bundles}
        bare = [F.col(b.name).dropFields(*sides[b.name]).alias(b.name) if sides[b.name] else F.col(b.name) for b in bundles]
        root = stage(root.select(key, "n_ids", *bare, F.array(*broken).alias("__broken")), "survivor-roots")
        fine = F.forall("__broken", lambda x: ~x)
        root = root.filter(fine).drop("__broken").unionByName(_searched(root.filter(~fine), one, key, id, bundles, dependencies, parts, width))
    return root.select(
        key, "n_ids", *[x for b in bundles for x in ((F.col(f"{b.name}.__id").alias(f"{b.name}_id"), *([F.col(b.name).dropFields("__id").alias(b.name)] if b.fields else [])))]
    )


def _candidates(rows: DataFrame, key: str, id: str, b: Bundle, number: int, dependencies: Sequence[Dependency], width: int) -> DataFrame:
    """(key, candidate: its bundle, place, id, trust, and all dependencies' sides): the `width` + 1 first different values."""
    sides = _sides(b.name, dependencies)
    trust = F.greatest(F.coalesce((F.lit(1.0) if b.trust is None else b.trust).cast("double"), F.lit(LEAST_TRUST)), F.lit(LEAST_TRUST))
    mine = rows.select(key, F.col(id).alias("i"), trust.alias("t"), _order(b, id).alias("o"), *sides).filter("o is not null")
    named = [c for c in mine.columns if c.startswith("__")]
    every = [f"__{s}{i}" for i in range(len(dependencies)) for s in "xh"]
    # Of a leading bundle nothing but the first is ever taken.
    each = mine.groupBy(key, *([] if b.leading else named)).agg(F.min("o").alias("o"), F.min_by(F.struct("i", "t", *named), "o").alias("v"))
    placed = each.select(key, "o", "v").withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("o")) - 1).filter(F.col("at") <= width)
    return placed.select(
        key,
        F.struct(
            F.lit(number).alias("bundle"), F.col("at").alias("at"), F.col("v.i").alias("i"), F.col("v.t").alias("t"),
            *[F.col(f"v.{c}").alias(c) if c in named else F.lit(None).cast("string").alias(c) for c in every],
        ).alias("candidate"),
    )


def _solver(names: list[str], weights: dict[str, float], leading: frozenset[str], ties: list[tuple[str, str]], parts: list[list[str]], limit: int):
    """For each group's list of candidates: (is the choice final, and its candidates' ids by bundle; null: none, or as before)."""

    def solve(candidates: list[dict]) -> tuple[bool, list]:
        lists: dict[str, list[dict]] = {n: [] for n in names}
        for c in sorted(candidates, key=lambda c: c["at"]):
            lists[names[c["bundle"]]].append(c)
        final, out = True, dict.fromkeys(names)
        for part in parts:
            if not any(lists[n] for n in part):
                continue
            more = [n for n in part if len(lists[n]) > limit]
            mine = {n: lists[n][:limit] for n in part}
            trusts = {}
            for n, x in mine.items():
                least, trusts[n] = 1.0, []
                for c in x:
                    least = min(least, c["t"] / x[0]["t"])
                    trusts[n].append(least)
            clashes = []
            for i, (a, b) in enumerate(ties):
                if a in mine:
                    x, h = [c[f"__x{i}"] for c in mine[a]], [c[f"__h{i}"] for c in mine[b]]
                    clashes.append((a, b, np.array([[p is not None and q is not None and p != q for q in h] for p in x], bool).reshape(len(x), len(h))))
            # A leading bundle outweighs all others together.
            total = sum(weights[n] for n in part) + 1
            weighed = {n: weights[n] * (total if n in leading else 1) for n in part}
            value, picked = branch_and_bound(trusts, clashes, weighed)
            full = sum(weighed[n] * t[0] for n, t in trusts.items() if t)
            # With a candidate not seen, a bundle gives no more than its last one seen.
            final &= not more or value >= max(full - weighed[n] * (1 - trusts[n][-1]) for n in more) - 1e-9
            out.update({n: mine[n][k]["i"] for n, k in picked.items() if k >= 0})
        return final, [out[n] for n in names]

    return solve


def _searched(todo: DataFrame, one: DataFrame, key: str, id: str, bundles, dependencies, parts, width: int) -> DataFrame:
    tied = [b for p in parts for b in p]
    names = [b.name for b in tied]  # what runs in workers must not hold columns
    weights, leading = {b.name: b.weight for b in tied}, frozenset(b.name for b in tied if b.leading)
    ties, by_part = [(d.determinant, d.dependent) for d in dependencies], [[b.name for b in p] for p in parts]
    part_of = {b.name: k for k, p in enumerate(parts) for b in p}
    types = dict(one.dtypes)
    schema = f"`{key}` {types[key]}, __final boolean, " + ", ".join(f"__p_{n} {types[id]}" for n in names)
    every = stage(one.join(todo.select(key, "__broken"), key), "survivor-open")
    rows, done = every, []
    while True:
        part = [_candidates(rows.filter(F.get("__broken", part_of[b.name])), key, id, b, k, dependencies, width) for k, b in enumerate(tied)]
        # At most width + 1 candidates per bundle, however large the group is.
        groups = reduce(DataFrame.unionByName, part).groupBy(key).agg(F.collect_list("candidate").alias("candidates"))
        solve = _solver(names, weights, leading, ties, by_part, width)

        def run(batches: Iterator[pd.DataFrame], solve=solve) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                solved = [solve(c) for c in pdf["candidates"]]
                yield pd.DataFrame({key: pdf[key], "__final": [f for f, _ in solved], **{f"__p_{n}": [p[i] for _, p in solved] for i, n in enumerate(names)}})

        found = stage(groups.mapInPandas(run, schema), "survivor-search")
        done.append(found.filter("__final").drop("__final"))
        open_ = found.filter("not __final").select(key)
        if open_.isEmpty():
            break
        rows = stage(rows.join(open_, key, "left_semi"), "survivor-open")
        width *= 4
    settled = todo.join(reduce(DataFrame.unionByName, done), key)
    for b in tied:
        broken, chosen = F.get("__broken", part_of[b.name]), f"__p_{b.name}"
        if b.fields and not b.leading:
            these = every.select(key, F.col(id).alias(chosen), F.struct(F.col(id).alias("__id"), *b.fields).alias("__new"))
            settled = settled.join(these, [key, chosen], "left").withColumn(b.name, F.when(broken, F.col("__new")).otherwise(F.col(b.name))).drop("__new")
        elif not b.leading:
            settled = settled.withColumn(b.name, F.when(~broken, F.col(b.name)).when(F.col(chosen).isNotNull(), F.struct(F.col(chosen).alias("__id"))))
    return settled.select(key, "n_ids", *[b.name for b in bundles])


# --- dates as people wrote them ----------------------------------------------------------------------------------------

#: The first letters of the months' English names, and all names accepted.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = "(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)\\.?"
#: Notations: pattern, and the groups that hold year, month and day.
NOTATIONS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[t ]\d{1,2}:\d{2}.*)?$", "$1|$2|$3"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1|$2|$3"),
    (r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$", "$3|$2|$1"),
    (rf"^(\d{{1,2}})(?:st|nd|rd|th)? {_NAME},? (\d{{4}})$", "$3|$2|$1"),
    (rf"^{_NAME} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$", "$3|$1|$2"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1|$2"),
    (rf"^{_NAME},? (\d{{4}})$", "$2|$1"),
    (r"^(\d{4})$", "$1"),
)


def read_date(text: Column) -> Column:
    """struct(begins date, precision: 0 day, 1 month, 2 year) of a real day, month or year; null for anything else."""
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    parts = F.lit(None).cast("string")
    for pattern, order in reversed(NOTATIONS):
        parts = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, order)).otherwise(parts)

    def dated(p: Column) -> Column:
        year, month, day = (F.get(p, i) for i in range(3))
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(month, 1, 3)).cast("int")
        y, m, d = year.try_cast("int"), F.when(named > 0, named).otherwise(month.try_cast("int")), day.try_cast("int")
        m = F.when(month.isNull(), 1).otherwise(m)
        first = F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
        begins = F.when(day.isNull(), first).when(d.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))
        return F.when(begins.isNotNull(), F.struct(begins.alias("begins"), (3 - F.size(p)).alias("precision")))

    # Bound once by the lambda, else every use would read the text again.
    return F.get(F.transform(F.array(F.split(parts, r"\|")), dated), 0)
