import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from feedloom.llm import survivor
from feedloom.llm.survivor import Bundle, Dependency

SCHEMA = "k string, id string, a int, b int, c int, ta int, tb int, at int, name string"


def bundles(lead=False):
    by = lambda t: (-F.col(t), F.col("id"))
    return [
        Bundle("left", ("a",), F.col("a").isNotNull(), by("ta"), F.col("ta"), leading=lead), Bundle("right", ("b",), F.col("b").isNotNull(), by("tb"), F.col("tb"), weight=1.5),
        Bundle("third", ("c",), F.col("c").isNotNull(), by("ta"), F.col("ta"), weight=0.5),
    ]


def dependencies():
    """a -> b, and b -> c: what is expected is a record's own value, or a rule."""
    return [Dependency("left", "right", F.col("b"), F.col("b")), Dependency("right", "third", F.col("b") % 2, F.col("c"))]


def brute_force(own, lead=False):
    """The most trust that any choice of records gives under the dependencies."""
    sides = [[(x, x[t] / max(y[t] for y in own if y[v] is not None)) for x in own if x[v] is not None] for v, t in (("a", "ta"), ("b", "tb"), ("c", "ta"))]
    best = 0.0
    for x, y, z in itertools.product(*[[None, *s] for s in sides]):
        if x and y and x[0]["b"] is not None and x[0]["b"] != y[0]["b"] or y and z and y[0]["b"] % 2 != z[0]["c"]:
            continue
        if lead and sides[0] and (x is None or (-x[0]["ta"], x[0]["id"]) != min((-s[0]["ta"], s[0]["id"]) for s in sides[0])):
            continue
        best = max(best, (x[1] if x else 0) + 1.5 * (y[1] if y else 0) + 0.5 * (z[1] if z else 0))
    return best


@pytest.mark.parametrize("lead", [False, True])
@pytest.mark.parametrize("width", [1, 8])
def test_dependencies_hold_at_most_trust(spark, lead, width):
    r = random.Random(4)
    names = SCHEMA.replace(",", "").split()[::2]
    rows = [
        dict(zip(names, (f"k{k}", f"i{k}_{i:02d}", r.choice([None, 1, 2, 3]), r.choice([None, 1, 2, 3, 4]), r.choice([None, 0, 1]), r.randrange(1, 9), r.randrange(1, 9), i, "n")))
        for k in range(30) for i in range(r.randrange(1, 12))
    ]
    df = spark.createDataFrame([tuple(x.values()) for x in rows + rows[:9]], SCHEMA)
    got = {x["k"]: x for x in survivor.survivors(df, "k", "id", bundles(lead), dependencies(), latest="at", width=width).collect()}
    searched = 0
    for k in {x["k"] for x in rows}:
        own = {x["id"]: x for x in rows if x["k"] == k}
        if len(own) < 2:
            assert k not in got
            continue
        g = got[k]
        x, y, z = (own.get(g[f"{n}_id"]) for n in ("left", "right", "third"))
        assert not (x and y and x["b"] is not None and x["b"] != y["b"]) and not (y and z and y["b"] % 2 != z["c"])
        assert [g[n] and g[n][0] for n in ("left", "right", "third")] == [p and p[v] for p, v in ((x, "a"), (y, "b"), (z, "c"))]
        most = lambda v, t: max((q[t] for q in own.values() if q[v] is not None), default=1)
        value = (x["ta"] / most("a", "ta") if x else 0) + 1.5 * (y["tb"] / most("b", "tb") if y else 0) + 0.5 * (z["ta"] / most("c", "ta") if z else 0)
        assert abs(value - brute_force(list(own.values()), lead)) < 1e-9
        searched += bool(x and y and z)
    assert searched


def test_a_leading_pair_cannot_depend(spark):
    df = spark.createDataFrame([], SCHEMA)
    both = [Bundle("left", ("a",), F.lit(True), (F.col("a"),), leading=True), Bundle("right", ("b",), F.lit(True), (F.col("b"),), leading=True)]
    with pytest.raises(ValueError):
        survivor.survivors(df, "k", "id", both, [Dependency("left", "right", F.col("b"), F.col("b"))])


def test_a_hot_group(spark):
    """Very many records of few different values, of which the best clash."""
    rows = spark.range(60_000).selectExpr("'k' as k", "cast(id as string) as id", "1 as a", "cast(2 + id % 3 as int) as b", "0 as c", "cast(1 + id % 5 as int) as ta", "cast(1 + id % 3 as int) as tb", "1 as at", "'' as name")
    got = survivor.survivors(rows, "k", "id", bundles(), dependencies()).collect()
    assert len(got) == 1 and got[0]["n_ids"] == 60_000 and got[0]["right"]["b"] == 4 and got[0]["third"]["c"] == 0


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a", 1, 1, 1, 1, 1, 1, ""), ("k", None, 1, 1, 1, 1, 1, 1, ""), ("k", "a", None, 1, 1, 1, 1, 1, "")], SCHEMA)
    assert survivor.survivors(df, "k", "id", bundles()).count() == 0
    assert survivor.survivors(spark.createDataFrame([], SCHEMA), "k", "id", bundles(), dependencies()).count() == 0


def test_dates(spark):
    texts = {
        "2024-02-29": (dt.date(2024, 2, 29), 0), "2023-02-29": None, "2024-13-01": None, "2024/06/02": (dt.date(2024, 6, 2), 0), "28/10/2023": (dt.date(2023, 10, 28), 0), "31 Jun 2025": None,
        "12 Apr 2025": (dt.date(2025, 4, 12), 0), "March 15, 2025": (dt.date(2025, 3, 15), 0), "October 2024": (dt.date(2024, 10, 1), 1), "2024-05": (dt.date(2024, 5, 1), 1), "2024": (dt.date(2024, 1, 1), 2),
        "2025-10-17T08:25:00Z": (dt.date(2025, 10, 17), 0), "n.d.": None, "in press": None, "": None, None: None, "0000": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["d"] and (r["d"]["begins"], r["d"]["precision"]) for r in df.select("t", survivor.read_date(F.col("t")).alias("d")).collect()}
    assert got == texts
