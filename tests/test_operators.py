import datetime as dt
import random

import pytest
from pyspark.sql import functions as F


from feedloom.operators import components, dedup, filters, merges, ranking, resolve, series, sessions, tallies


def greedy(rows):
    keys, prints, out = set(), set(), []
    for o, k, f in sorted(rows):
        if (k is not None and k in keys) or (f and f in prints):
            continue
        if k is not None:
            keys.add(k)
        if f:
            prints.add(f)
        out.append(o)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_two_keys(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *"abcdefgh"]), r.choice([None, "", *"pqrstuvw"])) for i in range(60)]
    df = spark.createDataFrame(rows, "o int, k string, f string").repartition(5)
    got = dedup.greedy_two_keys(df, F.col("o"), F.col("k"), F.col("f"))
    assert sorted(x["o"] for x in got.collect()) == greedy(rows)
    assert got.columns == ["o", "k", "f"]


def test_greedy_on_nothing(spark):
    df = spark.createDataFrame([], "o int, k string, f string")
    assert dedup.greedy_two_keys(df, F.col("o"), F.col("k"), F.col("f")).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_resolution_is_greedy_not_transitive(spark):
    # 3 matches 1 by the first key and 2 by the second: it joins 1, and 2 stays.
    rows = [("t", 1, "d1", None), ("t", 2, None, "x"), ("t", 3, "d1", "x"), ("t", 4, None, "x"), ("t", 5, None, None), ("u", 6, "d1", None)]
    df = spark.createDataFrame(rows, "topic string, ord int, k1 string, k2 string")
    of = {r["ord"]: r["entity"] for r in resolve.resolve(df, "topic", "ord", "k1", "k2").collect()}
    groups = sorted(sorted(o for o in of if of[o] == e) for e in set(of.values()))
    assert groups == [[1, 3], [2, 4], [5], [6]]


@pytest.mark.parametrize("seed", range(3))
def test_resolution_equals_one_pass(spark, seed):
    r = random.Random(seed)
    rows = [("t", i, r.choice([None, *"abcde"]), r.choice([None, *"vwxyz"])) for i in range(40)]
    want = resolve.assign((a, b) for _, _, a, b in rows)
    of = {x["ord"]: x["entity"] for x in resolve.resolve(spark.createDataFrame(rows, "topic string, ord int, k1 string, k2 string"), "topic", "ord", "k1", "k2").collect()}
    assert len(of) == len(rows)
    pairs = lambda f: {(i, j) for i in range(40) for j in range(i) if f(i) == f(j)}
    assert pairs(of.get) == pairs(want.__getitem__)


def test_merged_fields(spark):
    schema = "entity string, o int, id string, title string, link string, citations bigint, published string, published_year int, summary string, venue string, publisher string, open_access_pdf string, rights_status string, provider string"
    rows = [("e", 1, "a", "T", "l1", 3, "", None, "short", "", "P", None, "unknown", "X"), ("e", 2, "b", "T2", "l2", -5, "2024-01-01", 2024, "longer text", "V", "Q", "pdf", "verified_open_access", "Y"), ("e", 3, "c", "T3", "l3", None, "2025", 2025, "other txt..", "W", "", "", "x", "X")]
    r = resolve.merged(spark.createDataFrame(rows, schema), "entity", "o").first()
    assert (r["id"], r["citations"], r["published"], r["published_year"], r["summary"], r["venue"], r["publisher"], r["rights_status"], r["providers"]) == ("a", 3, "2024-01-01", 2024, "longer text", "V", "P", "verified_open_access", ["X", "Y"])


def test_parameters():
    assert filters.parse_categories(" ai ,SCIENCE,science,none") == ["AI / ML", "Science"]
    assert filters.parse_categories("none") == [] and filters.parse_categories("  ") is None and filters.parse_categories(None) is None
    assert filters.parse_content_types("Video,x") == ["video"]
    assert [filters.clamp_limit(x) for x in (None, "x", 0, 9999, "25")] == [None, None, 1, 400, 25]


def test_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "Science", ["AI"], "video")], "id int, app_category string, categories array<string>, content_type string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(filters.by_category(df, None)) == [1, 2] and ids(filters.by_category(df, "nope")) == [] and ids(filters.by_category(df, "science")) == [2]
    assert ids(filters.by_content_type(df, "article")) == [1]
    assert ids(df.filter(filters.all_keywords(F.col("categories"), "ai"))) == [2]


def test_upsert_is_idempotent(spark):
    now = F.lit("2026-02-02").cast("timestamp_ntz")
    old = spark.createDataFrame([(1, "a", dt.datetime(2026, 1, 1)), (2, "b", dt.datetime(2026, 1, 1))], "id int, v string, first_seen_at timestamp_ntz")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 1)], "id int, v string, o int")
    once = merges.upsert(old, new.select("id", "v", "o"), ["id"], now=now, order=F.col("o")).select("id", "v", "first_seen_at")
    rows = {r["id"]: (r["v"], str(r["first_seen_at"])[:10]) for r in once.collect()}
    assert rows == {1: ("a", "2026-01-01"), 2: ("d", "2026-01-01"), 3: (None, "2026-02-02")}
    twice = merges.upsert(once, new, ["id"], now=F.lit("2027-01-01").cast("timestamp_ntz"), order=F.col("o")).select("id", "v", "first_seen_at")
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_guards(spark, tmp_path):
    none = spark.createDataFrame([], "id int, topic string")
    some = spark.createDataFrame([(1, "a")], "id int, topic string")
    with pytest.raises(merges.EmptyRun):
        merges.departed(some, none, "id")
    with pytest.raises(merges.EmptyRun):
        merges.write_partitions(none, str(tmp_path / "t"), "topic")
    with pytest.raises(ValueError):
        merges.erased({"t": some}, "id", " ")


def test_partitions_and_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    merges.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "id int, topic string"), path, "topic")
    merges.write_partitions(spark.createDataFrame([(3, "b")], "id int, topic string"), path, "topic")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 3]
    table = str(tmp_path / "s")
    for n in (1, 2):
        merges.swap(spark, spark.range(n), table)
    assert spark.read.parquet(table).count() == 2


def test_ranking(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], i % 2 == 0) for i in range(9)], "id int, g string, x boolean")
    assert [r["id"] for r in ranking.spread(df, "g", F.col("g"), F.col("id"), 2, 5, F.desc("id")).collect()] == [4, 3, 2, 1, 0]
    paid, rest = ranking.budgeted(df, 0.3, 0.1, F.col("id"))
    assert paid.count() == 3 and rest.count() == 6
    items, pools = spark.createDataFrame([("a",), ("z",)], "k string"), spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("a", 0, "w")], "k string, p int, c string")
    got = {r["k"]: r["c"] for r in ranking.pooled_pick(items, pools, "k", "p", "c", F.col("k")).collect()}
    assert got["a"] in ("y", "w") and got["z"] is None


def test_family_rule(spark):
    r = random.Random(2)
    for _ in range(3):
        rows = [("f", i, r.randrange(4), r.random() < 0.3) for i in range(8)]
        kept = None
        canonical = False
        for row in rows:  # a canonical row replaces an earlier variant, afterwards any strictly newer one does
            if kept is None or (row[3] and not canonical) or row[2] > kept[2]:
                kept = row
            canonical = canonical or row[3]
        got = tallies.newest_from_canonical(spark.createDataFrame(rows, "f string, pos int, created int, canonical boolean"), "f", F.col("created"), F.col("canonical"), F.col("pos")).first()
        assert got["created"] == max(x[2] for x in rows[next((i for i, x in enumerate(rows) if x[3]), 0) :])


def test_sparkline(spark):
    one = lambda v, c: spark.range(1).select(series.sparkline(F.array(*map(F.lit, v)) if v else F.array().cast("array<double>"), F.lit(c)).alias("s")).first()["s"]
    assert one([1.0, 3.0], 2.0) == [0.0, 1.0] and one([], 2.0) == [0.5, 0.5] and one([2.0, 2.0], 2.0) == [0.5, 0.5]


def test_session_boundary(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("u", t), ("u", t + dt.timedelta(minutes=30)), ("u", t + dt.timedelta(minutes=60, seconds=1))], "u string, ts timestamp_ntz")
    rows = sessions.sessions(df, "u", "ts").orderBy("session").collect()
    assert [(r["events"], r["active_seconds"]) for r in rows] == [(2, 300.0), (1, 0.0)]


@pytest.mark.parametrize("seed", range(3))
def test_anchored_windows(spark, seed):
    r = random.Random(seed)
    t = dt.datetime(2026, 1, 1)
    rows = sorted((c, t + dt.timedelta(seconds=r.randrange(600))) for c in "ab" for _ in range(80))
    want, state = [], {}
    for c, ts in rows:
        start, n = state.get(c, (None, 0))
        if start is None or (ts - start).total_seconds() >= 60:
            start, n = ts, 0
        state[c] = (start, n + 1)
        want.append((c, ts, n + 1 <= 5))
    df = spark.createDataFrame([(c, ts, i) for i, (c, ts) in enumerate(rows)], "c string, ts timestamp_ntz, i int").repartition(4)
    got = sorted((x["i"], x["allowed"]) for x in sessions.anchored_windows(df, "c", "ts", 5, 60, tie="i").collect())
    assert [a for _, a in got] == [a for _, _, a in want]


def test_level_curve(spark):
    xs = [0, 49, 50, 141, 142, 259, 260, 12345, 10**6]
    want = [max([n for n in range(1, 2000) if int(50 * n**1.5) <= x], default=1) for x in xs]
    df = spark.createDataFrame([(x,) for x in xs], "x bigint")
    assert [r[0] for r in df.select(sessions.level_curve(F.col("x"))).collect()] == want


def test_toggle_twice_is_nothing(spark):
    saved = spark.createDataFrame([(1, "a")], "u int, i string")
    toggles = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (2, "a", 5), (2, "a", 6)], "u int, i string, o int")
    assert sorted(map(tuple, merges.toggled(saved, toggles, ["u", "i"], "o").collect())) == [(1, "a"), (1, "b"), (2, "a")]


def test_extra_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "a", "x", 7, 8)], "o int, k string, f string, n int, count int")
    assert dedup.greedy_two_keys(df, F.col("o"), F.col("k"), F.col("f")).columns == ["o", "k", "f", "n", "count"]




def test_time_of_an_offset_is_clamped(spark):
    from feedloom.operators.documents import time_at

    times = F.array(*map(F.lit, [0.0, 1.23456, 2.5]))
    got = spark.createDataFrame([(x,) for x in (-3.0, 0.6, 1.0, 99.0)], "o double").select(time_at(times, F.col("o")).alias("t")).collect()
    assert [r["t"] for r in got] == [0.0, 1.235, 1.235, 2.5]


def test_funnel_needs_the_order(spark):
    rows = [("a", 1, "s"), ("a", 2, "v"), ("a", 3, "p"), ("b", 1, "v"), ("b", 2, "s"), ("c", 5, "s"), ("c", 5, "v"), (None, 1, "s")]
    df = spark.createDataFrame(rows, "u string, ts int, e string")
    got = {r["step"]: r["reached"] for r in sessions.funnel(df.filter("u is not null"), ["u"], "ts", [F.col("e") == x for x in "svp"]).collect()}
    assert got == {1: 3, 2: 2, 3: 1}
