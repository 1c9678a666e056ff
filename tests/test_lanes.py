"""Lanes, licences and scripts on nulls, ties, empty tables and clashing columns."""

from pyspark.sql import functions as F

from feedloom.operators import briefing, classify, lanes, merges


def test_upgraded_union(spark):
    schema = "k string, id string, citations bigint, trending boolean"
    one = spark.createDataFrame([("a", "1", 1, None), ("b", "2", None, True), (None, "9", 1, True)], schema)
    two = spark.createDataFrame([("a", "3", 7, True), ("a", "4", 8, True), ("b", "5", 9, True)], schema)
    got = {r["k"]: tuple(r)[1:] for r in lanes.union_upgraded([one, two], "k", "id", "trending", ["citations"]).collect()}
    assert got["a"] == ("1", 7, True) and got["b"] == ("2", None, True) and got[None] == ("9", 1, True)
    assert lanes.union_upgraded([one.limit(0), two.limit(0)], "k", "id", "trending", ["citations"]).count() == 0


def test_first_lane(spark):
    a, b = spark.createDataFrame([("x", 1)], "t string, v int"), spark.createDataFrame([("x", 2), ("y", 3), (None, 4)], "t string, v int")
    assert sorted((r["t"] or "", r["v"], r["lane"]) for r in lanes.first_lane([a, b], "t").collect()) == [("", 4, 1), ("x", 1, 0), ("y", 3, 1)]
    assert lanes.first_lane([a.limit(0), b.limit(0)], "t").count() == 0


def test_pool_and_status(spark):
    assert [lanes.pool_size(*x) for x in ((24,), (45,), (90,), (10, 44))] == [40, 45, 50, 44]
    rows = spark.createDataFrame([("p",), ("p",), ("q",)], "provider string")
    assert {tuple(r) for r in lanes.status_of(rows, "provider", ["z"]).collect()} == {("p", 2, "partial"), ("q", 1, "partial")}
    assert {r["status"] for r in lanes.status_of(rows, "provider").collect()} == {"ok"}


def test_goals(spark):
    days = spark.createDataFrame([(19, 0, 20), (12, 1, 20), (12, 0, 20), (5, 5, 0)], "seen int, opened int, available int")
    got = lanes.daily_goals(days, F.col("seen"), F.col("opened"), F.col("available"))
    assert [r["goal"] for r in got.collect()] == [True, True, False, None]
    assert got.select(lanes.day_points(F.col("seen"), F.col("opened"), F.lit(1), F.col("goal"))).first()[0] == 19 * 2 + 15 + 25


def test_sticky_best(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, True), ("a", 3, True), ("b", 5, False), ("b", 4, None)], "k string, o int, e boolean")
    assert {(r["k"], r["o"]) for r in lanes.sticky_best(df, ["k"], F.col("e"), F.col("o")).collect()} == {("a", 2), ("b", 4)}


def test_licences(spark):
    texts = {
        "https://creativecommons.org/licenses/by/4.0/": "CC-BY-4.0", "http://www.creativecommons.org/licenses/by/4.0": "CC-BY-4.0", "https://creativecommons.org/licenses/by-nc/4.0/": None,
        "https://creativecommons.org.evil.example/licenses/by/4.0/": None, "cc0": "CC0-1.0", "CC-BY-3.0": "CC-BY-3.0", "CC BY 4.0": "CC-BY-4.0", "Public Domain Mark 1.0": "PDM-1.0", "": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", classify.licence(F.col("t"))).collect()} == texts
    by4, by3 = "https://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/licenses/by/3.0/"
    many = spark.createDataFrame([([by4, by4],), ([by4, by3],), ([by4, "CC BY 4.0"],), ([by4, None],), ([],)], "v array<string>")
    assert [r[0] for r in many.select(classify.one_licence(F.col("v"))).collect()] == ["CC-BY-4.0", None, None, None, None]


def test_script(spark):
    rows = [("t", 1, "One title.", "of Foo", 2024, 1, ["a", "b"]), ("t", 2, "Two", "Journal of the", None, 1234, None), ("t", 3, "Three " * 30, None, 2025, None, ["a"]), ("u", 1, "Only " * 60, None, None, 0, [])]
    df = spark.createDataFrame(rows, "topic string, o int, title string, venue string, year int, citations bigint, providers array<string>")
    part = briefing.segment(F.col("place"), F.col("topic"), F.col("title"), F.col("venue"), F.col("year"), F.col("citations"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("providers"))
    out = briefing.script(df, "topic", [F.col("o")], part, F.concat(F.lit("Hello. "), briefing.spoken_count(F.col("n")), F.lit(". ")), "Bye.", 300)
    got = {(r["topic"], r["place"]): r for r in out.collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1)} and got["t", 1]["n"] == 2 and got["u", 1]["n"] == 1  # one paper stays, however long
    assert got["t", 1]["segment"] == "First, from t. One title. Published in 2024. It has 1 citation so far. More than one index surfaced this one independently.\n\n"
    assert got["t", 2]["segment"] == "Second, from t. Two. Published in Journal. It has 1,234 citations so far.\n\n"
    assert got["t", 1]["char_start"] == len("Hello. Two papers. ") and got["t", 2]["char_start"] == got["t", 1]["char_end"]
    assert briefing.script(df.limit(0), "topic", [F.col("o")], part, F.lit(""), "").count() == 0


def test_publish(spark, tmp_path):
    """The pointer names the new version; the one before stays for readers that began with it, older ones go."""
    path = str(tmp_path / "t")
    for v in range(4):
        merges.publish(spark, spark.createDataFrame([(v,)], "v int"), path)
        assert merges.published(spark, path).first()[0] == v
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v")) == ["v3", "v4"]


def test_orphans_and_violations(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, "a b"), (2, "c/d"), (3, "e")], "v int, s string")
    merges.write_partitions(rows, path, "s")
    merges.write_partitions(rows.filter("s <> 'e'"), path, "s", whole=True)
    assert sorted(r["s"] for r in spark.read.parquet(path).collect()) == ["a b", "c/d"]
    twice = rows.union(rows.limit(1))
    assert {tuple(r) for r in merges.key_violations({"one": (rows, ("v",)), "two": (twice, ("v", "s"))}).collect()} == {("one", 0), ("two", 1)}
