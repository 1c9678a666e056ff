import random

from feedloom.llm import packing


def check(rows, capacity):
    used, pieces = {}, {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
        pieces.setdefault(r["item"], []).append((r["start"], r["size"]))
    assert all(u <= capacity for u in used.values()) and sorted(used) == list(range(len(used)))
    assert all(r["used"] == used[r["container"]] and r["unused"] == capacity - r["used"] for r in rows)
    return used, pieces


def test_pack(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([1, 5, 40, 64, 100, 250, 300])) for i in range(700)] + [(i, r.randrange(1, 128)) for i in range(700, 1100)] + [(5000, 128), (5001, 129), (5002, 1000), (5003, 0), (5004, None), (None, 5)]
    df = spark.createDataFrame(sizes, "item bigint, n bigint").repartition(5)
    rows = packing.pack(df, "item", "n", 128, rows_per_salt=100).collect()
    used, pieces = check(rows, 128)
    want = {i: n for i, n in sizes if i is not None and n}
    assert {i: sum(s for _, s in p) for i, p in pieces.items()} == want
    for i, p in pieces.items():
        assert len(p) == (1 if want[i] <= 128 else -(-want[i] // 128))
        assert all(b == a + s for (a, s), (b, _) in zip(sorted(p), sorted(p)[1:]))
    assert len(used) <= 1.05 * -(-sum(want.values()) // 128)


def test_repeated_rows_and_hot_length(spark):
    df = spark.createDataFrame([(1, 60)] * 1000, "item bigint, n bigint")
    used, _ = check(packing.pack(df, "item", "n", 128, rows_per_salt=50).collect(), 128)
    assert len(used) == 500


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "item bigint, n bigint"), "item", "n").count() == 0


def test_plan_places_everything():
    r = random.Random(1)
    for _ in range(20):
        histogram = {r.randrange(1, 101): r.randrange(1, 200) for _ in range(r.randrange(1, 40))}
        left = dict(histogram)
        for taken, times in packing.plan(histogram, 100, classes=25):
            assert sum(n * t for n, t in taken.items()) <= 100 and times > 0
            for n, t in taken.items():
                left[n] -= t * times
        assert not any(left.values())


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world <|endoftext|>"), (2, ""), (3, None), (None, "x")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["tokens"] for r in packing.token_counts(df, "doc_id", "text").collect()}.keys() == {1}


def test_same_containers_in_every_run(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(i, r.randrange(1, 130)) for i in range(500)], "item bigint, n bigint")
    packed = [sorted(map(tuple, packing.pack(x, "item", "n", 128, rows_per_salt=60).collect())) for x in (df.repartition(3), df.repartition(7))]
    assert packed[0] == packed[1]


def test_totals(spark):
    sizes = [(1, 100), (2, 28), (3, 128), (4, 60), (5, 300)]
    t = packing.totals(packing.pack(spark.createDataFrame(sizes, "item bigint, n bigint"), "item", "n", 128), 128).first()
    assert (t["containers"], t["used"], t["unused"], t["lower_bound"]) == (5, 616, 24, 5)
    assert packing.totals(packing.pack(spark.createDataFrame([], "item bigint, n bigint"), "item", "n")).first()["containers"] == 0
