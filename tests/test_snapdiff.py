import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import snapdiff
from feedloom.plans import problems
from tests.compare import connection

SCHEMA = "snap bigint, id string, title string, citations bigint, delivered_at timestamp_ntz, extra string"


def expected(rows):
    latest = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        k = (r[0], r[1])
        if k not in latest or (r[4] or dt.datetime.min) > (latest[k][4] or dt.datetime.min):
            latest[k] = r
    snaps = sorted({s for s, _ in latest})
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        old = {i: r[2:4] for (s, i), r in latest.items() if s == a}
        new = {i: r[2:4] for (s, i), r in latest.items() if s == b}
        out |= {(b, i, "added") for i in new.keys() - old.keys()} | {(b, i, "removed") for i in old.keys() - new.keys()}
        out |= {(b, i, "changed") for i in new.keys() & old.keys() if new[i] != old[i]}
    return out


def sample(seed, n=400, snaps=(1, 2, 4)):
    r = random.Random(seed)
    rows = []
    for s in snaps:
        for i in range(n):
            if r.random() < 0.9:
                at = dt.datetime(2026, 1, s, i % 24)
                rows.append((s, f"id{i}", r.choice(["a", None, "", "b"]) if r.random() < 0.2 else "a", r.choice([None, 1, 2]) if r.random() < 0.3 else 5, at, "x"))
                if r.random() < 0.1:
                    rows.append(rows[-1])
                if r.random() < 0.1:
                    rows.append((s, f"id{i}", "late", 9, at + dt.timedelta(hours=1), "y"))
    return rows


@pytest.mark.parametrize("bucket_rows,cells,rounds", [(4096, 2048, 3), (64, 6, 3), (64, 3, 1)])
def test_changes(spark, bucket_rows, cells, rounds):
    rows = sample(3) + [(None, "id1", "a", 1, None, ""), (1, None, "a", 1, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in snapdiff.snapshot_changes(df, ["title", "citations"], bucket_rows, cells, rounds).collect()}
    assert got == expected(rows)


def test_few_or_no_snapshots(spark):
    for rows in ([], sample(1, 5, (7,))):
        out = snapdiff.snapshot_changes(spark.createDataFrame(rows, SCHEMA), ["title"])
        assert out.columns == ["snap", "id", "change_kind"] and out.count() == 0


def test_null_is_no_value(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, "a", None, 1, at, ""), (2, "a", "", 1, at, ""), (1, "b", None, None, at, ""), (2, "b", None, None, at, "")]
    out = snapdiff.snapshot_changes(spark.createDataFrame(rows, SCHEMA), ["title", "citations"]).collect()
    assert [tuple(r) for r in out] == [(2, "a", "changed")]


def test_hash_is_sparks(spark):
    ((a, b),) = spark.sql("select xxhash64(11L, 5L, -7L, 99L), xxhash64(0L)").collect()
    assert snapdiff.xxhash64_longs(11, np.array([5]), np.array([-7]), np.array([99]))[0] == a
    assert snapdiff.xxhash64_longs(np.array([0]))[0] == b


def test_first_table_suffices(spark):
    """Changed keys peel: their two rows fall on different cells."""
    rows = [(s, f"id{i}", "a", i + s * (i % 5 == 0), dt.datetime(2026, 1, 1), "") for s in (1, 2) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert snapdiff.snapshot_changes(df, ["citations"], rounds=1, cells=1024).count() == 200


@pytest.mark.parametrize("rounds", [2, 1])
def test_one_pair_alone_fails(spark, rounds):
    """Pair 3 overflows its first table; pairs 2 and 4, which share its snapshots, are not built again from one side."""
    at = dt.datetime(2026, 1, 1)
    value = lambda s, i: (s >= 3) + 10 * (s == 2 and i == 0) + 10 * (s == 4 and i == 1)
    rows = [(s, f"id{i}", "a", value(s, i), at, "") for s in (1, 2, 3, 4) for i in range(200)]
    got = sorted(tuple(r) for r in snapdiff.snapshot_changes(spark.createDataFrame(rows, SCHEMA), ["citations"], cells=240, rounds=rounds).collect())
    assert got == sorted([(2, "id0", "changed"), (4, "id1", "changed"), *((3, f"id{i}", "changed") for i in range(200))])


def test_instants(spark):
    texts = ["2026-06-01T04:49:53.078Z", "2026-05-31T23:49:53.078-05:00", "2026-06-01 04:49:53.078Z", "2026-06-01T04:49:53.078", "junk", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(snapdiff.instant_micros(F.col("t"))).collect()]
    assert len(set(got[:4])) == 1 and got[4:] == [None, None]


@pytest.mark.parametrize("cells", [96, 160, 256, 1024])
def test_table_sizes_at_which_some_buckets_fail(spark, cells):
    """Whether some, all or no buckets can be peeled at first, the rows are those of the SQL."""
    folder = "/root/testdata/sf0.01"
    want = sorted(tuple(r) for r in connection(folder).execute(problems.SQL["p2_found"]).fetchall())
    rows = problems.numbered_snapshots(spark, folder)
    got = sorted(tuple(r) for r in snapdiff.snapshot_changes(rows, problems.COMPARED, bucket_rows=512, cells=cells).collect())
    assert got == want
