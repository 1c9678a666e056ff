import random

from pyspark.sql import functions as F

from feedloom.llm import leakage
from feedloom.llm.words import words

V = [f"w{i}" for i in range(12)]


def brute(docs, items, n):
    runs = lambda t: {tuple(ws[i : i + n]) for ws in [words(t)] for i in range(len(ws) - n + 1)}
    return {(d, i) for d, t in docs if d is not None for i, u in items if runs(t) & runs(u)}


def longest(a, b):
    a, b = words(a), words(b)
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            new[j] = row[j - 1] + 1 if x == y else 0
            best = max(best, new[j])
        row = new
    return best


def data(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(V) for _ in range(r.choice([3, 20, 30])))) for i in range(12)] + [(90, ""), (91, None)]
    docs = [(i, " ".join(r.choice([*V, "x", "y"]) for _ in range(r.choice([0, 5, 60])))) for i in range(40)]
    for i in range(40, 60):
        ws = words(r.choice(items[:12])[1])
        a = r.randrange(len(ws))
        docs.append((i, "Zz. " + ", ".join(ws[a : a + r.randrange(4, 15)]).upper() + "! qq"))
    return docs + [(60, None), (61, ""), (None, "w1 w2")], items


def test_found(spark):
    for seed in range(3):
        docs, items = data(seed)
        d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        for block in (10**6, 40):  # one automaton, and several
            got = {(r[0], r[1]): r[2] for r in leakage.find_leaks(d, i, min_words=5, block_words=block).collect()}
            assert set(got) == brute(docs, items, 5)
            text, item = dict(docs), dict(items)
            assert all(n == longest(text[a], item[b]) for (a, b), n in got.items())


def test_removed(spark):
    d = spark.createDataFrame([(1, "Before. One two, three FOUR five! After it all.", "a"), (2, "one two three four five", "b"), (3, None, "c"), (4, "", "d")], "doc_id bigint, text string, item_id string").withColumn("coverage", F.lit("own"))
    i = spark.createDataFrame([(7, "one two three four five six")], "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in leakage.remove_leaks(d, i, min_words=4, max_coverage=0.6).collect()}
    assert rows[1]["text"] == "Before. ! After it all." and rows[1]["leaked_words"] == 5 and not rows[1]["dropped"]
    assert rows[2]["text"] is None and rows[2]["dropped"]
    assert rows[3]["text"] is None and not rows[3]["dropped"] and rows[4]["text"] == "" and rows[1]["item_id"] == "a"


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.find_leaks(d, i).count() == 0
    assert leakage.find_leaks(d, spark.createDataFrame([(1, "a " * 20)], "item_id bigint, text string")).count() == 0


def test_long_text_and_repeats(spark):
    item = " ".join(f"k{i}" for i in range(20))
    d = spark.createDataFrame([(1, "z " * 200_000 + item), (1, "z " * 200_000 + item)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, item), (1, item)], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.find_leaks(d, i).collect()] == [(1, 1, 20)]


def test_several_blocks_a_scan_and_several_scans(spark):
    docs, items = data(7)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {tuple(r) for r in leakage.find_leaks(d, i, min_words=5).collect()}
    for scan in (1, 2, 100):
        assert {tuple(r) for r in leakage.find_leaks(d, i, min_words=5, block_words=40, blocks_a_scan=scan).collect()} == want
    one = {r["doc_id"]: (r["text"], r["leaked_words"]) for r in leakage.remove_leaks(d, i, min_words=5).collect()}
    assert {r["doc_id"]: (r["text"], r["leaked_words"]) for r in leakage.remove_leaks(d, i, min_words=5, block_words=40, blocks_a_scan=2).collect()} == one


def test_items_that_share_a_passage():
    """States of a passage hold one set together, and the longest run of each item is still exact."""
    shared = [f"s{i}" for i in range(30)]
    items = [(k, [f"a{k}", *shared[k % 3 :], f"b{k}"]) for k in range(40)]
    automaton = leakage.Automaton(items, 5)
    assert len({id(x) for x in automaton.items.values()}) < 200
    ws = ["z", *shared[1:20], "y", "a7", *shared[7 % 3 :], "b7"]
    got, _ = automaton.matches(ws)
    assert got == {k: longest(" ".join(ws), " ".join(x)) for k, x in items}
