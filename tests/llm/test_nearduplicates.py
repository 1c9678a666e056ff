import random

import numpy as np
from pyspark.sql import functions as F

from feedloom.llm import nearduplicates as nd
from feedloom.llm.words import words

WORDS = [f"t{i}" for i in range(3000)]


def corpus(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = [r.choice(WORDS) for _ in range(80)]
        out.append((f"a{i}", " ".join(base)))
        for k in range(r.randrange(3)):
            new = list(base)
            for _ in range(r.choice([1, 3, 6, 12])):
                new[r.randrange(80)] = r.choice(WORDS)
            out.append((f"b{i}_{k}", " ".join(new)))
        if i % 10 == 0:
            out.append((f"c{i}", " ".join(base)))
    return out + [("short", "a b c"), ("null", None), ("empty", ""), (None, "x " * 50)]


def brute(rows, width, threshold, least):
    sets = {}
    for i, t in rows:
        ws = words(t)
        if i is not None and len(ws) >= least:
            sets[i] = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_pairs(spark):
    for width, threshold in ((3, 0.5), (5, 0.8)):
        rows = corpus(1)
        df = spark.createDataFrame(rows + rows[:5], "id string, body string")
        members, links = nd.similar_texts(df, "id", F.col("body"), width=width, threshold=threshold, min_words=40)
        want = brute(rows, width, threshold, 40)
        got = {tuple(r) for r in nd.similar_pairs(members, links).collect()}
        assert got <= want and len(got) >= 0.98 * len(want) > 0


def test_groups(spark):
    rows = corpus(2)
    members, links = nd.similar_texts(spark.createDataFrame(rows, "id string, body string"), "id", F.col("body"), width=3, threshold=0.5, min_words=40)
    groups = nd.similar_groups(members, links).collect()
    assert len(groups) == len({r["id"] for r in groups}) == sum(1 for i, t in rows if i is not None and len(words(t)) >= 40)
    of = {r["id"]: r["group_id"] for r in groups}
    assert all(of[a] == of[b] for a, b in (tuple(r) for r in nd.similar_pairs(members, links).collect()))


def test_empty_and_one(spark):
    for rows in ([], [("a", "x " * 50)], [("a", None)]):
        members, links = nd.similar_texts(spark.createDataFrame(rows, "id string, body string"), "id", F.col("body"), min_words=5)
        assert nd.similar_pairs(members, links).count() == 0


def test_a_third_are_copies(spark):
    rows = [(f"x{i}", "one two three four five six seven eight nine ten") for i in range(40)] + corpus(3, 10)
    members, links = nd.similar_texts(spark.createDataFrame(rows, "id string, body string"), "id", F.col("body"), width=3, threshold=0.5, min_words=10)
    assert sum(1 for a, b in (tuple(r) for r in nd.similar_pairs(members, links).collect()) if a[0] == b[0] == "x") == 40 * 39 // 2
    assert links.count() < 30  # copies are one class


def test_long_text(spark):
    rows = [("a", " ".join(map(str, range(60_000)))), ("b", " ".join(map(str, range(60_001))))]
    members, links = nd.similar_texts(spark.createDataFrame(rows, "id string, body string"), "id", F.col("body"))
    assert nd.similar_pairs(members, links).count() == 1


def test_estimate_follows_similarity():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        estimates = []
        for _ in range(40):
            common = r.integers(0, 2**63, 200).astype(np.uint64)
            n = round(200 * (1 - share) / (2 * share))
            a, b = (np.concatenate([common, r.integers(0, 2**63, n).astype(np.uint64)]) for _ in range(2))
            x = nd.sketch([np.unique(a), np.unique(b)], 12)
            estimates.append(nd.estimated((x[0] == x[1]).sum(), x.shape[1]))
        assert abs(np.mean(estimates) - share) < 0.05


def test_few_pairs_at_the_threshold_are_lost(spark):
    """1,500 pairs of similarity 0.5: 38 of the 57 runs of each text are common."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    rows = []
    for k in range(1500):
        common = [word() for _ in range(40)]
        rows += [(f"a{k}", " ".join(common + [word() for _ in range(19)])), (f"b{k}", " ".join(common + [word() for _ in range(19)]))]
    _, links = nd.similar_texts(spark.createDataFrame(rows, "id string, t string"), "id", F.col("t"), width=3, threshold=0.5, min_words=40)
    assert 1500 * 0.995 <= links.count() <= 1500
