import random

import numpy as np

from feedloom.llm import truncation

NOUNS, VERBS, ADJ = "runners swimmers nurses coaches rowers students".split(), "measured raised lowered reported followed".split(), "steady chronic urban novice seasonal".split()


def text(r):
    return " ".join(f"The {r.choice(ADJ)} {r.choice(NOUNS)} {r.choice(VERBS)} {r.choice(ADJ)} recovery after {r.randrange(2, 90)} sessions with {r.choice(NOUNS)}." for _ in range(r.randrange(2, 8)))


def rows(seed, n=600):
    r = random.Random(seed)
    out, cut = [], set()
    for i in range(n):
        t, source = text(r), r.choice(["hard", "marked", "free"])
        if source == "hard" and len(t) > 200:
            t2 = t[:200]
            if not t2.endswith("."):
                cut.add(f"{i}")
            t = t2
        elif source == "marked" and len(t) > 180:
            t = t[:180] + "…"
            cut.add(f"{i}")
        elif r.random() < 0.2:
            t += " Keywords: rest; sleep"
        elif r.random() < 0.05:
            t = t[: len(t) // 2] + "&am"
            cut.add(f"{i}")
        out.append((f"{i}", source, t))
    return out, cut


def test_verdicts(spark):
    data, cut = rows(1)
    df = spark.createDataFrame(data + data[:20] + [("n", "free", None), ("e", "free", ""), (None, "free", "x")], "id string, source string, summary string")
    judged = {r["id"]: r for r in truncation.judge(df, "id", "source", "summary").collect()}
    assert set(judged) == {i for i, _, _ in data}
    found = {i for i, r in judged.items() if r["is_cut"]}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.03 * len(found)
    shares = {r["source"]: r for r in truncation.shares(truncation.judge(df, "id", "source", "summary")).collect()}
    assert sum(r["n_texts"] for r in shares.values()) == len(data) and shares["marked"]["cut_share"] > 0.5


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, source string, summary string")
    assert truncation.judge(df, "id", "source", "summary").count() == 0
    assert truncation.shares(truncation.judge(spark.createDataFrame([("a", None, "One.")], df.schema), "id", "source", "summary")).first()["cut_share"] == 0.0


def test_endings():
    kind = lambda t: truncation._read(t)[0]
    assert [kind(t) for t in ("It is done.", "“It is done.”", "Is it?", "It was (n = 3).")] == ["closed"] * 4
    assert [kind(t) for t in ("It was…", "It was ...", "It was [...]", "It was… (more)", "It w Read more »", "It was [ … ]", "“It was…”", "It was ...)")] == ["marked"] * 8
    assert [kind(t) for t in ("It w�", "It w&am", "It w<su", "It w\\u20", "It w<a href='x")] == ["broken"] * 5
    assert [kind(t) for t in ("It was", "Results (4.", "AT&T", "p < 5 %")] == ["open"] * 4
    assert kind("One … two ... three.") == "closed"


def test_censored_fit():
    r = np.random.default_rng(0)
    x = np.exp(r.normal(5.5, 0.5, 20000))
    values, counts = np.unique(np.minimum(x, 300).round(), return_counts=True)
    at = values == 300
    mu, sigma = truncation.fit_censored(values, np.where(at, 0, counts).astype(float), np.where(at, counts, 0).astype(float))
    assert abs(mu - 5.5) < 0.03 and abs(sigma - 0.5) < 0.03
    spike, posterior = truncation.censoring_by_length(values, np.where(at, counts, counts // 20).astype(float), (counts - np.where(at, counts, counts // 20)).astype(float))
    assert spike[at].all() and posterior[at][0] > 0.9


def test_very_long_text(spark):
    df = spark.createDataFrame([("a", "s", "Word one. " * 50_000), ("b", "s", "Word one. " * 50_000 + "and th…")], "id string, source string, summary string")
    assert {r["id"]: r["is_cut"] for r in truncation.judge(df, "id", "source", "summary").collect()} == {"a": False, "b": True}


def test_fitted_endings():
    """Two classes whose features differ are told apart from a rough start; the weights come from the table alone."""
    r = np.random.default_rng(1)
    n = 6000
    cut = r.random(n) < 0.2
    features = np.stack([
        r.random(n) < np.where(cut, 0.2, 0.01), r.random(n) < np.where(cut, 0.6, 0.02), np.where(cut, r.choice(5, n, p=[0, 0, 0.1, 0.3, 0.6]), r.choice(5, n, p=[0.3, 0.6, 0.08, 0.01, 0.01])),
        np.where(cut, r.choice(4, n, p=[0.1, 0.1, 0.3, 0.5]), r.choice(4, n, p=[0.5, 0.3, 0.1, 0.1])), r.random(n) < 0.1,
    ], axis=1).astype(int)
    patterns, which, counts = np.unique(features, axis=0, return_inverse=True, return_counts=True)
    first = ((patterns[:, 1] == 1) | (patterns[:, 2] >= 4)).astype(float)
    ratios, share, inside = truncation.fit_endings(patterns, np.full(len(patterns), np.nan), counts.astype(float), first)
    score = np.log(share / (1 - share)) + sum(x[features[:, k]] for k, x in enumerate(ratios))
    assert abs(share - 0.2) < 0.02 and abs(inside - 0.6) < 0.05 and ((score > 0) == cut).mean() > 0.97 and abs(ratios[4]).max() < 0.5


def test_limits_in_both_units(spark):
    """One source cuts some values at 150 characters and others at 220 bytes; each is a limit of its own."""
    r = random.Random(9)
    rows = [("s", len(t), len(t.encode()), "closed", False) for t in (text(r) for _ in range(900))]
    rows += [("s", 150, 150 + r.randrange(40), "open", True) for _ in range(60)] + [("s", 220 - r.randrange(1, 60), 220, "open", True) for _ in range(60)]
    df = spark.createDataFrame(rows, "source string, chars int, bytes int, kind string, suspect boolean")
    found = {(x["unit"], x["len"]): x for x in truncation.limits(df).filter("is_limit").collect()}
    assert found["chars", 150]["censored"] > 0.9 and found["bytes", 220]["censored"] > 0.9


def test_the_length_decides_where_endings_do_not(spark):
    """Endings that say little are cut at the limit and whole off it; a sentence's end is no case but counts in the share."""
    data, cut = rows(3)
    r = random.Random(2)
    whole = [(f"w{i}", "hard", text(r)[: r.randrange(60, 190)].rsplit(" ", 1)[0]) for i in range(3)]
    ends = [(f"c{i}", "hard", (text(r) + text(r))[:199].rsplit(" ", 1)[0].rstrip(".").ljust(199, "x") + ".") for i in range(30)]
    df = spark.createDataFrame(data + whole + ends, "id string, source string, summary string")
    judged = {x["id"]: x for x in truncation.judge(df, "id", "source", "summary").collect()}
    assert not any(judged[f"c{i}"]["is_cut"] for i in range(30))
    at = [x["score"] for x in judged.values() if x["kind"] == "closed" and x["source"] == "hard" and x["chars"] == 200]
    off = [x["score"] for x in judged.values() if x["kind"] == "closed" and x["source"] == "free"]
    assert at and min(at) > max(off)
    share = {x["source"]: x for x in truncation.shares(truncation.judge(df, "id", "source", "summary")).collect()}["hard"]
    assert share["expected_share"] > share["cut_share"]
