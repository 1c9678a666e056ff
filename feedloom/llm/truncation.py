"""Text values cut off by field limits or in transfer.

Evidence of two kinds is weighed for each value, and each is fitted with the help of the other:

* Length. Per source, the lengths of complete values are fitted by a log-normal distribution by maximum likelihood, in
  which suspect values at a candidate limit count as right-censored: the text was at least that long. A candidate limit, in
  characters or in bytes, is a length with far more suspect values than the fit expects. The posterior of a value being
  censored at its length is the share of suspect values there beyond the expected ones.
* Ending. A sign of omission or a broken escape, entity, tag or code point decides at once. An open ending is described by
  what the corpus itself shows: whether its last word is only the beginning of known words, how often that word ends
  sentences, how often units that begin like the last one stay without a full stop (headlines and closing notes do), and
  whether the unit has the separators that its like usually have. What each of these says is not typed in but fitted: a
  mixture of two classes, cut and whole, over the table of patterns, in which the length's posterior is the prior.

A value that ends behind a sentence is no case, as it stops in no word or sentence; at a limit it counts in the expected
share of its source with the probability that a cut falls there.

All counts cover all rows; they are combined within a batch before the shuffle. Words, unit labels and lengths are joined
by key. What comes to the driver is bounded by the number of patterns. The per-source fit sees one row per distinct length.

Null and empty values have no verdict: they are in no result of `judge`, and no share counts them. Texts of any length are
read whole. Repeated rows of an id count once in shares.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import stage

#: Endings by which senders say that the rest was dropped.
MARKER = re.compile(
    r"(?:…[\"'”’»«)]*|\.{3,}[\"'”’»«)]*|\[\s*(?:…|\.{2,})\s*\]|\(\s*(?:…|\.{2,})\s*\)|[\[(]?\b(?:read|show|see|view|continue reading|learn)\s*more\b[\])]?|[\[(]\s*more\s*[\])]"
    r"|\bcontinue reading|\bmehr lesen|\bweiterlesen|\blire la suite|\ben savoir plus|\bleer más|\bseguir leyendo|\[truncated\]|\(continued\)|\(cont\.?\))\s*[»›>→]*\s*$",
    re.I,
)
#: What a transfer leaves of a code point, entity, tag or escape it broke.
BROKEN = re.compile(r"(?:�|[\ud800-\udfff]|&(?:[a-z]{0,8}|#[0-9]{0,6}|#x[0-9a-fA-F]{0,6})|<[a-z/!][^<>]{0,200}|\\+(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?)$")
CLOSERS = "\"'”’»«›‹)\\]"
CLOSED = re.compile(rf"[.!?][{CLOSERS}]*$")
BOUNDARY = re.compile(rf"[.!?][{CLOSERS}]*\s+")
URL = re.compile(r"https?://\S*[^\s.,;)]|www\.\S*[^\s.,;)]")
TOKEN = re.compile(r"\([^()]{1,24}\)|\[[^\[\]]{1,24}\]|[^\W_]+(?:[-'’][^\W_]+)*")
DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")


def _masked(text: str) -> str:
    return URL.sub("URLADDRESS", text)


def _token(word: str) -> str:
    return DIGITS.sub("9", word).lower()


def _units(text: str) -> list[str]:
    """The sentences or closing notes of a text."""
    units, at = [], 0
    for m in BOUNDARY.finditer(text):
        units.append(text[at : m.end()].strip())
        at = m.end()
    if at < len(text):
        units.append(text[at:].strip())
    return [u for u in units if u]


def _labels(unit: str, alone: bool) -> tuple[str, str]:
    """How a unit begins: two words and one, with digits masked. Units that are the whole text are counted apart."""
    ws = unit.split(None, 2)[:2]
    first = DIGITS.sub("9", ws[0]) if ws else ""
    second = DIGITS.sub("9", ws[1]) if len(ws) > 1 else ""
    own = "1" if alone else "n"
    if first.endswith((":", "–", "-")) or (first and not first[0].isalnum() and len(first) == 1):
        return f"{own}|{first}", f"{own}|{first}"
    if second.endswith((":", "–")):
        second = second.rstrip(":–")
    return f"{own}|{first} {second}", f"{own}|{first}"


def _signature(unit: str) -> str:
    """A unit's separators, and its number of words up to three."""
    return "".join(re.findall(r"[:;,–|]", unit)) + str(min(3, len(unit.split())))


def _read(text: str) -> tuple:
    """(kind, last token, label of two, label of one, signature, unbalanced) of a non-empty text."""
    t = text.rstrip()
    if MARKER.search(t):
        return ("marked",) + (None,) * 4 + (False,)
    if BROKEN.search(text):
        return ("broken",) + (None,) * 4 + (False,)
    m = _masked(t)
    units = _units(m)
    unit = units[-1] if units else ""
    unbalanced = unit.count("(") > unit.count(")") or unit.count("[") > unit.count("]")
    if CLOSED.search(t) and not unbalanced:
        return ("closed",) + (None,) * 4 + (False,)
    tokens = TOKEN.findall(unit)
    ends_in_token = bool(tokens) and unit.endswith(tokens[-1])
    two, one = _labels(unit, len(units) == 1)
    # White space at the end, or a separator, shows that something was to follow.
    dangling = text != t or not (ends_in_token or unit[-1:] in CLOSERS.replace("\\", ""))
    return ("open", _token(tokens[-1]) if tokens else "", two, one, _signature(unit), unbalanced or dangling)


_READ = (
    "what string, id string, source string, chars int, bytes int, kind string, last string, two string, one string, signature string, "
    "loose boolean, key string, a bigint, b bigint"
)
_COLUMNS = [c.split()[0] for c in _READ.split(", ")]


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per value, and this batch's counts of words and labels."""
    for pdf in batches:
        rows: list[tuple] = []
        inner: Counter = Counter()
        final: Counter = Counter()
        closed: Counter = Counter()
        opened: Counter = Counter()
        for id_, source, text in zip(pdf["id"], pdf["source"], pdf["text"]):
            if not text:
                continue
            kind, last, two, one, signature, loose = _read(text)
            rows.append(("row", id_, source, len(text), len(text.encode("utf-8", "surrogatepass")), kind, last, two, one, signature, loose, None, None, None))
            units = _units(_masked(text.rstrip()))
            for i, unit in enumerate(units):
                tokens = TOKEN.findall(unit)
                if not tokens:
                    continue
                done = i + 1 < len(units) or kind == "closed"
                if not done and kind != "open":
                    continue  # what a marker or a broken end follows may be a part of a word
                inner.update(map(_token, tokens[:-1]))
                alone = len(units) == 1
                labels = {*_labels(unit, alone), "1|*" if alone else "n|*"}
                if done:
                    final[_token(tokens[-1])] += 1
                    closed.update(labels)
                elif kind == "open":
                    opened.update(labels)
                    opened.update(f"{label}|{signature}" for label in labels)
                    opened["w|" + _token(tokens[-1])] += 1
                    if alone:
                        opened["a|" + _token(tokens[-1])] += 1
        counts = [("word", k, inner[k], final[k]) for k in inner.keys() | final.keys()]
        counts += [("label", k, opened[k], closed[k]) for k in opened.keys() | closed.keys()]
        rows += [(w,) + (None,) * 10 + (k, a, b) for w, k, a, b in counts]
        yield pd.DataFrame(rows, columns=_COLUMNS)


# --- lengths ---------------------------------------------------------------------------------------------------------

_erf = np.vectorize(math.erf, otypes=[float])


def _survival(z: np.ndarray) -> np.ndarray:
    return np.maximum(1e-12, 0.5 * (1 - _erf(z / math.sqrt(2))))


def fit_censored(lengths: np.ndarray, complete: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of the log-length by maximum likelihood; `censored` values are only known to be at least so long.

    Expectation-maximisation for the right-censored normal distribution of the logarithm.
    """
    x = np.log(lengths)
    n = complete.sum() + censored.sum()
    mu = float(np.average(x, weights=complete + censored))
    sigma = max(0.05, float(np.sqrt(np.average((x - mu) ** 2, weights=complete + censored))))
    for _ in range(60):
        z = (x - mu) / sigma
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / _survival(z)
        expected = mu + sigma * hazard
        second = mu * mu + sigma * sigma + sigma * (x + mu) * hazard
        m = float((complete @ x + censored @ expected) / n)
        s = math.sqrt(max(0.0025, float((complete @ (x * x) + censored @ second) / n - m * m)))
        if abs(m - mu) < 1e-6 and abs(s - sigma) < 1e-6:
            break
        mu, sigma = m, s
    return mu, sigma


def censoring_by_length(lengths: np.ndarray, opened: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a candidate limit, posterior of being censored) of open-ended values, at each length of one source."""
    spike = np.zeros(len(lengths), bool)
    expected = np.zeros(len(lengths))
    for _ in range(3):
        mu, sigma = fit_censored(lengths, closed + np.where(spike, 0, opened), np.where(spike, opened, 0).astype(float))
        z = (np.log(lengths) - mu) / sigma
        density = np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * sigma * lengths)
        # Open endings of complete values follow the share they have away from the limits.
        away = ~spike
        share = (opened[away].sum() + 1) / (opened[away].sum() + closed[away].sum() + 2)
        expected = (opened.sum() + closed.sum()) * density * share
        before, spike = spike, opened > expected + 3 * np.sqrt(expected) + 3
        if (spike == before).all():
            break
    posterior = np.where(opened > 0, (opened - expected) / np.maximum(1, opened), 0.0)
    return spike, np.where(spike, np.clip(posterior, 0.05, 0.995), 0.0)


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's limits in characters and in bytes: a length may be one in either, or in both."""
    found = []
    for unit, part in sorted(pdf.groupby("unit")):
        part = part.sort_values("len")
        suspects, others, closed = (part[c].to_numpy(float) for c in ("suspects", "others", "closed"))
        spike, posterior = censoring_by_length(part["len"].to_numpy(float), suspects, others + closed)
        cut = posterior * suspects
        opened = part["open_suspects"].to_numpy(float)
        found.append(pd.DataFrame({
            "source": part["source"], "unit": unit, "len": part["len"], "is_limit": spike, "censored": posterior,
            "prior": posterior * opened / np.maximum(1, opened + others), "to_closed": cut / np.maximum(1, closed),
        }))
    return pd.concat(found)


# --- endings -------------------------------------------------------------------------------------------------------------

#: What the endings of open values are judged by, and how many different values each has.
FEATURES = {"loose": 2, "mid_word": 2, "begins": 5, "word": 4, "unusual": 2}


def fit_endings(patterns: np.ndarray, prior: np.ndarray, counts: np.ndarray, first: np.ndarray, smoothing: float = 0.5, rounds: int = 50) -> tuple[list[np.ndarray], float, float]:
    """The log-likelihood ratio (cut against whole) of every value of every feature, the share of cut values off the limits,
    and how many of the cut values break off inside a word.

    A mixture of two classes with independent features, by expectation-maximisation over the table of patterns: patterns, one
    row each; prior, that of the length (nan off the limits, where the share is estimated); counts, how many values show the
    pattern; first, where to start: the probability that a pattern is cut.
    """
    cut = first.astype(float)
    off = np.isnan(prior)
    for _ in range(rounds):
        share = float(((cut * counts)[off].sum() + 1) / (counts[off].sum() + 10))
        ratios = []
        for k, n in enumerate(FEATURES.values()):
            held = [np.bincount(patterns[:, k], w * counts, minlength=n) + smoothing for w in (cut, 1 - cut)]
            ratios.append(np.log(held[0] / held[0].sum()) - np.log(held[1] / held[1].sum()))
        p = np.where(off, share, np.nan_to_num(prior, nan=0.5))
        odds = np.log(p / (1 - p)) + sum(r[patterns[:, k]] for k, r in enumerate(ratios))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - cut).max() < 1e-6:
            break
        cut = new
    inside = patterns[:, [*FEATURES].index("mid_word")] == 1
    return ratios, share, float(((cut * counts)[inside].sum() + 0.5) / ((cut * counts).sum() + 1))


# --- verdicts --------------------------------------------------------------------------------------------------------


def limits(rows: DataFrame) -> DataFrame:
    """(source, unit, len, is_limit, censored, prior, to_closed) of rows (source, chars, bytes, kind, suspect).

    Limits hold for characters or bytes. censored is the posterior of a suspect value of that length; prior that of an open
    value before its ending is looked at; to_closed the number of cut values there for each closed one.
    """
    sized = rows.select("source", "suspect", "kind", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "len"))
    opened, suspect = F.col("kind") == "open", F.col("suspect")
    histogram = sized.groupBy("source", "unit", "len").agg(
        F.count_if(suspect).alias("suspects"), F.count_if(opened & suspect).alias("open_suspects"), F.count_if(opened & ~suspect).alias("others"),
        F.count_if(~opened & ~suspect).alias("closed"),
    )
    return histogram.groupBy("source").applyInPandas(
        _limits, "source string, unit string, len int, is_limit boolean, censored double, prior double, to_closed double"
    )


def _with_limits(rows: DataFrame, at: DataFrame, *values: str) -> DataFrame:
    """rows with these values of their length, the larger of characters and bytes; null off the limits."""
    for unit in ("chars", "bytes"):
        rows = rows.join(at.filter(F.col("unit") == unit).select("source", F.col("len").alias(unit), *[F.col(v).alias(f"{v}_{unit}") for v in values]), ["source", unit], "left")
    for v in values:
        rows = rows.withColumn(v, F.greatest(f"{v}_chars", f"{v}_bytes")).drop(f"{v}_chars", f"{v}_bytes")
    return rows


def judge(records: DataFrame, id: str, source: str, text: str, *, base: float = 0.12) -> DataFrame:
    """(id, source, chars, kind, censored, score, is_cut): one row per id with a non-empty text.

    kind is how the text ends: marked, broken, closed or open. censored is the length's posterior (0 off the limits);
    score is the log-odds of being cut, is_cut says whether it is positive. base: the share of cut values among
    open-ended ones away from the limits, to start from. An id with several texts is cut if one of them is.
    """
    typed = records.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    read = stage(typed.filter("id is not null and text is not null and text <> ''").mapInPandas(_reader, _READ), "endings")
    rows = read.filter("what = 'row'").drop("what", "key", "a", "b").distinct()
    counts = stage(read.filter("what <> 'row'").groupBy("what", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "ending-counts")
    word = counts.filter("what = 'word'").select(F.col("key").alias("last"), F.col("a").alias("inner"), F.col("b").alias("final"))
    label = counts.filter("what = 'label'").select("key", F.col("a").alias("opened"), F.col("b").alias("closed"))
    longer = (
        word.filter("last rlike '^[^0-9(\\\\[]'").select("last", F.explode(F.expr("sequence(1, greatest(1, length(last) - 1))")).alias("n"))
        .select(F.expr("substring(last, 1, n)").alias("last")).distinct().withColumn("begins_word", F.lit(True))
    )
    two = label.select(F.col("key").alias("two"), F.col("opened").alias("o2"), F.col("closed").alias("c2"))
    one = label.select(F.col("key").alias("one"), F.col("opened").alias("o1"), F.col("closed").alias("c1"))
    signed = label.select(F.col("key").alias("sig_key"), F.col("opened").alias("os"))
    ends = label.select(F.col("key").alias("end_key"), F.col("opened").alias("at_end"))
    alone = label.select(F.col("key").alias("alone_key"), F.col("opened").alias("at_end_alone"))
    # Two rows, so every open value can hold them: how often units of whole and of longer texts stay open.
    all_ = {r["key"]: (r["opened"], r["closed"]) for r in label.filter(F.col("key").isin("1|*", "n|*")).collect()}
    of_all = lambda i: F.when(F.col("one").startswith("1|"), F.lit(all_.get("1|*", (0, 0))[i])).otherwise(F.lit(all_.get("n|*", (0, 0))[i]))
    seen = (
        rows.filter("kind = 'open'").withColumn("sig_key", F.concat_ws("|", "two", "signature")).withColumn("end_key", F.concat(F.lit("w|"), "last"))
        .withColumn("alone_key", F.concat(F.lit("a|"), "last")).withColumn("o0", of_all(0)).withColumn("c0", of_all(1))
        .join(word, "last", "left").join(longer, "last", "left").join(two, "two", "left").join(one, "one", "left")
        .join(signed, "sig_key", "left").join(ends, "end_key", "left").join(alone, "alone_key", "left")
        .fillna(0, ["inner", "final", "o1", "c1", "o2", "c2", "os", "at_end", "at_end_alone"]).fillna(False, ["begins_word"])
    )
    known = F.col("inner") + F.col("final")
    # A label seen often enough speaks for itself, else the first word does, else all units of whole or longer texts.
    often, once = F.col("o2") + F.col("c2") >= 8, F.col("o1") + F.col("c1") >= 8
    o, c = (F.when(often, F.col(f"{x}2")).when(once, F.col(f"{x}1")).otherwise(2 * F.col(f"{x}0") / (F.col("o0") + F.col("c0") + 1) + F.col(f"{x}1")) for x in "oc")
    usually_open = (o + 0.2) / (o + c + 0.8)
    # A word that only ends open texts is whole if headlines, texts of one unit, often end with it.
    mid_word = F.col("begins_word") & (known <= 0) & ~((F.col("at_end") >= 3) & (F.col("at_end_alone") >= 0.3 * F.col("at_end")))
    natural_end = (F.col("at_end") >= 3) & (F.col("at_end") >= 9 * F.col("inner")) & ~F.col("begins_word") | F.col("last").contains("urladdress")
    ending = (F.col("inner") + 1.0) / (F.col("final") + F.col("at_end") + 1.0)
    unusual = (F.col("o2") >= 8) & (F.col("c2") * 10 <= F.col("o2")) & (F.col("os") * 20 <= F.col("o2"))
    features = {
        "loose": F.col("loose").cast("int"), "mid_word": mid_word.cast("int"),
        # How the last unit begins or ends: 0 as open ends do, 1 as open units do, then ever less so.
        "begins": F.when(natural_end, 0).when((usually_open >= 0.6) & ~mid_word, 1).when(usually_open >= 0.2, 2).when(usually_open >= 0.05, 3).otherwise(4),
        # Does the last word end sentences, stand in either place, or stand inside only?
        "word": F.when(known <= 0, 0).when(ending < 3, 1).when(ending < 24, 2).otherwise(3), "unusual": unusual.cast("int"),
    }
    columns = ["id", "source", "chars", "bytes", "kind"]
    opened = stage(seen.select(*columns, *[f.alias(n) for n, f in features.items()]), "open-endings")
    others = rows.filter("kind <> 'open'").select(*columns)
    # To start from: what hangs loose, breaks off inside a word or has nothing of an ending is suspected.
    odd = (F.col("loose") == 1) | (F.col("mid_word") == 1) | (F.col("unusual") == 1) | (F.col("begins") >= 3) & (F.col("word") >= 1)
    suspect, ratios, share, inside, at = odd & (F.col("begins") > 0), [np.zeros(n) for n in FEATURES.values()], base, 0.5, None
    for _ in range(2):  # lengths and endings are judged by turns
        guessed = opened.select(*columns, suspect.alias("suspect")).unionByName(others.withColumn("suspect", F.col("kind") == "marked"))
        at = stage(limits(guessed).filter("is_limit"), "length-limits")
        # At most as many rows as there are patterns and hundredths.
        table = (
            _with_limits(opened.withColumn("suspect", suspect), at, "prior").groupBy(*FEATURES, F.round("prior", 2).alias("prior"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("suspect").cast("double")).alias("first")).toPandas()
        )
        if len(table):
            prior = np.clip(table["prior"].to_numpy(float), 0.01, 0.99)
            ratios, share, inside = fit_endings(table[[*FEATURES]].to_numpy(np.int64), prior, table["n"].to_numpy(float), table["first"].to_numpy(float))
        evidence = F.lit(0.0)
        for n, r in zip(FEATURES, ratios):
            evidence = evidence + F.element_at(F.array(*[F.lit(float(x)) for x in r]), F.col(n) + 1)
        suspect = evidence + math.log(share / (1 - share)) > 0
    # A cut that falls between words falls behind a sentence as often as words end one.
    ends = word.agg(F.sum("final").alias("f"), F.sum("inner").alias("i")).first()
    at_end = (1 - inside) * ((ends["f"] or 0) + 1) / ((ends["f"] or 0) + (ends["i"] or 0) + 2)
    judged = (
        _with_limits(opened.select(*columns, evidence.alias("evidence")), at, "prior", "censored").withColumn("to_closed", F.lit(None).cast("double"))
        .unionByName(_with_limits(others.withColumn("evidence", F.lit(None).cast("double")), at, "prior", "censored", "to_closed"))
    )
    logit = lambda p: F.log(p / (1 - p))
    likely = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.coalesce("prior", F.lit(share))))
    behind_a_sentence = F.greatest(F.lit(1e-4), F.least(F.lit(0.95), F.coalesce("to_closed", F.lit(0.0)) * at_end / (1 - at_end)))
    score = F.when(F.col("kind") == "open", logit(likely) + F.col("evidence")).when(F.col("kind") == "closed", logit(behind_a_sentence)).otherwise(9.0)
    # What ends behind a sentence stops in no word or sentence: it counts in shares as likely as it is cut, and is no case.
    both = judged.select(
        "id", "source", "chars", "kind", F.coalesce("censored", F.lit(0.0)).alias("censored"), score.alias("score"), ((score > 0) & (F.col("kind") != "closed")).alias("is_cut")
    )
    return both.groupBy("id").agg(F.max_by(F.struct("source", "chars", "kind", "censored", "score", "is_cut"), F.struct("is_cut", "score", "chars")).alias("v")).select("id", "v.*")


def shares(judged: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, cut_share, expected_share) of the non-empty texts of each source.

    expected_share is the mean probability of being cut, in which texts at a limit that happen to end behind a sentence take
    part.
    """
    expected = F.avg(1 / (1 + F.exp(-F.col("score"))))
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("is_cut").cast("bigint")).alias("n_cut"), F.avg(F.col("is_cut").cast("double")).alias("cut_share"),
        F.round(expected, 6).alias("expected_share"),
    )
