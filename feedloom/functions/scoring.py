"""Explainable scores as column expressions. Halves round up, as floor(x + 0.5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions import dates, text

#: Fixed values of the world score: weights, saturation in citations a year, half-life in days.
WEIGHTS = {"impact": 0.42, "recency": 0.24, "venue": 0.16, "corroboration": 0.11, "access": 0.07}
CITATIONS_A_YEAR, HALF_LIFE_DAYS = 150, 400

#: Venues of the first rank (whole names), of preprints, and of the further ranks (whole words, first hit counts).
FLAGSHIPS = (
    "nature", "science", "cell", "the lancet", "lancet", "jama", "pnas", "proceedings of the national academy of sciences", "new england journal of medicine", "nejm",
)
PREPRINTS = ("arxiv", "biorxiv", "medrxiv", "ssrn", "preprint", "preprints", "chemrxiv", "psyarxiv", "osf")
TIERS = (
    (0.85, (
        "nature communications", "nature medicine", "nature methods", "nature machine intelligence", "nature physics", "nature genetics", "nature biotechnology",
        "nature materials", "nature neuroscience", "nature energy", "nature astronomy", "nature climate change", "nature chemistry", "science advances", "science robotics",
        "science translational medicine", "neurips", "advances in neural information processing systems", "icml", "international conference on machine learning", "iclr", "cvpr",
        "iccv", "eccv", "acl", "emnlp", "naacl", "siggraph", "usenix security", "ieee symposium on security and privacy", "acm ccs", "ndss", "sosp", "osdi", "stoc", "focs", "aaai", "kdd",
    )),
    (0.75, (
        "ieee transactions", "acm transactions", "physical review letters", "physical review x", "journal of the american chemical society", "nucleic acids research",
        "the astrophysical journal", "monthly notices of the royal astronomical society", "elife", "bmj", "circulation", "journal of clinical oncology", "cell reports",
        "cell metabolism", "immunity", "neuron", "joule", "matter", "chem",
    )),
    (0.62, (
        "ieee", "acm", "springer", "elsevier", "wiley", "oxford university press", "cambridge university press", "physical review", "journal of", "annals of", "proceedings of",
    )),
    (0.5, ("plos", "plos one", "frontiers in", "scientific reports", "scientific data", "patterns", "iscience", "communications biology", "communications physics")),
    (0.38, ("mdpi", "sensors", "applied sciences", "sustainability", "electronics", "ieee access", "heliyon", "cureus", "hindawi", "scirp")),
)
UNKNOWN_VENUE, PREPRINT_VENUE = 0.45, 0.55


def rounded(x: Column, digits: int = 4) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def venue_score(venue: Column, tiers: Sequence[tuple[float, Sequence[str]]] = TIERS) -> Column:
    t = text.alnum_words(venue)
    score = F.lit(UNKNOWN_VENUE)
    for value, phrases in reversed(list(tiers)):
        score = F.when(text.has_phrase(t, phrases), value).otherwise(score)
    return F.when(t == "", UNKNOWN_VENUE).when(t.isin(*FLAGSHIPS), 1.0).when(text.has_phrase(t, PREPRINTS), PREPRINT_VENUE).otherwise(score)


def citations_a_year(citations: Column, published: Column, now: Column) -> Column:
    """The age counts as one year at least; undated work has none."""
    years = F.greatest(F.lit(1.0), dates.age_days(published, now) / 365.25)
    return F.when(published.isNull(), 0.0).otherwise(F.greatest(F.lit(0), F.coalesce(citations, F.lit(0))) / years)


def impact(per_year: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(1 + per_year) / F.log10(F.lit(1.0 + CITATIONS_A_YEAR)))


def recency(published: Column, now: Column) -> Column:
    return F.when(published.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), dates.age_days(published, now) / HALF_LIFE_DAYS))


def corroboration(providers: Column) -> Column:
    n = F.coalesce(F.size(providers), F.lit(1))
    return F.when(n >= 3, 1.0).when(n == 2, 0.78).otherwise(0.4)


def access(open_pdf: Column, full_text: Column, rights: Column) -> Column:
    return F.when(text.truthy(open_pdf), 1.0).when(F.coalesce(full_text, F.lit(False)) | (F.coalesce(rights, F.lit("")) == "verified_open_access"), 0.85).otherwise(0.35)


def score_breakdown(citations, published, venue, providers, open_pdf, full_text, rights, now) -> Column:
    """The parts of the world score, each rounded to four digits."""
    per_year = citations_a_year(citations, published, now)
    parts = {
        "impact": impact(per_year), "recency": recency(published, now), "venue": venue_score(venue), "corroboration": corroboration(providers),
        "access": access(open_pdf, full_text, rights), "citations_per_year": per_year,
    }
    return F.struct(*[rounded(v).alias(k) for k, v in parts.items()])


def world_score(breakdown: Column) -> Column:
    """0 .. 100, of the rounded parts."""
    return F.floor(100 * sum((breakdown[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) + 0.5).cast("int")


def trend_score(trending: Column, citations: Column, published: Column, now: Column) -> Column:
    clamp = lambda x, a, b: F.least(F.lit(b), F.greatest(F.lit(a), F.floor(x + 0.5)))
    c = F.coalesce(citations, F.lit(0))
    days = dates.age_days(published, now)
    return (
        F.when(F.coalesce(trending, F.lit(False)) & (c > 0), clamp(c / 25, 20, 99)).when(published.isNotNull(), clamp(45 - days, 1, 70))
        .when(c > 0, F.least(F.lit(60), F.floor(c / 40 + 0.5))).otherwise(5).cast("int")
    )


# --- posts -----------------------------------------------------------------------------------------------------------------


def sentiment(lowered: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    p, n = F.size(text.lexicon_hits(lowered, positive)), F.size(text.lexicon_hits(lowered, negative))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p - n) / F.greatest(F.lit(2), p + n)))


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.15, "positive").when(score < -0.15, "negative").otherwise("neutral")


METRICS = r"(?i)(^|[^a-z0-9_])\d[\d,.]*\s?(%|(x|b|m|k|billion|million|tokens?|gpus?|params?|days?|hours?)([^a-z0-9_]|$))"


def newsworthiness(
    raw: Column, *, banter: Sequence[str], announce: Sequence[str], tech: Sequence[str], business: Sequence[str], lang: Column | None = None, is_reply: Column | None = None,
    is_repost: Column | None = None, likes: Column | None = None, reposts: Column | None = None, urls: Column | None = None, has_media: Column | None = None, weight: Column | None = None,
) -> Column:
    """struct(score, worthy, category, reasons) of a post; lexicons are arguments."""
    t = F.lower(text.squashed(raw))
    no = F.lit(False)
    hits = {k: text.lexicon_hits(t, v) for k, v in (("banter", banter), ("announce", announce), ("tech", tech), ("business", business))}
    n = {k: F.size(v) for k, v in hits.items()}
    bonus = lambda k, first, each, most: F.when(n[k] > 0, first + each * F.least(n[k] - 1, F.lit(most))).otherwise(0)
    length = F.length(F.trim(text.text_of(raw)))
    eng = F.coalesce(likes if likes is not None else F.lit(0), F.lit(0)) + 3 * F.coalesce(reposts if reposts is not None else F.lit(0), F.lit(0))
    crowd = F.least(F.lit(18), F.floor(6 * F.log10(eng + 1.0) + 0.5))
    substance = n["announce"] + n["tech"] + n["business"] > 0
    w = F.coalesce(weight if weight is not None else F.lit(0), F.lit(0))
    foreign = F.coalesce(lang != "en", no) if lang is not None else no
    reply = F.coalesce(is_reply, no) if is_reply is not None else no
    repost = F.coalesce(is_repost, no) if is_repost is not None else no
    linked = F.coalesce(urls, F.lit(0)) > 0 if urls is not None else no
    media = F.coalesce(has_media, no) if has_media is not None else no
    metrics = F.coalesce(raw, F.lit("")).rlike(METRICS)
    points = lambda cond, x: F.when(cond, x).otherwise(0)
    total = (
        30 + points(foreign, -25) + points(reply, -28) + F.when(length < 25, -22).when(length > 90, 6).otherwise(0) - 12 * F.least(n["banter"], F.lit(3))
        + bonus("announce", 22, 8, 3) + bonus("tech", 10, 5, 4) + bonus("business", 14, 6, 3) + points(linked, 10) + points(media, 4) + points(eng > 0, crowd)
        + points(metrics, 8) + F.when(substance, w).otherwise(F.least(F.lit(2), w))
    )
    score = F.when(repost, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("int")
    worthy = ~repost & (score >= 55)
    money = t.rlike(r"(^|[^a-z0-9_])(rais|fund|valuation|ipo|acqui|million|billion)([^a-z0-9_]|$)")
    category = (
        F.when(repost, "Commentary").when((n["business"] > 0) & money, "Funding & deals")
        .when(t.rlike(r"(^|[^a-z0-9_])(research|paper|preprint|benchmark|sota|reasoning|training)([^a-z0-9_]|$)"), "Research")
        .when((n["announce"] > 0) & (n["tech"] > 0), "Product launch").when(n["announce"] > 0, "Announcement").when(n["tech"] > 0, "Product").otherwise("Commentary")
    )
    listed = lambda k: F.array_join(F.slice(hits[k], 1, 3), ", ")
    reasons = F.array_compact(F.array(
        F.when(worthy, "report-worthy"), F.when(foreign, F.concat(F.lit("non-English ("), lang if lang is not None else F.lit(""), F.lit(")"))), F.when(reply, "reply / conversation"),
        F.when(length < 25, "very short"), F.when(n["banter"] > 0, F.concat(F.lit("casual tone ("), listed("banter"), F.lit(")"))),
        F.when(n["announce"] > 0, F.concat(F.lit("announcement language ("), listed("announce"), F.lit(")"))),
        F.when(n["tech"] > 0, F.concat(F.lit("tech substance ("), listed("tech"), F.lit(")"))),
        F.when(n["business"] > 0, F.concat(F.lit("business signal ("), listed("business"), F.lit(")"))),
        F.when(linked, "links to a source"), F.when(eng >= 1000, "high engagement"), F.when(metrics, "concrete metrics"),
    ))
    return F.struct(score.alias("score"), worthy.alias("worthy"), category.alias("category"), F.when(repost, F.array(F.lit("repost"))).otherwise(reasons).alias("reasons"))
