"""Feed predicates and paging. A parameter that is absent (None) filters nothing; one that names only unknown values keeps nothing."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text

#: Categories, each with its full and short label.
CATEGORIES = (
    ("AI / ML", "AI"), ("Robotics", "Robotics"), ("Coding & Dev Tools", "Coding"), ("Startups & Funding", "Startups"), ("Hardware & Gadgets", "Hardware"), ("Learning & Career", "Learning"),
    ("Security", "Security"), ("Crypto / Web3", "Crypto"), ("Science", "Science"), ("Big Tech", "Big Tech"), ("Fitness", "Fitness"), ("Skincare", "Skincare"),
)
CONTENT_TYPES = ("article", "video", "podcast", "paper", "post")


def _label(value: object) -> str:
    return " ".join(unicodedata.normalize("NFKC", str(value or "")).lower().split())


def _listed(value: str | Iterable[str] | None) -> list[str] | None:
    """Comma-separated values; None if nothing but blanks was given."""
    values = [value] if isinstance(value, str) or value is None else list(value)
    if not any((v or "").strip() for v in values):
        return None
    return [_label(p) for v in values for p in (v or "").split(",") if _label(p)]


def parse_categories(value, categories: Sequence[tuple[str, str]] = CATEGORIES) -> list[str] | None:
    """The full labels asked for, in order; [] if all were unknown, None if none were asked for."""
    asked = _listed(value)
    known = {_label(label): full for full, short in categories for label in (full, short)}
    return None if asked is None else list(dict.fromkeys(known[a] for a in asked if a in known))


def parse_content_types(value, known: Sequence[str] = CONTENT_TYPES) -> list[str] | None:
    asked = _listed(value)
    return None if asked is None else list(dict.fromkeys(a for a in asked if a in known))


def one_of(c: Column, values: Sequence[str] | None) -> Column:
    return F.lit(True) if values is None else F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)


def by_category(df: DataFrame, value, column: str = "app_category", categories=CATEGORIES) -> DataFrame:
    return df.filter(one_of(F.col(column), parse_categories(value, categories)))


def by_content_type(df: DataFrame, value, column: str = "content_type", known=CONTENT_TYPES) -> DataFrame:
    """A null type counts as article."""
    return df.filter(one_of(F.coalesce(F.col(column), F.lit("article")), parse_content_types(value, known)))


def all_keywords(categories: Column, value: str | None) -> Column:
    """Every keyword is one of the record's categories, in any case."""
    asked = _listed(value)
    lowered = F.transform(F.coalesce(categories, F.array().cast("array<string>")), F.lower)
    out = F.lit(True)
    for k in asked or []:
        out = out & F.array_contains(lowered, k)
    return out


def contains_text(q: str | None, *columns: Column) -> Column:
    """Substring search over the joined columns, nulls left out."""
    wanted = " ".join((q or "").lower().split())
    return F.lower(F.concat_ws(" ", *columns)).contains(wanted) if wanted else F.lit(True)


def any_of_labels(value: str | None, *columns: Column) -> Column:
    """One of the comma-separated values equals one of the columns, in any case."""
    asked = _listed(value)
    if asked is None:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).isin(*asked), F.lit(False)) if asked else out
    return out


def feed(
    df: DataFrame, *, q: str | None = None, keyword: str | None = None, source: str | None = None, category: str | None = None, content_type: str | None = None, region: str | None = None,
    section: str | None = None, papers: bool | None = None, min_score: int | None = None, score: str = "world_score", scored_only: str | None = None,
) -> DataFrame:
    """Conjunction of all predicates of a feed request. Cheap, column-pruned comparisons; Catalyst pushes what it can."""
    out = by_content_type(by_category(df, category) if category is not None else df, content_type) if content_type is not None else (by_category(df, category) if category is not None else df)
    out = out.filter(any_of_labels(source, F.col("source_id"), F.col("source"))).filter(any_of_labels(region, F.col("region"))).filter(any_of_labels(section, F.col("section")))
    if papers is not None:
        out = out.filter(F.coalesce(F.col("is_paper"), F.lit(False)) == papers)
    if min_score is not None:
        subject = F.col(scored_only) if scored_only else F.lit(True)
        out = out.filter(~subject | (F.coalesce(F.col(score), F.lit(0)) >= min_score))
    if keyword:
        out = out.filter(all_keywords(F.col("categories"), keyword))
    return out.filter(contains_text(q, *[F.col(c) for c in ("title", "summary", "author", "source")], F.array_join("categories", " "))) if q else out


def clamp_limit(limit: object, most: int = 400) -> int | None:
    """1 .. most; None means all, as does anything that is no number."""
    if limit is None or not re.fullmatch(r"\s*-?\d+\s*", str(limit)):
        return None
    return max(1, min(most, int(limit)))


def page(df: DataFrame, order: Sequence[Column], limit: object = None, page: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows of a page in a total order; an offset wins over a page number, which counts from 1."""
    n = clamp_limit(limit)
    start = max(0, offset) if offset is not None else (max(1, page or 1) - 1) * (n or 0)
    out = df.orderBy(*order)
    out = out.offset(start) if start else out
    return out.limit(n) if n else out


def fresh(df: DataFrame, then: Column, now: Column, days: float) -> DataFrame:
    """Rows not older than so many days; unknown instants are too old."""
    from feedloom.functions.dates import seconds_between

    return df.filter(F.coalesce(seconds_between(now, then) <= days * 86400, F.lit(False)))


def relevant(title: Column, summary: Column, section: Column, source_id: Column, *, trusted_sections: Sequence[str], trusted_sources: Sequence[str], off_topic: str, on_topic: str) -> Column:
    """Junk titles out; trusted sections and sources in; off-topic texts need a topical sign, as do all others."""
    hay = F.lower(F.concat_ws(" ", title, summary))
    good, bad = hay.rlike(on_topic), hay.rlike(off_topic)
    trusted = F.coalesce(section.isin(*trusted_sections), F.lit(False)) | F.coalesce(source_id.isin(*trusted_sources), F.lit(False))
    return F.when(text.junk_title(title), False).when(trusted, True).when(bad & ~good, False).otherwise(good)


def commerce(title: Column, categories: Column, title_pattern: str, labels: Sequence[str]) -> Column:
    """Shopping rows: by title pattern, or by a category."""
    lowered = F.transform(F.coalesce(categories, F.array().cast("array<string>")), F.lower)
    return F.lower(text.text_of(title)).rlike(title_pattern) | F.arrays_overlap(lowered, F.array(*map(F.lit, labels)))
