"""A script to read aloud, put together from ranked papers, with the place of each in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.functions.text import text_of

#: How the first places, and small counts, are spoken.
ORDINALS = ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh", "Twelfth")
COUNTS = ("Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve")


def spoken_count(n: Column) -> Column:
    word = F.coalesce(F.get(F.array(*map(F.lit, COUNTS)), n.cast("int")), n.cast("string"))
    return F.when(n == 1, "One paper").otherwise(F.concat(word, F.lit(" papers")))


def spoken_source(venue: Column, year: Column) -> Column:
    v = text.usable_venue(text.speakable(venue, 90))
    return (
        F.when((v != "") & year.isNotNull(), F.concat(F.lit("Published in "), v, F.lit(", "), year.cast("string"), F.lit(".")))
        .when(v != "", F.concat(F.lit("Published in "), v, F.lit("."))).when(year.isNotNull(), F.concat(F.lit("Published in "), year.cast("string"), F.lit(".")))
    )


def spoken_citations(citations: Column, a_year: Column) -> Column:
    n = F.coalesce(citations, F.lit(0))
    times = F.format_number(n, 0)
    return (
        F.when(n <= 0, "It is new enough that the citation count has not caught up yet.")
        .when(F.coalesce(a_year, F.lit(0.0)) >= 10, F.concat(F.lit("It has "), times, F.lit(" citations, running at about "), F.floor(a_year + 0.5).cast("string"), F.lit(" a year.")))
        .otherwise(F.concat(F.lit("It has "), times, F.when(n == 1, " citation so far.").otherwise(" citations so far.")))
    )


def segment(place: Column, topic: Column, title: Column, venue: Column, year: Column, citations: Column, a_year: Column, lead: Column, providers: Column) -> Column:
    """One paper's part of the script; parts that have nothing to say are left out."""
    ordinal = F.coalesce(F.get(F.array(*map(F.lit, ORDINALS)), place - 1), F.concat(F.lit("Number "), place.cast("string")))
    quoted = F.when(text_of(lead) != "", F.concat(F.lit("In the authors' own words: "), lead))
    twice = F.when(F.size(F.coalesce(providers, F.array().cast("array<string>"))) >= 2, F.lit("More than one index surfaced this one independently."))
    return F.concat(F.concat_ws(
        " ", F.concat(ordinal, F.lit(", from "), text.speakable(F.coalesce(topic, F.lit("research")), 60), F.lit(".")),
        F.concat(F.regexp_replace(text.speakable(title, 220), "[.:;,]+$", ""), F.lit(".")), spoken_source(venue, year), spoken_citations(citations, a_year), quoted, twice,
    ), F.lit("\n\n"))


def script(papers: DataFrame, by: str, order: list[Column], part: Column, intro: Column, outro: str, most: int = 5000) -> DataFrame:
    """papers with place, segment, char_start, char_end and n, the number of papers of their script.

    intro: the opening, for `n` papers. Papers are dropped from the end of their list until the script, without white space
    at its end, has at most `most` characters; one always stays. Lists are read as windows, no text is collected.
    """
    w = Window.partitionBy(by).orderBy(*order)
    placed = papers.withColumn("place", F.row_number().over(w)).withColumn("segment", part)
    through = F.sum(F.length("segment")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    sized = placed.withColumn("n", F.col("place")).withColumn("__through", through).withColumn("__total", F.length(intro) + F.col("__through") + len(outro))
    kept = F.greatest(F.lit(1), F.coalesce(F.max(F.when(F.col("__total") <= most, F.col("place"))).over(Window.partitionBy(by)), F.lit(1)))
    cut = sized.withColumn("n", kept).filter(F.col("place") <= F.col("n"))
    end = F.length(intro) + F.col("__through")
    return cut.withColumn("char_start", end - F.length("segment")).withColumn("char_end", end).drop("__through", "__total")
