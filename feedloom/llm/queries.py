"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import leakage, names, nearduplicates, packing, spam, survivor, truncation
from feedloom.runtime import table


def _judged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judge(table(spark, sf_dir, "fitness"), "id", "source_id", "summary")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose summary was cut."""
    return _judged_summaries(spark, sf_dir).filter("is_cut").select("id")


def p1_source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its summaries."""
    return truncation.shares(_judged_summaries(spark, sf_dir)).withColumnRenamed("source", "source_id")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_persons(table(spark, sf_dir, "author_names")).union(names.link_organisations(table(spark, sf_dir, "org_names")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings that mean the same person, venue or publisher."""
    return names.pairs(_entities(spark, sf_dir))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the person, venue or publisher it means, and the number of its other spellings."""
    e = _entities(spark, sf_dir)
    return e.join(e.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links")), "entity").select("name_id", "entity", "links")


def _works(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of fitness, `chars` of the summary, `cut` (is it cut off), `trust` of the source, and `dated`, the date as read."""
    trust = table(spark, sf_dir, "sources").groupBy("source_id").agg(F.max("trust").alias("trust"))
    cut = _judged_summaries(spark, sf_dir).select("id", F.col("is_cut").alias("cut"))
    works = table(spark, sf_dir, "fitness").select("canonical_url", "id", "ingested_at", "source_id", F.length("summary").alias("chars"), *columns)
    return works.join(cut, "id", "left").join(trust, "source_id", "left").withColumn("dated", survivor.read_date(F.col("published")))


def _latest_first(column: str):
    return -F.coalesce(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})"), F.lit(-(2**62)))


def _by_trust() -> tuple:
    return -F.coalesce("trust", F.lit(-1)), _latest_first("refreshed_at")


def _bundles() -> list[survivor.Bundle]:
    """What the survivor's summary, citations and date are is fixed, so they lead; year and precision go by the date."""
    begins = F.col("dated.begins").cast("timestamp_ntz")
    trust = F.col("trust")
    return [
        survivor.Bundle("summary", ("summary",), (F.col("chars") > 0) & ~F.coalesce("cut", F.lit(False)), (-F.col("chars"),), leading=True),
        survivor.Bundle("citations", ("citations", "metrics", "refreshed_at"), F.col("citations").between(0, 999_999), (_latest_first("refreshed_at"),), leading=True),
        survivor.Bundle(
            "published", ("published", "dated"), F.coalesce(begins <= F.col("refreshed_at"), F.lit(False)), (F.col("dated.precision"), *_by_trust()), leading=True
        ),
        survivor.Bundle("year", ("published_year",), F.col("published_year").isNotNull(), _by_trust(), trust),
        survivor.Bundle("precision", ("date_precision",), F.col("date_precision") != "", _by_trust(), trust),
    ]


def _dependencies() -> list[survivor.Dependency]:
    """published -> published_year, date_precision."""
    named = F.element_at(F.array(*map(F.lit, ("day", "month", "year"))), F.col("dated.precision") + 1)
    return [
        survivor.Dependency("published", "year", F.year("dated.begins"), F.col("published_year")), survivor.Dependency("published", "precision", named, F.col("date_precision")),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each work with several records, the records whose summary, citations and date are kept."""
    # The summary's text is in no column here, so it need not travel.
    bundles = [replace(b, fields=()) if b.name == "summary" else b for b in _bundles()]
    works = _works(spark, sf_dir, "citations", "metrics", "refreshed_at", "published", "published_year", "date_precision")
    kept = survivor.survivors(works, "canonical_url", "id", bundles, _dependencies(), latest="ingested_at")
    return kept.select("canonical_url", "summary_id", "citations_id", "published_id")


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each work with several: values by trust, under the dependencies of the table.

    published -> published_year, date_precision; authors -> author; provider -> provider_via. An author list that was cut
    short comes after whole ones.
    """
    trust = F.col("trust")
    bundles = [
        *_bundles(),
        survivor.Bundle("outlet", ("venue", "publisher", "host_domain"), F.col("venue") != "", _by_trust(), trust),
        survivor.Bundle("people", ("authors",), F.col("authors") != "", (F.col("authors").endswith("…"), *_by_trust()), F.when(F.col("authors").endswith("…"), 0.0).otherwise(trust), weight=2.0),
        survivor.Bundle("byline", ("author",), F.col("author") != "", _by_trust(), trust),
        survivor.Bundle("origin", ("source_id", "provider"), F.col("provider") != "", _by_trust(), trust),
        survivor.Bundle("via", ("provider_via",), F.col("provider_via") != "", _by_trust(), trust),
        survivor.Bundle("access", ("open_access_pdf", "full_text_available"), F.col("full_text_available").isNotNull(), (F.col("open_access_pdf").isNull(), *_by_trust())),
    ]
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    dependencies = [
        *_dependencies(), survivor.Dependency("people", "byline", some("author"), some("author")), survivor.Dependency("origin", "via", some("provider_via"), some("provider_via")),
    ]
    works = _works(
        spark, sf_dir, "summary", "citations", "metrics", "refreshed_at", "published", "published_year", "date_precision", "venue", "publisher", "host_domain",
        "authors", "author", "provider", "provider_via", "open_access_pdf", "full_text_available",
    )
    kept = survivor.survivors(works, "canonical_url", "id", bundles, dependencies, latest="ingested_at")
    return kept.select(
        "canonical_url", "n_ids", "summary_id", "citations_id", "published_id", "year_id", "precision_id", "outlet_id", "people_id", "byline_id", "origin_id", "via_id", "access_id",
        "summary.summary", "citations.citations", "published.published", "year.published_year", "precision.date_precision", "outlet.venue", "outlet.publisher",
        "people.authors", "byline.author", "origin.provider", "via.provider_via", "access.open_access_pdf", "access.full_text_available",
    )


def _title_and_summary():
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))


def _similar_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nearduplicates.similar_texts(table(spark, sf_dir, "fitness"), "id", _title_and_summary(), width=3, threshold=0.5, min_words=40)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose three-word sequences agree by half or more."""
    return nearduplicates.similar_pairs(*_similar_records(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record long enough to compare, with its group and the number of its links."""
    return nearduplicates.similar_groups(*_similar_records(spark, sf_dir))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, or the pieces of a long one, with its container of 2,048 tokens and what is unused there."""
    counts = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(counts, "doc_id", "tokens")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers the documents take, what stays unused, and the number that no packing can go below."""
    return packing.totals(p6_containers(spark, sf_dir))


def p7_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from which leaked spans were cut: how much of them leaked, and whether so much that they are dropped."""
    cleaned = leakage.remove_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))
    return cleaned.filter("leaked_words > 0").select("doc_id", "leaked_words", (F.floor(F.col("coverage") * 1e6 + 0.5) / 1e6).alias("coverage"), "dropped").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a run of 12 or more words of an evaluation item."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are keyword stuffing, link lists or product tags rather than sentences."""
    return spam.spam_pages(table(spark, sf_dir, "documents")).filter("is_spam").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_source_shares": p1_source_shares, "p3_found": p3_found, "p3_entities": p3_entities, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p5_groups": p5_groups, "p6_containers": p6_containers, "p6_totals": p6_totals, "p7_found": p7_found, "p7_removed": p7_removed, "p8_found": p8_found}

SQL = {
    "p5_found": """
WITH t AS (SELECT id, regexp_extract_all(lower(any_value(coalesce(title, '') || ' ' || coalesce(summary, ''))), '[\\p{L}\\p{N}]+') AS w FROM fitness WHERE id IS NOT NULL GROUP BY id),
     s AS (SELECT DISTINCT id, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) >= 40)),
     n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
     c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * c >= x.n + y.n - c
""",
    "p7_removed": """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
     i AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
     dr AS (SELECT doc_id, len(w) AS n, k, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
     ir AS (SELECT DISTINCT array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT w, unnest(range(1, len(w) - 10)) AS k FROM i)),
     p AS (SELECT DISTINCT doc_id, n, unnest(range(k, k + 12)) AS at_word FROM dr JOIN ir USING (run))
SELECT doc_id, CAST(count(*) AS INTEGER) AS leaked_words, floor(count(*) / n * 1e6 + 0.5) / 1e6 AS coverage, count(*) / n > 0.5 AS dropped FROM p GROUP BY doc_id, n
""",
    "p7_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
     dr AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
     ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)
""",
}
