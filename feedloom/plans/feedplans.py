"""Queries over feeds: filters, tallies, orders, duplicates and table maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.functions import dates, text, urls
from feedloom.operators import dedup, filters, merges, ranking, resolve, tallies
from feedloom.plans.base import NOW, Registry, articles, now, quoted
from feedloom.plans.texts import CLASSIFIED, PLAIN_SQL, STRICT_SQL, classified, docs, scored
from feedloom.plans.texts import _PARTS, _WORLD
from feedloom.runtime import table

query = Registry()
N = f"TIMESTAMP '{NOW}'"
HAY = "lower(concat_ws(' ', title, summary, author, source, array_to_string(categories, ' ')))"

# --- filters and pages -----------------------------------------------------------------------------------------------------


@query("feed_search", f"SELECT id, title FROM a WHERE contains({HAY}, 'muscle') OR contains({HAY}, 'tendón')")
def feed_search(spark, sf):
    hay = [F.col(c) for c in ("title", "summary", "author", "source")] + [F.array_join("categories", " ")]
    either = filters.contains_text("muscle", *hay) | filters.contains_text("tendón", *hay)
    return articles(spark, sf).filter(either).select("id", "title")


@query("feed_keywords_and", "SELECT id FROM a WHERE list_contains(list_transform(categories, lambda x: lower(x)), 'fitness') AND list_contains(list_transform(categories, lambda x: lower(x)), 'research')")
def feed_keywords_and(spark, sf):
    return filters.feed(articles(spark, sf), keyword="Fitness, research").select("id")


@query("feed_categories_or", f"SELECT id, app_category FROM {CLASSIFIED} WHERE app_category IN ('Fitness', 'AI / ML')")
def feed_categories_or(spark, sf):
    return filters.feed(classified(spark, sf), category="fitness,  AI ,nonsense").select("id", "app_category")


@query("feed_unknown_category", f"SELECT id, app_category FROM {CLASSIFIED} WHERE false")
def feed_unknown_category(spark, sf):
    return filters.feed(classified(spark, sf), category="nonsense").select("id", "app_category")


@query("feed_combined", f"SELECT id FROM a WHERE lower(source_id) IN ('openshelf', 'medtrove') AND lower(region) = 'research' AND lower(section) = 'fitness' AND coalesce(is_paper, false) AND coalesce(world_score, 0) >= 40 AND contains({HAY}, 'the')")
def feed_combined(spark, sf):
    return filters.feed(articles(spark, sf), source="OpenShelf,medtrove", region="research", section="Fitness", papers=True, min_score=40, q="the").select("id")


@query("feed_content_types", "SELECT id, content_type FROM a WHERE coalesce(content_type, 'article') IN ('article', 'paper')")
def feed_content_types(spark, sf):
    return filters.feed(articles(spark, sf), content_type="paper,ARTICLE").select("id", "content_type")


@query("feed_page", "SELECT id, world_score FROM a ORDER BY world_score DESC NULLS LAST, id LIMIT 25 OFFSET 50")
def feed_page(spark, sf):
    return filters.page(articles(spark, sf), [F.desc_nulls_last("world_score"), F.col("id")], limit=25, page=3).select("id", "world_score")


@query("newest_first", f"SELECT id, s AS published_at FROM (SELECT id, {STRICT_SQL} AS s FROM a ) ORDER BY s DESC NULLS LAST, id LIMIT 100")
def newest_first(spark, sf):
    out = articles(spark, sf).select("id", dates.strict_date(F.col("published")).alias("published_at"))
    return ranking.top(out, 100, F.desc_nulls_last("published_at"), F.col("id"))


@query("fresh_rows", f"SELECT id FROM a WHERE coalesce(epoch_us({N} - refreshed_at) <= 1814400000000, false)")
def fresh_rows(spark, sf):
    return filters.fresh(articles(spark, sf), F.col("refreshed_at"), now(), 21).select("id")


@query("future_clamp", f"SELECT doc_id, CASE WHEN fetched_at <= {N} - INTERVAL 22 HOUR THEN fetched_at END AS seen_at FROM documents")
def future_clamp(spark, sf):
    then = now() - F.expr("interval 24 hours")
    return docs(spark, sf).select("doc_id", dates.without_future(F.col("fetched_at"), then).alias("seen_at"))


@query("feed_totals", "SELECT count(*) AS total, count(*) FILTER (coalesce(open_access_pdf, '') <> '') AS with_pdf, count(DISTINCT source_id) AS sources FROM a ")
def feed_totals(spark, sf):
    return articles(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(text.truthy(F.col("open_access_pdf"))).alias("with_pdf"), F.countDistinct("source_id").alias("sources"))


# --- tallies -----------------------------------------------------------------------------------------------------------------


@query("keyword_tally", "SELECT keyword, count(*) AS count, min(id) AS first FROM (SELECT id, unnest(categories) AS keyword FROM a ) GROUP BY keyword ORDER BY count DESC, first, keyword LIMIT 100")
def keyword_tally(spark, sf):
    return tallies.keyword_tally(articles(spark, sf), "categories", F.col("id"), 0)


@query("section_tally", "SELECT section AS value, count(*) AS count, min(id) AS first FROM a GROUP BY section")
def section_tally(spark, sf):
    return tallies.tally(articles(spark, sf), F.col("section"), F.col("id"))


@query("source_tally", "SELECT value, count, coalesce(s.source, value) AS label FROM (SELECT source_id AS value, count(*) AS count FROM a GROUP BY source_id) LEFT JOIN sources s ON s.source_id = value")
def source_tally(spark, sf):
    counts = tallies.tally(articles(spark, sf), F.col("source_id"), F.col("id"))
    return tallies.with_dimension(counts, "value", table(spark, sf, "sources"), "source_id", "source").select("value", "count", "label")


@query("category_tally", f"SELECT app_category AS value, count(*) AS count FROM {CLASSIFIED} GROUP BY app_category")
def category_tally(spark, sf):
    return tallies.tally(classified(spark, sf), F.col("app_category"), F.col("id")).select("value", "count")


@query("region_source_rollup", "SELECT region, source_id, count(*) AS n FROM a GROUP BY ROLLUP (region, source_id)")
def region_source_rollup(spark, sf):
    return articles(spark, sf).rollup("region", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query("strongest_fields", """
SELECT canonical_url, max(citations) AS citations, max(world_score) AS world_score, arg_min(venue, id) FILTER (coalesce(venue, '') <> '') AS venue, arg_max(publisher, id) FILTER (coalesce(publisher, '') <> '') AS publisher,
  max(length(coalesce(summary, ''))) AS summary_length FROM a GROUP BY canonical_url""")
def strongest_fields(spark, sf):
    ordered = articles(spark, sf).withColumn("o", F.row_number().over(Window.partitionBy("canonical_url").orderBy("id")))
    out = tallies.strongest(ordered, ["canonical_url"], F.col("o"), largest=["citations", "world_score"], first=["venue"], last=["publisher"], longest=["summary"])
    return out.select("canonical_url", "citations", "world_score", "venue", "publisher", F.length(F.coalesce("summary", F.lit(""))).alias("summary_length"))


@query("collected_providers", """
SELECT scholar_query, array_to_string(list(provider ORDER BY first, provider), ',') AS providers FROM (SELECT scholar_query, provider, min(id) AS first FROM a WHERE coalesce(provider, '') <> '' GROUP BY 1, 2) GROUP BY scholar_query""")
def collected_providers(spark, sf):
    numbered = articles(spark, sf).withColumn("o", F.dense_rank().over(Window.partitionBy("scholar_query").orderBy("id")))
    return tallies.strongest(numbered, ["scholar_query"], F.col("o"), collected=["provider"]).select("scholar_query", F.array_join("provider", ",").alias("providers"))


@query("best_per_link", "SELECT topic, canonical_url, id, citations FROM (SELECT *, row_number() OVER (PARTITION BY topic, canonical_url ORDER BY citations DESC NULLS LAST, id) AS k FROM a ) WHERE k = 1")
def best_per_link(spark, sf):
    return tallies.best_version(articles(spark, sf), ["topic", "canonical_url"], F.col("citations"), F.col("id")).select("topic", "canonical_url", "id", "citations")


@query("family_collapse", """
SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS k FROM (
  SELECT *, min(CASE WHEN p_size = 15 THEN p_partkey END) OVER (PARTITION BY p_brand) AS start FROM part) WHERE start IS NULL OR p_partkey >= start) WHERE k = 1""")
def family_collapse(spark, sf):
    return tallies.newest_from_canonical(table(spark, sf, "part"), "p_brand", F.col("p_retailprice"), F.col("p_size") == 15, F.col("p_partkey")).select("p_brand", "p_partkey")


@query("availability_weighted", f"""
SELECT source, floor(sum(CAST(pow(0.5, h / 12) AS DECIMAL(20, 12))) * 1e6 + 0.5) / 1e6 AS availability, count(*) AS n
FROM (SELECT source, epoch_us({N} - fetched_at) / 1e6 / 3600 AS h FROM documents) WHERE h BETWEEN 0 AND 2400 GROUP BY source""")
def availability_weighted(spark, sf):
    out = tallies.weighted_availability(docs(spark, sf), ["source"], F.col("fetched_at"), now(), hours=2400)
    return out.select("source", (F.floor(F.col("availability") * 1e6 + 0.5) / 1e6).alias("availability"), "n")


# --- orders ------------------------------------------------------------------------------------------------------------------

COHORT = f"CASE WHEN h < 6 THEN 0 WHEN h < 24 THEN 1 WHEN h < 72 THEN 2 WHEN h < 168 THEN 3 ELSE 4 END"


@query("balance_round_robin", f"""
SELECT id, cohort, CAST(row_number() OVER (PARTITION BY cohort, app_category ORDER BY id) AS INTEGER) AS turn FROM (
  SELECT *, coalesce({COHORT}, 4) AS cohort FROM (SELECT *, greatest(0.0, epoch_us({N} - refreshed_at) / 1e6 / 3600) AS h FROM {CLASSIFIED}))""")
def balance_round_robin(spark, sf):
    return ranking.balanced(classified(spark, sf), "app_category", F.col("refreshed_at"), now(), "id").select("id", "cohort", "turn")


@query("group_interleave", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS turn FROM orders")
def group_interleave(spark, sf):
    return ranking.round_robin(table(spark, sf, "orders"), [F.col("o_orderpriority")], F.col("o_orderkey")).select("o_orderkey", "turn")


@query("spread_select", f"""
SELECT id, source_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS turn FROM (SELECT p.*, a.source_id FROM (SELECT *, {_WORLD} AS score FROM ({_PARTS})) p JOIN a USING (id)))
WHERE turn <= 2 ORDER BY turn, source_id, id LIMIT 15""")
def spread_select(spark, sf):
    return ranking.spread(scored(spark, sf), "source_id", F.col("source_id"), F.col("id"), 2, 15, F.desc("score"), F.col("id")).select("id", "source_id", "score")


@query("hot_flag", "SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8) AS hot FROM orders")
def hot_flag(spark, sf):
    return ranking.hot_flag(table(spark, sf, "orders"), "hot", 8, F.desc("o_totalprice"), F.col("o_orderkey"), key="o_orderkey").select("o_orderkey", "hot")


@query("top_per_source", "SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY refreshed_at DESC NULLS LAST, id) AS k FROM a ) WHERE k <= 6")
def top_per_source(spark, sf):
    return ranking.top_per_key(articles(spark, sf), ["source_id"], 6, F.desc_nulls_last("refreshed_at"), F.col("id")).select("source_id", "id")


@query("capped_with_exempt", """
SELECT id FROM a WHERE source_id = 'citegrid' UNION ALL
(SELECT id FROM a WHERE coalesce(source_id, '') <> 'citegrid' ORDER BY refreshed_at DESC NULLS LAST, id LIMIT greatest(0, 170 - (SELECT count(*) FROM a WHERE source_id = 'citegrid')))""")
def capped_with_exempt(spark, sf):
    marked = articles(spark, sf).select("id", "refreshed_at", (F.col("source_id") == "citegrid").alias("topical"))
    return ranking.capped_with_exempt(marked, "topical", 170, F.desc_nulls_last("refreshed_at"), F.col("id")).select("id")


@query("budget_plan", "SELECT s_suppkey, rn <= 46 AS paid FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier)")
def budget_plan(spark, sf):
    paid, rest = ranking.budgeted(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), 0.69, 0.015, F.col("s_acctbal"), F.col("s_suppkey"))
    return paid.select("s_suppkey", F.lit(True).alias("paid")).unionByName(rest.select("s_suppkey", F.lit(False).alias("paid")))


@query("pooled_pick", """
WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 ELSE 2 END AS preference FROM part),
g AS (SELECT p_brand, list(p_partkey ORDER BY p_partkey) AS l FROM (SELECT *, min(preference) OVER (PARTITION BY p_brand) AS best FROM p) WHERE preference = best GROUP BY 1)
SELECT p_brand, l[CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_brand, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, x: (h * 31 + x) & 4294967295) % len(l) AS INTEGER) + 1] AS p_partkey FROM g""")
def pooled_pick(spark, sf):
    part = table(spark, sf, "part")
    pools = part.select("p_brand", F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 20, 1).otherwise(2).alias("preference"), "p_partkey")
    return ranking.pooled_pick(part.select("p_brand").distinct(), pools, "p_brand", "preference", "p_partkey", F.col("p_brand")).select("p_brand", "p_partkey")


# --- duplicates and entities ---------------------------------------------------------------------------------------------------


@query("dedup_by_fingerprint", r"""
SELECT id FROM (SELECT id, CASE WHEN f = '' THEN 1 ELSE row_number() OVER (PARTITION BY f ORDER BY id) END AS k FROM (
  SELECT id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS f FROM a )) WHERE k = 1""")
def dedup_by_fingerprint(spark, sf):
    f = F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", " "))
    return dedup.first_per_key(articles(spark, sf).withColumn("f", f), F.nullif("f", F.lit("")), F.col("id")).select("id")


_FINGERPRINT_SQL = f"""CASE WHEN len(w) < 3 THEN '' ELSE array_to_string(list_sort(list_distinct(w))[1:8], ' ') END"""
_KEYED_SQL = f"""SELECT id, regexp_replace(canonical_url, '/$', '') AS link, {_FINGERPRINT_SQL} AS fingerprint, row_number() OVER (ORDER BY id) AS n FROM (
  SELECT id, canonical_url, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
    lambda x: length(x) > 2 AND x NOT IN ({quoted(text.FINGERPRINT_STOP)})) AS w FROM a )"""


# The rule as it is stated: one record after the other, with what was accepted so far.
@query("dedup_greedy_two_keys", f"""
WITH RECURSIVE o AS ({_KEYED_SQL}), -- A key that only one record has can neither reject nor be rejected.
h AS MATERIALIZED (SELECT n, id, hash(link) AS k, link IS NULL OR count(*) OVER (PARTITION BY link) = 1 AS nk, hash(fingerprint) AS f, fingerprint = '' OR count(*) OVER (PARTITION BY fingerprint) = 1 AS nf FROM o),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, [CAST(0 AS UBIGINT)] AS ks, [CAST(0 AS UBIGINT)] AS fs, false AS ok
  UNION ALL SELECT h.n, h.id, CASE WHEN h.accept AND NOT h.nk THEN list_append(h.ks, h.k) ELSE h.ks END, CASE WHEN h.accept AND NOT h.nf THEN list_append(h.fs, h.f) ELSE h.fs END, h.accept
  FROM (SELECT h.*, r.ks, r.fs, (h.nk OR NOT list_contains(r.ks, h.k)) AND (h.nf OR NOT list_contains(r.fs, h.f)) AS accept FROM r JOIN h ON h.n = r.n + 1) h)
SELECT id FROM r WHERE ok""")
def dedup_greedy_two_keys(spark, sf):
    a = articles(spark, sf).select("id", urls.without_slash(F.col("canonical_url")).alias("link"), text.title_fingerprint(F.col("title")).alias("fingerprint"))
    return dedup.greedy_two_keys(a, F.col("id"), F.col("link"), F.col("fingerprint")).select("id")


@query("union_first_wins", """
SELECT doc_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier) AS k FROM (
  SELECT doc_id, 0 AS tier FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 1 FROM documents WHERE url IS NOT NULL UNION ALL SELECT doc_id, 2 FROM documents)) WHERE k = 1""")
def union_first_wins(spark, sf):
    d = docs(spark, sf)
    parts = [d.filter(c).select("doc_id", F.lit(i).alias("tier")) for i, c in enumerate(("lang = 'de'", "url is not null", "true"))]
    return dedup.union_first_wins(parts, "doc_id", "tier").select("doc_id", "tier")


@query("preprint_pools", r"SELECT link, id FROM (SELECT regexp_replace(regexp_replace(canonical_url, 'v\d+$', ''), '/$', '') AS link, id, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(canonical_url, 'v\d+$', ''), '/$', '') ORDER BY id) AS k FROM a WHERE canonical_url IS NOT NULL) WHERE k = 1")
def preprint_pools(spark, sf):
    a = articles(spark, sf).filter("canonical_url is not null").select("id", urls.without_version(F.col("canonical_url")).alias("link"))
    return dedup.first_per_key(a, F.col("link"), F.col("id")).select("link", "id")


# One record after the other: the first key that is known decides, and an unknown one becomes an alias of the same work.
@query("resolved_works", f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY coalesce(topic, '') ORDER BY id) AS n, hash(canonical_url) AS k1, CASE WHEN t <> '' THEN hash(t || '#') END AS k2
  FROM (SELECT *, substr({PLAIN_SQL.format("coalesce(title, '')")}, 1, 90) AS t FROM a )),
h AS MATERIALIZED (SELECT coalesce(topic, '') AS scope, n, id, CASE WHEN canonical_url IS NULL THEN NULL ELSE k1 END AS k1, k2 FROM o),
r AS (SELECT DISTINCT scope, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, [CAST(0 AS UBIGINT)] AS ks, [CAST(0 AS BIGINT)] AS es, CAST(0 AS BIGINT) AS e FROM h
  UNION ALL SELECT scope, n, id, list_concat(ks, list_filter([CASE WHEN NOT coalesce(list_contains(ks, k1), true) THEN k1 END, CASE WHEN NOT coalesce(list_contains(ks, k2), true) AND k2 IS DISTINCT FROM k1 THEN k2 END], lambda x: x IS NOT NULL)),
    list_concat(es, list_filter([CASE WHEN NOT coalesce(list_contains(ks, k1), true) THEN e END, CASE WHEN NOT coalesce(list_contains(ks, k2), true) AND k2 IS DISTINCT FROM k1 THEN e END], lambda x: x IS NOT NULL)), e
  FROM (SELECT h.*, r.ks, r.es, coalesce(r.es[nullif(list_position(r.ks, h.k1), 0)], r.es[nullif(list_position(r.ks, h.k2), 0)], h.n) AS e FROM r JOIN h ON h.scope = r.scope AND h.n = r.n + 1)),
m AS (SELECT r.scope, r.e, o.* FROM r JOIN o ON o.id = r.id),
v AS (SELECT scope, e, string_agg(provider, ',' ORDER BY first) AS providers FROM (SELECT scope, e, provider, min(id) AS first FROM m WHERE provider IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT min(m.id) AS id, arg_min(title, m.id) AS title, max(greatest(coalesce(citations, 0), 0)) AS citations, arg_min(published_year, m.id) FILTER (published_year IS NOT NULL) AS published_year,
  length(first(summary ORDER BY length(coalesce(summary, '')) DESC, m.id)) AS summary_length, any_value(v.providers) AS providers FROM m LEFT JOIN v ON v.scope = m.scope AND v.e = m.e GROUP BY m.scope, m.e""")
def resolved_works(spark, sf):
    a = articles(spark, sf).select("*", F.col("canonical_url").alias("k1"), text.title_key(F.col("title")).alias("k2"))
    entities = resolve.resolve(a, "topic", "id", "k1", "k2")
    return resolve.merged(entities, "entity", "id").select("id", "title", "citations", "published_year", F.length("summary").alias("summary_length"), F.array_join("providers", ",").alias("providers"))


# --- stored tables -------------------------------------------------------------------------------------------------------------


#: Splits the deliveries in time: what is stored, and what came in later.
LATER = "2026-03-01"


def _later(c: str = "fetched_at"):
    return F.col(c) >= F.lit(LATER).cast("timestamp_ntz")


def _old_and_new(spark, sf):
    """All customers in credit as stored, and all with orders as they come in."""
    c = table(spark, sf, "customer")
    old = c.filter("c_acctbal >= 0").select("c_custkey", "c_acctbal", F.lit("2026-01-01").cast("timestamp_ntz").alias("first_seen_at"))
    buying = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return old, c.join(buying, "c_custkey", "left_semi").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))


_OLD, _NEW = "(SELECT * FROM customer WHERE c_acctbal >= 0)", "(SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))"


@query("upsert_first_seen", f"""
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal + 1 ELSE o.c_acctbal END AS c_acctbal, CASE WHEN o.c_custkey IS NOT NULL THEN TIMESTAMP '2026-01-01' ELSE {N} END AS first_seen_at
FROM {_OLD} o FULL OUTER JOIN {_NEW} n USING (c_custkey)""")
def upsert_first_seen(spark, sf):
    old, new = _old_and_new(spark, sf)
    return merges.upsert(old, new, ["c_custkey"], now=now())


@query("upsert_counts", f"SELECT count(*) FILTER (c_acctbal >= 0) AS matched, count(*) FILTER (c_acctbal < 0) AS inserted FROM {_NEW}")
def upsert_counts(spark, sf):
    return merges.upsert_counts(*_old_and_new(spark, sf), ["c_custkey"])


@query("better_versions", f"""
WITH p AS (SELECT source AS k, count(*) AS count, CASE WHEN count(*) % 2 = 0 THEN 'ok' ELSE 'partial' END AS status FROM documents WHERE source IS NOT NULL AND NOT fetched_at >= TIMESTAMP '{LATER}' GROUP BY 1),
     q AS (SELECT source AS k, count(*) AS count, CASE WHEN count(*) % 3 = 0 THEN 'ok' ELSE 'partial' END AS status FROM documents WHERE source IS NOT NULL AND fetched_at >= TIMESTAMP '{LATER}' GROUP BY 1)
SELECT coalesce(p.k, q.k) AS k, CASE WHEN w THEN q.count ELSE p.count END AS count, CASE WHEN w THEN q.status ELSE p.status END AS status
FROM (SELECT *, q.k IS NOT NULL AND (p.k IS NULL OR (q.status = 'ok' AND p.status <> 'ok') OR ((q.status = 'ok') = (p.status = 'ok') AND q.count >= p.count)) AS w FROM p FULL OUTER JOIN q ON p.k = q.k) t(pk, pc, ps, qk, qc, qs, w)
JOIN LATERAL (SELECT pk AS k, pc AS count, ps AS status) p ON true JOIN LATERAL (SELECT qk AS k, qc AS count, qs AS status) q ON true""")
def better_versions(spark, sf):
    """Of each source's earlier and later run, the better one."""
    d = docs(spark, sf).filter("source is not null")

    def run(rows, k: int):
        n = F.count(F.lit(1))
        return rows.groupBy(F.col("source").alias("k")).agg(n.alias("count"), F.when(n % k == 0, "ok").otherwise("partial").alias("status"))

    return merges.better_version(run(d.filter(~_later()), 2), run(d.filter(_later()), 3), "k")


@query("replace_scopes", f"SELECT doc_id, lang, 0 AS version FROM documents WHERE lang NOT IN ('de', 'fr') UNION ALL SELECT doc_id, lang, 1 FROM documents WHERE lang IN ('de', 'fr') AND fetched_at >= TIMESTAMP '{LATER}'")
def replace_scopes(spark, sf):
    d = docs(spark, sf).filter("lang is not null").select("doc_id", "lang", "fetched_at")
    new = d.filter(F.col("lang").isin("de", "fr") & _later()).drop("fetched_at").withColumn("version", F.lit(1))
    return merges.replace_scopes(d.drop("fetched_at").withColumn("version", F.lit(0)), new, "lang")


@query("live_over_stored", f"SELECT doc_id, CASE WHEN fetched_at >= TIMESTAMP '{LATER}' THEN 'live' ELSE 'stored' END AS origin FROM documents")
def live_over_stored(spark, sf):
    d = docs(spark, sf)
    live = d.filter(_later()).select("doc_id", F.lit("live").alias("origin"))
    return merges.live_over_stored(d.select("doc_id", F.lit("stored").alias("origin")), live, "doc_id", "doc_id").select("doc_id", "origin")


@query("departed_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def departed_customers(spark, sf):
    return merges.departed(table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("erased_user", "SELECT 'events' AS \"table\", count(*) FILTER (user_id = 7) AS erased FROM events UNION ALL SELECT 'clicks', count(*) FILTER (user_id = 7 AND event_type = 'click') FROM events WHERE event_type = 'click'")
def erased_user(spark, sf):
    e = table(spark, sf, "events")
    return merges.erased({"events": e, "clicks": e.filter("event_type = 'click'")}, "user_id", "7")[1]


@query("pruned_cache", f"SELECT doc_id FROM documents WHERE lang = 'en' OR fetched_at >= {N} - INTERVAL 10 DAY")
def pruned_cache(spark, sf):
    d = docs(spark, sf)
    return merges.pruned(d, d.filter("lang = 'en'"), "doc_id", F.col("fetched_at"), now(), 10).select("doc_id")


@query("size_pruned_cache", "SELECT doc_id FROM documents WHERE (SELECT count(*) FROM documents) <= 250 OR lang = 'en'")
def size_pruned_cache(spark, sf):
    d = docs(spark, sf)
    return merges.pruned(d, d.filter("lang = 'en'"), "doc_id", F.col("fetched_at"), now(), only_above=250).select("doc_id")


@query("enrichment_overlay", "SELECT a.id, coalesce(nullif(a.venue, ''), nullif(c.venue, '')) AS venue FROM a LEFT JOIN (SELECT id, publisher AS venue FROM a WHERE source_id = 'openshelf') c ON a.id = c.id")
def enrichment_overlay(spark, sf):
    a = articles(spark, sf)
    return merges.overlay(a.select("id", "venue"), a.filter("source_id = 'openshelf'").select("id", F.col("publisher").alias("venue")), "id", ["venue"])


@query("pending_work", "SELECT id FROM a WHERE coalesce(summary, '') <> '' AND id NOT IN (SELECT id FROM a WHERE source_id = 'openshelf') ORDER BY world_score DESC NULLS LAST, id LIMIT 50")
def pending_work(spark, sf):
    a = articles(spark, sf)
    return merges.pending(a.filter("summary <> ''"), a.filter("source_id = 'openshelf'"), "id", 50, F.desc_nulls_last("world_score"), F.col("id")).select("id")


@query("saved_toggles", """
WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90)
SELECT user_id, event_type FROM (SELECT t.*, n % 2 = 1 AS flip, s.user_id IS NOT NULL AS was FROM t LEFT JOIN s USING (user_id, event_type)) WHERE flip <> was""")
def saved_toggles(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    saved = e.filter("value > 90").select("user_id", "event_type").distinct()
    return merges.toggled(saved, e.drop("value"), ["user_id", "event_type"], "event_id")


@query("daily_readings", "SELECT user_id, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def daily_readings(spark, sf):
    return merges.daily_readings(table(spark, sf, "events"), "user_id", F.to_date("ts"), "value", F.col("event_id"))


@query("snapshot_index", "SELECT topic, count(*) AS count, min(rights_status) AS status, max(refreshed_at) AS refreshed_at FROM a GROUP BY topic")
def snapshot_index(spark, sf):
    return merges.snapshot_index(articles(spark, sf), "topic", "rights_status", "refreshed_at")


@query("latest_artefacts", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events ORDER BY day DESC LIMIT 7")
def latest_artefacts(spark, sf):
    return merges.keep_latest(table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct(), "day", 7)
