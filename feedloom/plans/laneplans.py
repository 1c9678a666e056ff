"""Queries over feeds put together from several sources, and over operators that Spark has built in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.functions import dates, scoring, text
from feedloom.operators import briefing, classify, lanes, merges, ranking
from feedloom.plans.base import NOW, Registry, articles, now
from feedloom.plans.payloads import spoken_sql
from feedloom.plans.texts import _PARTS, _WORLD, STRICT_SQL, docs, scored
from feedloom.runtime import table

query = Registry()
N = f"TIMESTAMP '{NOW}'"

# --- lanes -----------------------------------------------------------------------------------------------------------------


@query("paper_categories", "SELECT id, CASE WHEN t IS NOT NULL THEN t " + " ".join(
    f"WHEN regexp_matches({'hay' if where == 'all' else 'lower(title)'}, '{pattern}') THEN '{name}'" for name, where, pattern in classify.PAPER_RULES) + """ ELSE 'AI / ML' END AS category
FROM (SELECT *, lower(concat_ws(' ', scholar_query, array_to_string(categories, ' '), id, title)) AS hay,
  CASE scholar_query WHEN 'sleep recovery' THEN 'Science' WHEN 'protein training review' THEN 'Fitness' END AS t FROM (SELECT * REPLACE (coalesce(title, '') AS title, coalesce(scholar_query, '') AS scholar_query, coalesce(categories, []) AS categories) FROM a ))""")  # fmt: skip
def paper_categories(spark, sf):
    tags = {"sleep recovery": "Science", "protein training review": "Fitness"}
    return articles(spark, sf).select("id", classify.paper_category(F.col("scholar_query"), F.col("categories"), F.col("id"), F.col("title"), tags=tags).alias("category"))


@query("tagged_queries", f"""
WITH s AS (SELECT * FROM (VALUES ('q1', 'sleep', 'rest', 'cited', 400, 6), ('q2', 'tendon', 'joints', 'newest', 200, 4), ('q3', 'muscle', 'strength', 'cited', 300, 5)) s(query, term, tag, sort, days, n)),
m AS (SELECT s.*, f.id, f.categories, f.citations, f.refreshed_at, row_number() OVER (PARTITION BY s.query ORDER BY CASE WHEN sort = 'cited' THEN coalesce(citations, 0) ELSE epoch_us(refreshed_at) END DESC NULLS LAST, id) AS k
  FROM s JOIN a f ON contains(lower(coalesce(f.title, '')), s.term) AND f.refreshed_at >= {N} - to_days(CAST(s.days AS INTEGER)))
SELECT query, id, tag AS section, array_to_string(list_prepend(tag, coalesce(categories, [])), ',') AS categories FROM m WHERE k <= n""")
def tagged_queries(spark, sf):
    specs = spark.createDataFrame([("q1", "sleep", "rest", "cited", 400, 6), ("q2", "tendon", "joints", "newest", 200, 4), ("q3", "muscle", "strength", "cited", 300, 5)], "query string, term string, tag string, sort string, days int, n int")
    works = articles(spark, sf).drop("section")
    out = lanes.tagged_search(
        works, specs, matches=F.lower(F.coalesce("title", F.lit(""))).contains(F.col("term")), published="refreshed_at",
        order={"cited": [F.coalesce("citations", F.lit(0)).desc()], "newest": [F.desc_nulls_last("refreshed_at")]}, categories="categories", now=now(), id="id",
    )
    return out.select("query", "id", "section", F.array_join("categories", ",").alias("categories"))


@query("upgraded_union", """
WITH p AS (SELECT canonical_url AS k, id, citations, source_id = 'tallyhub' AS trending, CASE WHEN provider = 'OpenShelf' THEN 0 WHEN source_id = 'tallyhub' THEN 2 ELSE 1 END AS part FROM a WHERE canonical_url <> ''),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, id) AS i, row_number() OVER (PARTITION BY k, trending ORDER BY part, id) AS j FROM p)
SELECT x.k, x.id, CASE WHEN y.k IS NOT NULL AND NOT x.trending THEN y.citations ELSE x.citations END AS citations, x.trending OR y.k IS NOT NULL AS trending
FROM x LEFT JOIN (SELECT * FROM x WHERE trending AND j = 1) y ON x.k = y.k WHERE x.i = 1""")
def upgraded_union(spark, sf):
    """The earlier list's record counts; a later trending one only lends its flag and citations."""
    a = articles(spark, sf).filter("canonical_url <> ''").select(F.col("canonical_url").alias("k"), "id", "citations", (F.coalesce("source_id", F.lit("")) == "tallyhub").alias("trending"), "provider")
    first, trending = F.coalesce(F.col("provider") == "OpenShelf", F.lit(False)), F.col("trending")
    parts = [a.filter(c).drop("provider") for c in (first, ~first & ~trending, ~first & trending)]
    return lanes.union_upgraded(parts, "k", "id", "trending", ["citations"])


_FEED = f"""
WITH s AS (SELECT *, coalesce(topic, '') AS t, {STRICT_SQL} AS at_s FROM a WHERE canonical_url <> ''),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY at_s DESC NULLS LAST, id) AS k FROM s WHERE provider = 'OpenShelf') WHERE k <= 40),
u AS (SELECT id, canonical_url, t, 0 AS o FROM pool UNION ALL SELECT id, canonical_url, t, 1 FROM s WHERE coalesce(provider, '') <> 'OpenShelf'),
m AS (SELECT t, canonical_url, arg_min(id, (o, id)) AS id FROM u GROUP BY 1, 2),
r AS (SELECT m.t, m.id, score, row_number() OVER (PARTITION BY m.t ORDER BY score DESC, coalesce(citations, 0) DESC, m.id) AS rank FROM m JOIN (SELECT id, citations, {_WORLD} AS score FROM ({_PARTS})) p ON p.id = m.id)
"""


@query("world_feed", _FEED + " SELECT t AS topic, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 24")
def world_feed(spark, sf):
    """Each topic's feed: the strict source's newest, pooled, before the others; one record per work; scored and ranked."""
    a = scored(spark, sf).filter("canonical_url <> ''").withColumn("topic", F.coalesce("topic", F.lit(""))).withColumn("published_at", dates.strict_date(F.col("published")))
    strict = F.coalesce(F.col("provider") == "OpenShelf", F.lit(False))

    def resolve(df):
        others = [c for c in df.columns if c not in ("topic", "canonical_url")]
        return df.groupBy("topic", "canonical_url").agg(F.min_by(F.struct(*others), F.struct("source_order", "id")).alias("r")).select("topic", "canonical_url", "r.*")

    out = lanes.world_feed(
        a.filter(strict), a.filter(~strict), resolve, scoring.world_score(F.col("breakdown")), topic="topic", limit=24,
        order=[F.desc("score"), F.coalesce("citations", F.lit(0)).desc(), F.col("id")],
    )
    return out.select("topic", "id", "score", "rank")


@query("provider_counts", "SELECT provider, count(*) AS count, 'partial' AS status FROM a WHERE provider <> '' GROUP BY 1")
def provider_counts(spark, sf):
    return lanes.status_of(articles(spark, sf).filter("provider <> ''"), "provider", failed=["elsewhere"])


@query("lane_choice", """
SELECT t AS topic, id, lane FROM (SELECT *, min(lane) OVER (PARTITION BY t) AS least FROM (
  SELECT scholar_query AS t, id, 0 AS lane FROM a WHERE source_id = 'openshelf' AND scholar_query <> '' UNION ALL SELECT scholar_query, id, 1 FROM a WHERE scholar_query <> '')) WHERE lane = least""")
def lane_choice(spark, sf):
    """For each query the snapshot's records if it has any, else the live ones."""
    a = articles(spark, sf).filter("scholar_query <> ''").select(F.col("scholar_query").alias("topic"), "id", "source_id")
    return lanes.first_lane([a.filter("source_id = 'openshelf'").drop("source_id"), a.drop("source_id")], "topic").select("topic", "id", "lane")


@query("assembled_lane", """
SELECT id, app FROM (SELECT id, citations, CASE WHEN is_paper THEN 'paper' ELSE 'article' END AS app FROM a WHERE coalesce(title, '') <> '' AND coalesce(link, '') <> '') WHERE app = 'paper' ORDER BY citations DESC NULLS LAST, id LIMIT 30""")
def assembled_lane(spark, sf):
    """Projected first, then filtered by what was projected, ordered, and limited last."""
    a = articles(spark, sf).filter("title <> '' and link <> ''").select("id", "citations", F.when(F.col("is_paper"), "paper").otherwise("article").alias("app"))
    return lanes.assembled(a, filters=[F.col("app") == "paper"], order=[F.desc_nulls_last("citations"), F.col("id")], limit=30).select("id", "app")


@query("merged_snapshot", f"""
WITH live AS (SELECT id, refreshed_at, 0 AS p FROM a WHERE source_id = 'openshelf'), u AS (SELECT * FROM live UNION ALL SELECT id, refreshed_at, 1 FROM a WHERE coalesce(provider, '') <> ''),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS k FROM u) WHERE k = 1)
SELECT id, p = 0 AS live, (SELECT count(*) FROM live) = 0 AS stale, row_number() OVER (ORDER BY refreshed_at DESC NULLS LAST, id) <= 8 AS hot FROM o QUALIFY row_number() OVER (ORDER BY refreshed_at DESC NULLS LAST, id) <= 32""")
def merged_snapshot(spark, sf):
    """Snapshot and live rows: live wins by id, the newest are capped, the first eight are hot, stale only without live rows."""
    a = articles(spark, sf)
    live = a.filter("source_id = 'openshelf'").select("id", "refreshed_at", F.lit(True).alias("live"))
    stored = a.filter("provider <> ''").select("id", "refreshed_at", F.lit(False).alias("live"))
    both = merges.live_over_stored(stored, live, "id", "id")
    newest = ranking.top(both, 32, F.desc_nulls_last("refreshed_at"), F.col("id"))
    flagged = ranking.hot_flag(newest, "hot", 8, F.desc_nulls_last("refreshed_at"), F.col("id"), key="id")
    return flagged.select("id", "live", F.lit(live.isEmpty()).alias("stale"), "hot")


@query("eligible_rows", f"""
SELECT id FROM (SELECT *, {STRICT_SQL} AS s FROM a ) WHERE topic = 'Fitness' AND content_type IN ('paper', 'preprint') AND CASE WHEN freshness_verified THEN coalesce(s >= CAST((CAST({N} AS DATE) - INTERVAL 24 MONTH) AS TIMESTAMP) AND s <= {N}, false)
  ELSE date_precision = 'year' AND coalesce(published_year BETWEEN 2024 AND 2027, false) END""")
def eligible_rows(spark, sf):
    """Topic and type match; verified rows lie in the exact window, others are of year precision and in the years."""
    verified = dates.in_rolling_window(F.col("published"), now())
    by_year = F.coalesce(F.col("date_precision") == "year", F.lit(False)) & dates.in_year_window(F.col("published_year"), now())
    asked = (F.col("topic") == "Fitness") & F.col("content_type").isin("paper", "preprint")
    return articles(spark, sf).filter(asked & F.when(F.coalesce("freshness_verified", F.lit(False)), verified).otherwise(by_year)).select("id")


@query("sticky_records", "SELECT canonical_url, id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY coalesce(full_text_available, false) DESC, id) AS k FROM a WHERE canonical_url <> '') WHERE k = 1")
def sticky_records(spark, sf):
    return lanes.sticky_best(articles(spark, sf).filter("canonical_url <> ''"), ["canonical_url"], F.col("full_text_available"), F.col("id")).select("canonical_url", "id")


@query("vendor_labs", "SELECT s_suppkey, n_name AS lab FROM supplier JOIN nation ON lower(n_name) = lower(CASE WHEN s_nationkey % 2 = 0 THEN (SELECT n_name FROM nation n WHERE n.n_nationkey = s_nationkey) ELSE 'unknown' END)")
def vendor_labs(spark, sf):
    """An inner join on the lower-cased name drops vendors without a lab."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    vendors = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, F.upper("n_name")).otherwise("Unknown").alias("vendor"))
    return vendors.join(nation, F.lower("vendor") == F.lower("n_name")).select("s_suppkey", F.col("n_name").alias("lab"))


@query("subscribers", f"""
SELECT email, first_seen_at FROM (SELECT lower(trim(e)) AS email, CASE WHEN bool_or(old) THEN TIMESTAMP '2026-01-01' ELSE {N} END AS first_seen_at
  FROM (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'no address' ELSE upper(s_name) || '@X.example ' END AS e, false AS old FROM supplier UNION ALL SELECT s_name || '@x.example', true FROM supplier WHERE s_acctbal > 0)
  WHERE regexp_full_match(lower(trim(e)), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') GROUP BY 1)""")
def subscribers(spark, sf):
    """Addresses folded and checked, then merged by address: the first insert's instant stays."""
    s = table(spark, sf, "supplier").withColumn("s_name", F.col("s_name"))
    stored = s.filter("s_acctbal > 0").select(F.concat("s_name", F.lit("@x.example")).alias("email"), F.lit("2026-01-01").cast("timestamp_ntz").alias("first_seen_at"))
    typed = s.select(F.when(F.col("s_suppkey") % 4 == 0, "no address").otherwise(F.concat(F.upper("s_name"), F.lit("@X.example "))).alias("email"))
    fold = lambda df: df.withColumn("email", F.lower(F.trim("email"))).filter(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
    return merges.upsert(fold(stored), fold(typed), ["email"], now=now()).select("email", "first_seen_at")


@query("archived_articles", f"SELECT id, title, {N} AS archived_at FROM a WHERE coalesce(id, '') <> '' AND coalesce(title, '') <> ''")
def archived_articles(spark, sf):
    kept = articles(spark, sf).filter("id <> '' and title <> ''")
    return kept.select("id", "title", now().alias("archived_at"))


@query("rights_metadata", """
SELECT id, coalesce(nullif(rights_status, ''), 'unknown') AS rights_status, coalesce(full_text_available, false) AS full_text_available, coalesce(nullif(attribution, ''), 'Source: ' || coalesce(nullif(source, ''), 'Research')) AS attribution,
  CASE WHEN regexp_extract(canonical_url, '/([0-9]+)', 1) <> '' THEN '/content?id=PMC' || regexp_extract(canonical_url, '/([0-9]+)', 1) END AS endpoint FROM a """)
def rights_metadata(spark, sf):
    """Defaults for what is missing, and the endpoint that a known id gives a candidate."""
    known = F.nullif(F.regexp_extract(F.coalesce("canonical_url", F.lit("")), "/([0-9]+)", 1), F.lit(""))
    or_ = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), d)
    return articles(spark, sf).select(
        "id", or_("rights_status", F.lit("unknown")).alias("rights_status"), F.coalesce("full_text_available", F.lit(False)).alias("full_text_available"),
        or_("attribution", F.concat(F.lit("Source: "), or_("source", F.lit("Research")))).alias("attribution"), F.concat(F.lit("/content?id=PMC"), known).alias("endpoint"),
    )


@query("goal_days", """
SELECT user_id, day, goal, CAST(seen * 2 + opened * 8 + done * 15 + CASE WHEN goal THEN 25 ELSE 0 END AS BIGINT) AS points FROM (
  SELECT *, CASE WHEN available > 0 THEN seen / available >= 0.95 OR (seen / available >= 0.6 AND opened >= 1) END AS goal FROM (
    SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS seen, count(*) FILTER (event_type IN ('click', 'purchase')) AS opened, count(*) FILTER (event_type = 'purchase') AS done, 3 * (user_id % 2) AS available FROM events GROUP BY 1, 2, 6))""")
def goal_days(spark, sf):
    kind = F.col("event_type")
    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(kind.isin("click", "purchase")).alias("opened"), F.count_if(kind == "purchase").alias("done")
    )
    goals = lanes.daily_goals(days, F.col("seen"), F.col("opened"), 3 * (F.col("user_id") % 2))
    return goals.select("user_id", "day", "goal", lanes.day_points(F.col("seen"), F.col("opened"), F.col("done"), F.col("goal")).cast("bigint").alias("points"))


@query("pending_images", "SELECT id FROM a WHERE coalesce(open_access_pdf, '') <> '' AND id NOT IN (SELECT id FROM a WHERE license_id <> '') ORDER BY refreshed_at DESC NULLS LAST, id LIMIT 60")
def pending_images(spark, sf):
    a = articles(spark, sf)
    return merges.pending(a.filter("open_access_pdf <> ''"), a.filter("license_id <> ''"), "id", 60, F.desc_nulls_last("refreshed_at"), F.col("id")).select("id")


# --- briefing ----------------------------------------------------------------------------------------------------------------

_INTRO, _OUTRO = "This is your research briefing. ", "That is your briefing. See you tomorrow."
_WORDS = "[" + ", ".join(f"'{w}'" for w in briefing.COUNTS) + "]"
_ORDINALS = "[" + ", ".join(f"'{w}'" for w in briefing.ORDINALS) + "]"


def _venue_sql(c: str) -> str:
    dangling = r"([\s,]+(of|on|in|for|and|the|to|at|with))+\s*$"
    return f"(SELECT CASE WHEN regexp_matches(x, '^[a-z]') OR length(y) < 3 THEN '' ELSE y END FROM (SELECT trim({c}) AS x, trim(regexp_replace(trim({c}), '(?i){dangling}', '')) AS y))"


@query("briefing_script", f"""
WITH p AS (SELECT source_id, id, title, topic, citations, published_year, providers, {spoken_sql("coalesce(nullif(venue, ''), publisher, '')", 90)} AS v, score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS place
  FROM a JOIN (SELECT id AS i, {_WORLD} AS score FROM ({_PARTS})) ON i = id WHERE coalesce(title, '') <> ''),
q AS (SELECT *, {_venue_sql('v')} AS w FROM p WHERE place <= 30),
s AS (SELECT source_id, id, place, concat_ws(' ', coalesce({_ORDINALS}[place], 'Number ' || place) || ', from ' || {spoken_sql("coalesce(topic, 'research')", 60)} || '.',
    regexp_replace({spoken_sql('title', 220)}, '[.:;,]+$', '') || '.',
    CASE WHEN w <> '' AND published_year IS NOT NULL THEN 'Published in ' || w || ', ' || published_year || '.' WHEN w <> '' THEN 'Published in ' || w || '.' WHEN published_year IS NOT NULL THEN 'Published in ' || published_year || '.' END,
    CASE WHEN coalesce(citations, 0) <= 0 THEN 'It is new enough that the citation count has not caught up yet.' ELSE 'It has ' || format('{{:,}}', citations) || CASE WHEN citations = 1 THEN ' citation so far.' ELSE ' citations so far.' END END,
    CASE WHEN len(coalesce(providers, [])) >= 2 THEN 'More than one index surfaced this one independently.' END) || chr(10) || chr(10) AS segment FROM q),
i AS (SELECT *, length('{_INTRO}' || CASE WHEN place = 1 THEN 'One paper' ELSE coalesce({_WORDS}[place + 1], CAST(place AS VARCHAR)) || ' papers' END || '.') AS opening, sum(length(segment)) OVER (PARTITION BY source_id ORDER BY place) AS through FROM s),
k AS (SELECT source_id, greatest(1, coalesce(max(place) FILTER (opening + through + {len(_OUTRO)} <= 3000), 1)) AS n FROM i GROUP BY 1)
SELECT i.source_id, id, CAST(place AS INTEGER) AS place, segment, CAST(o.opening + through AS BIGINT) AS char_end FROM i JOIN k USING (source_id) JOIN (SELECT source_id AS so, place AS po, opening FROM i) o ON so = i.source_id AND po = n WHERE place <= n""")
def briefing_script(spark, sf):
    """Each source's script of its best thirty papers, as far as 3,000 characters allow."""
    a = scored(spark, sf).filter("title <> ''")
    best = ranking.top_per_key(a, ["source_id"], 30, F.desc("score"), F.col("id"))
    venue = F.coalesce(F.nullif("venue", F.lit("")), "publisher", F.lit(""))
    part = briefing.segment(F.col("place"), F.col("topic"), F.col("title"), venue, F.col("published_year"), F.col("citations"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("providers"))
    intro = F.concat(F.lit(_INTRO), briefing.spoken_count(F.col("n")), F.lit("."))
    out = briefing.script(best, "source_id", [F.desc("score"), F.col("id")], part, intro, _OUTRO, 3000)
    return out.select("source_id", "id", "place", "segment", F.col("char_end").cast("bigint").alias("char_end"))


# --- built in ----------------------------------------------------------------------------------------------------------------


@query("set_operations", """
WITH x AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), y AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT 'except' AS op, count(*) AS n FROM (SELECT k FROM x EXCEPT SELECT k FROM y) UNION ALL SELECT 'except all', count(*) FROM (SELECT k FROM x EXCEPT ALL SELECT k FROM y)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM x INTERSECT SELECT k FROM y) UNION ALL SELECT 'intersect all', count(*) FROM (SELECT k FROM x INTERSECT ALL SELECT k FROM y)""")
def set_operations(spark, sf):
    o = table(spark, sf, "orders")
    x, y = o.filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k")), o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    all_ = {"except": x.subtract(y), "except all": x.exceptAll(y), "intersect": x.intersect(y), "intersect all": x.intersectAll(y)}
    out = None
    for name, df in all_.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("window_functions", """
SELECT s_suppkey, ntile(4) OVER w AS quarter, percent_rank() OVER w AS share_below, cume_dist() OVER w AS share_to, lead(s_suppkey) OVER w AS next, first_value(s_suppkey) OVER w AS first,
  last_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
  count(*) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""")
def window_functions(spark, sf):
    p = Window.partitionBy("s_nationkey")
    w = p.orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.ntile(4).over(w).alias("quarter"), F.percent_rank().over(w).alias("share_below"), F.cume_dist().over(w).alias("share_to"), F.lead("s_suppkey").over(w).alias("next"),
        F.first("s_suppkey").over(w).alias("first"), F.last("s_suppkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
        F.count(F.lit(1)).over(p.orderBy("s_acctbal").rangeBetween(-500, 500)).alias("near"),
    )


@query("sliding_windows", """
SELECT s AS started_at, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    """Counts in windows of two hours that start every hour; the same expression runs on streams."""
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started_at"), "event_type", "n")


@query("lines_of_pages", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM documents WHERE text IS NOT NULL")
def lines_of_pages(spark, sf):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs(spark, sf).filter("text is not null").select("doc_id", F.size(lines).cast("bigint").alias("lines"))
