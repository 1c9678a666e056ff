"""Queries over events, users, dated series and document blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.functions import buckets
from feedloom.operators import documents, series, sessions, tallies
from feedloom.plans.base import Registry
from feedloom.plans.texts import docs
from feedloom.runtime import table
from feedloom.streaming import streams

query = Registry()


def events(spark, sf):
    return table(spark, sf, "events")


def _sessions_sql(gap: int) -> str:
    return f"""(SELECT *, sum(CASE WHEN idle <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
  FROM (SELECT *, epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS idle FROM events))"""


def _session_rows_sql(gap: int) -> str:
    return f"""SELECT user_id, session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events,
  CAST(sum(CAST(CASE WHEN idle <= {gap} THEN least(idle, 300.0) ELSE 0.0 END AS DECIMAL(18, 6))) AS DOUBLE) AS active_seconds FROM {_sessions_sql(gap)} GROUP BY user_id, session"""


@query("sessions_30m", _session_rows_sql(1800))
def sessions_30m(spark, sf):
    return sessions.sessions(events(spark, sf), "user_id", "ts", 1800, tie="event_id")


@query("sessions_6h", _session_rows_sql(21600))
def sessions_6h(spark, sf):
    return sessions.sessions(events(spark, sf), "user_id", "ts", 21600, tie="event_id")


@query("session_windows", f"SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS ended_at, count(*) AS events FROM {_sessions_sql(21600)} GROUP BY user_id, session")
def session_windows(spark, sf):
    return streams.session_counts(events(spark, sf), "user_id", "ts", "6 hours")


@query("session_buckets", f"""
SELECT CASE WHEN active_seconds < 30 THEN 'under_30s' WHEN active_seconds < 120 THEN '30s_2m' WHEN active_seconds < 300 THEN '2m_5m' WHEN active_seconds < 600 THEN '5m_10m' ELSE '10m_plus' END AS duration,
  CASE WHEN events = 0 THEN '0' WHEN events <= 3 THEN '1_3' WHEN events <= 10 THEN '4_10' ELSE '11_plus' END AS size, count(*) AS n FROM ({_session_rows_sql(21600)}) GROUP BY 1, 2""")
def session_buckets(spark, sf):
    s = sessions_6h(spark, sf)
    return s.groupBy(buckets.duration_bucket(F.col("active_seconds")).alias("duration"), buckets.count_bucket(F.col("events")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("session_minutes", f"""
SELECT CASE WHEN m <= 1 THEN '1' WHEN m <= 4 THEN '2_4' WHEN m <= 9 THEN '5_9' ELSE '10_plus' END AS bucket, count(*) AS n
FROM (SELECT unnest(range(1, CAST(floor(active_seconds / 60) AS BIGINT) + 1)) AS m FROM ({_session_rows_sql(21600)})) GROUP BY 1""")
def session_minutes(spark, sf):
    return sessions.session_minutes(sessions_6h(spark, sf)).groupBy(buckets.minute_bucket(F.col("minute")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("engaged_ratio", "SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'view') AS base, count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0) AS ratio FROM events")
def engaged_ratio(spark, sf):
    return sessions.ratio(events(spark, sf), F.col("event_type") == "click", F.col("event_type") == "view")


@query("activation_funnel", """
WITH s0 AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), s1 AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN s0 USING (user_id) WHERE e.event_type = 'view' AND e.ts >= s0.t GROUP BY 1),
     s2 AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN s1 USING (user_id) WHERE e.event_type = 'purchase' AND e.value > 50 AND e.ts >= s1.t GROUP BY 1)
SELECT 1 AS step, count(*) AS reached FROM s0 UNION ALL SELECT 2, count(*) FROM s1 UNION ALL SELECT 3, count(*) FROM s2""")
def activation_funnel(spark, sf):
    kind = F.col("event_type")
    return sessions.funnel(events(spark, sf), ["user_id"], "ts", [kind == "signup", kind == "view", (kind == "purchase") & (F.col("value") > 50)])


@query("bounded_buffer", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 20")
def bounded_buffer(spark, sf):
    return sessions.bounded(events(spark, sf), ["user_id"], 20, F.col("ts"), F.col("event_id")).select("event_id")


@query("error_caps", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error') WHERE k <= 3")
def error_caps(spark, sf):
    errors = events(spark, sf).filter("event_type = 'error'").withColumn("day", F.to_date("ts"))
    return sessions.bounded(errors, ["user_id", "day"], 3, F.col("ts"), F.col("event_id")).select("event_id")


@query("rate_limit_anchored", """
WITH RECURSIVE o AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, ts, event_id, k, ts AS start, 1 AS n FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.ts, o.event_id, o.k, CASE WHEN o.ts - w.start >= INTERVAL 43200 SECOND THEN o.ts ELSE w.start END, CASE WHEN o.ts - w.start >= INTERVAL 43200 SECOND THEN 1 ELSE w.n + 1 END
  FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT event_id, n <= 2 AS allowed FROM w""")
def rate_limit_anchored(spark, sf):
    return sessions.anchored_windows(events(spark, sf), "user_id", "ts", 2, 43200, tie="event_id").select("event_id", "allowed")


@query("bounded_cache", """
SELECT user_id, stored_at FROM (SELECT user_id, max(ts) AS stored_at FROM events GROUP BY 1) WHERE stored_at > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 HOUR ORDER BY stored_at DESC, user_id LIMIT 40""")
def bounded_cache(spark, sf):
    entries = events(spark, sf).select("user_id", F.col("ts").alias("stored_at"))
    return streams.bounded_cache(entries, "user_id", "stored_at", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 36_000, 40)


@query("streaks", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), r AS (SELECT user_id, count(*) AS n, max(d) AS last FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS i FROM d) GROUP BY user_id, i)
SELECT user_id, sum(n) AS active_days, max(n) AS longest_streak, arg_max(n, last) AS last_streak, max(last) AS last_day FROM r GROUP BY user_id""")
def streaks(spark, sf):
    return sessions.streaks(events(spark, sf), "user_id", F.to_date("ts"))


@query("first_open_points", "SELECT user_id, count(*) * 8 AS xp, count(*) * 8 // 500 + 1 AS level FROM (SELECT DISTINCT user_id, props FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY user_id")
def first_open_points(spark, sf):
    opened = F.col("event_type").isin("click", "purchase")
    first = sessions.first_opens(events(spark, sf), "user_id", "props", "ts", opened, "event_id")
    return first.groupBy("user_id").agg((F.count(F.lit(1)) * 8).alias("xp")).withColumn("level", sessions.level_linear(F.col("xp")).cast("bigint"))


@query("level_curve", """
WITH l AS (SELECT n, floor(50 * pow(n, 1.5)) AS need FROM range(1, 2000) t(n)), x AS (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) AS xp FROM customer)
SELECT c_custkey, CAST(coalesce(max(n), 1) AS INTEGER) AS level FROM x LEFT JOIN l ON l.need <= x.xp GROUP BY c_custkey""")
def level_curve(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sessions.level_curve(F.floor(F.abs("c_acctbal"))).alias("level"))


@query("level_titles", "SELECT c_custkey, CASE WHEN c_nationkey < 1 THEN 'new' WHEN c_nationkey = 1 THEN 'new' WHEN c_nationkey = 2 THEN 'known' ELSE 'old' END AS title FROM customer")
def level_titles(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sessions.level_title(F.col("c_nationkey"), ["new", "known", "old"]).alias("title"))


@query("weekday_points", "SELECT user_id, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS weekday, sum(CASE WHEN event_type IN ('click', 'purchase') THEN 8 ELSE 2 END) AS points FROM events GROUP BY 1, 2")
def weekday_points(spark, sf):
    return tallies.weekday_points(events(spark, sf), "user_id", F.col("ts"), F.col("event_type").isin("click", "purchase"))


@query("daily_goals", "SELECT user_id, CAST(ts AS DATE) AS day, CAST(least(100, floor(100 * count(*) FILTER (event_type = 'click') / 5 + 0.5)) AS INTEGER) AS goal_pct FROM events GROUP BY 1, 2")
def daily_goals(spark, sf):
    clicks = F.count_if(F.col("event_type") == "click")
    return events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(clicks.alias("n")).select("user_id", "day", sessions.goal_share(F.col("n")).alias("goal_pct"))


@query("category_shares", """
SELECT user_id, value, count, CAST(floor(100 * count / max(count) OVER (PARTITION BY user_id) + 0.5) AS INTEGER) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY count DESC, value) AS k
  FROM (SELECT user_id, event_type AS value, count(*) AS count FROM events GROUP BY 1, 2)) QUALIFY k <= 3""")
def category_shares(spark, sf):
    counts = events(spark, sf).groupBy("user_id", F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return tallies.share_of_max(counts, "user_id", 3)


@query("active_week", "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' GROUP BY user_id")
def active_week(spark, sf):
    inside = (F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-31").cast("timestamp_ntz"))
    return events(spark, sf).filter(inside & (F.col("event_type") == "click")).groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("days"))


@query("badges", """
SELECT user_id, count(*) >= 70 AS busy, count(DISTINCT event_type) = 5 AS broad, count(*) FILTER (event_type = 'purchase') >= 15 AS buyer FROM events GROUP BY user_id""")
def badges(spark, sf):
    n = F.count(F.lit(1))
    return events(spark, sf).groupBy("user_id").agg((n >= 70).alias("busy"), (F.countDistinct("event_type") == 5).alias("broad"), (F.count_if(F.col("event_type") == "purchase") >= 15).alias("buyer"))


@query("caught_up", """
SELECT user_id, day, CASE WHEN available > 0 THEN CAST(floor(100 * (0.55 * least(1.0, seen / available) + 0.30 * CASE WHEN seen >= 3 THEN least(1.0, opened / greatest(seen, 1)) ELSE 0.0 END + 0.15 * least(1.0, kinds / 5)) + 0.5) AS INTEGER) END AS score
FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS seen, count(*) FILTER (event_type IN ('click', 'purchase')) AS opened, count(DISTINCT event_type) AS kinds, 4 * (user_id % 2) AS available FROM events GROUP BY 1, 2, 6)""")
def caught_up(spark, sf):
    per = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("opened"), F.countDistinct("event_type").alias("kinds")
    )
    available = 4 * (F.col("user_id") % 2)
    return per.select("user_id", "day", tallies.caught_up(per, F.col("seen"), F.col("opened"), available, F.col("kinds"), F.lit(5)).alias("score"))


@query("event_sanitize", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'k=' || json_extract_string(props, '$.k') END AS kept FROM events""")
def event_sanitize(spark, sf):
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("secret"), F.lit("x")))
    kept = buckets.sanitized_event(F.col("event_type"), props, {"click": ("k",), "view": ("k", "screen")})
    text = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return events(spark, sf).select("event_id", F.when(kept.isNotNull(), text).alias("kept"))


@query("user_board", """
SELECT c_custkey, CAST(rank() OVER (ORDER BY c_acctbal DESC) AS INTEGER) AS rank FROM customer QUALIFY rank() OVER (ORDER BY c_acctbal DESC) <= 100""")
def user_board(spark, sf):
    # The first hundred by a top-k with ties: the hundredth value bounds the rows that a single window sees.
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    least = c.orderBy(F.desc("c_acctbal")).limit(100).agg(F.min("c_acctbal").alias("least"))
    best = c.filter(F.col("c_acctbal") >= least.scalar())
    return best.withColumn("rank", F.rank().over(Window.orderBy(F.desc("c_acctbal")))).filter("rank <= 100").select("c_custkey", "rank")


# --- series ----------------------------------------------------------------------------------------------------------------

_DAYS = "(SELECT p_brand AS model, CAST(o_orderdate AS DATE) AS date, floor(avg(l_extendedprice) * 100 + 0.5) / 100 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def board(spark, sf):
    """(model, date, score): a dated board per brand."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))
    return joined.groupBy(F.col("p_brand").alias("model"), F.to_date("o_orderdate").alias("date")).agg((F.floor(price * 100 + 0.5) / 100).alias("score"))


_BOARD = _DAYS.replace("avg(l_extendedprice)", "CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) / count(*)")
_WEEK = "date BETWEEN DATE '1998-03-01' AND DATE '1998-03-07'"


@query("spark_series", f"""
SELECT model, array_to_string(list_transform(CASE WHEN len(s) >= 2 THEN s ELSE [c, c] END, lambda v: CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 1e4 + 0.5) / 1e4 ELSE 0.5 END), ' ') AS line, floor((c - s[1]) * 10 + 0.5) / 10 AS delta
FROM (SELECT *, least(list_min(s), c) AS lo, greatest(list_max(s), c) AS hi FROM (SELECT model, list(score ORDER BY date) AS s, 35000.0 AS c FROM {_BOARD} WHERE {_WEEK} GROUP BY model))""")
def spark_series(spark, sf):
    s = series.series(board(spark, sf), "model", "date", "score", series.spine(spark, "1998-03-07", 7))
    line = F.array_join(series.sparkline(F.col("series"), F.lit(35000.0)), " ")
    return s.select("model", line.alias("line"), series.delta(F.col("series"), F.lit(35000.0)).alias("delta"))


@query("reading_growth", f"SELECT model, date, floor((score - lag(score) OVER (PARTITION BY model ORDER BY date)) * 100 + 0.5) / 100 AS growth FROM {_BOARD}")
def reading_growth(spark, sf):
    return series.growth(board(spark, sf), "model", "date", "score").select("model", "date", (F.floor(F.col("growth") * 100 + 0.5) / 100).alias("growth"))


@query("as_of_value", "SELECT v.event_id, (SELECT arg_max(p.value, (p.ts, p.event_id)) FROM events p WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts <= v.ts) AS value FROM events v WHERE v.event_type = 'view'")
def as_of_value(spark, sf):
    e = events(spark, sf)
    left = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return series.as_of(left, e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "value"), "user_id", "ts", "at", "value").select("event_id", "value")


LENSES = tuple(f"lens_{x}" for x in "abcdef")


@query("lens_board", """
WITH m AS (SELECT p_brand AS model, floor(CAST(sum(CAST(p_retailprice AS DECIMAL(18, 4))) AS DOUBLE) * 100 + 0.5) / 100 AS score FROM part GROUP BY 1),
     t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS k FROM (SELECT DISTINCT p_type FROM part)),
     b AS (SELECT p_brand AS model, k, arg_min(p_retailprice, p_partkey) AS s FROM part JOIN t USING (p_type) GROUP BY 1, 2)
SELECT m.model, m.score, """ + ", ".join(f"coalesce((SELECT s FROM b WHERE b.model = m.model AND k = {i + 1}), m.score) AS {name}" for i, name in enumerate(LENSES)) + " FROM m")  # fmt: skip
def lens_board(spark, sf):
    """Every board is a lens, named in the order of the boards' names."""
    p = table(spark, sf, "part")
    total = F.sum(F.col("p_retailprice").cast("decimal(18,4)")).cast("double")
    models = p.groupBy(F.col("p_brand").alias("model")).agg((F.floor(total * 100 + 0.5) / 100).alias("score"))
    kinds = p.select("p_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("p_type")))  # a handful of board names
    named = kinds.select("p_type", F.get(F.array(*map(F.lit, LENSES)), F.col("k") - 1).alias("lens"))
    boards = p.join(named, "p_type").select(F.col("p_brand").alias("model"), "lens", F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("rank"))
    return series.lens_board(models, boards, "model", "lens", "score", "rank", list(LENSES))


# --- documents ---------------------------------------------------------------------------------------------------------------

_BLOCKS = "(SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS block_no, b AS block FROM (SELECT doc_id, unnest(l) AS b, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)))"


def blocks(spark, sf):
    return docs(spark, sf).select(*documents.paragraphs("doc_id", "text"))


@query("running_offsets", f"""
SELECT doc_id, block_no, coalesce(sum(length(block) + 1) OVER w, 0) AS char_start, coalesce(sum(length(block) + 1) OVER w, 0) + length(block) AS char_end FROM {_BLOCKS}
WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_offsets(spark, sf):
    return documents.offsets(blocks(spark, sf), "doc_id", "block_no", "block").select("doc_id", "block_no", "char_start", "char_end")


@query("budget_prefix", f"""
WITH r AS (SELECT doc_id, block_no, row_number() OVER w AS n, sum(length(block) + 1) OVER w - 1 + 10 * row_number() OVER w AS total FROM {_BLOCKS} WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
m AS (SELECT doc_id, greatest(1, coalesce(max(n) FILTER (total <= 900), 1)) AS most FROM r GROUP BY doc_id) SELECT doc_id, block_no FROM r JOIN m USING (doc_id) WHERE n <= most""")
def budget_prefix(spark, sf):
    return documents.within_budget(blocks(spark, sf), "doc_id", "block_no", "block", 900, intro=10 * F.col("n")).select("doc_id", "block_no")


@query("block_cutoff", f"""
WITH r AS (SELECT doc_id, block_no, sum(length(block)) OVER w > 2000 OR row_number() OVER w > 6 AS over FROM {_BLOCKS} WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
p AS (SELECT *, bool_or(over) OVER (PARTITION BY doc_id) AS truncated, bool_or(over) OVER (PARTITION BY doc_id ORDER BY block_no) AS past FROM r) SELECT doc_id, block_no, truncated FROM p WHERE NOT past""")
def block_cutoff(spark, sf):
    return documents.cut_off(blocks(spark, sf), "doc_id", "block_no", "block", 2000, 6).select("doc_id", "block_no", "truncated")


@query("joined_blocks", f"SELECT doc_id, string_agg(block, ' ' ORDER BY block_no) AS block FROM {_BLOCKS} GROUP BY doc_id")
def joined_blocks(spark, sf):
    return documents.joined(blocks(spark, sf), "doc_id", "block_no", "block")
