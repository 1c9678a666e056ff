"""Queries over text, addresses, dates and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import dates, hashing, scoring, text, urls
from feedloom.operators import classify, filters
from feedloom.plans.base import NOW, Registry, articles, now, quoted
from feedloom.runtime import table
from feedloom.sources import feeds

query = Registry()
N = f"TIMESTAMP '{NOW}'"
STRICT_SQL = r"CASE WHEN regexp_full_match(trim(published), '\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z)?') THEN try_cast(replace(replace(trim(published), 'T', ' '), 'Z', '') AS TIMESTAMP) END"
PLAIN_SQL = "trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("text_clean", r"""
SELECT doc_id, CASE WHEN length(t) > 320 THEN regexp_replace(substr(t, 1, 320), '\s+\S*$', '') || '…' ELSE t END AS clean FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents)""")
def text_clean(spark, sf):
    return docs(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query("text_sanitized", r"""
SELECT doc_id, substr(regexp_replace(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g'), 1, 4000) AS safe FROM documents""")
def text_sanitized(spark, sf):
    return docs(spark, sf).select("doc_id", text.sanitized(F.col("text")).alias("safe"))


@query("rolling_hashes", """
SELECT doc_id,
  list_reduce(list_transform(string_split(coalesce(url, ''), ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda h, x: xor(h * 33, x) & 4294967295, CAST(5381 AS BIGINT)) AS h33,
  list_reduce(list_transform(string_split(coalesce(url, ''), ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda h, x: (h * 31 + x) & 4294967295, CAST(0 AS BIGINT)) % 360 AS hue
FROM documents WHERE url <> ''""")
def rolling_hashes(spark, sf):
    return docs(spark, sf).filter("url <> ''").select("doc_id", hashing.hash33(F.col("url")).alias("h33"), hashing.hue(F.col("url")).alias("hue"))


@query("short_ids", """
SELECT doc_id, CASE WHEN coalesce(url, '') = '' THEN lower(to_base(5381, 36)) ELSE lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(url, ''), lambda x: CAST(unicode(x) AS BIGINT))),
  lambda h, x: xor(h * 33, x) & 4294967295), 36)) END AS short_id FROM documents""")
def short_ids(spark, sf):
    return docs(spark, sf).select("doc_id", hashing.short_id(F.col("url")).alias("short_id"))


@query("title_fingerprints", f"""
SELECT id, CASE WHEN len(w) < 3 THEN '' ELSE array_to_string(list_sort(list_distinct(w))[1:8], ' ') END AS fingerprint FROM (
  SELECT id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
    lambda x: length(x) > 2 AND x NOT IN ({quoted(text.FINGERPRINT_STOP)})) AS w FROM a )""")
def title_fingerprints(spark, sf):
    return articles(spark, sf).select("id", text.title_fingerprint(F.col("title")).alias("fingerprint"))


@query("record_keys", f"""
SELECT id, CASE WHEN t <> '' THEN 'title:' || t END AS title_key,
       CASE WHEN d <> '' THEN 'doi:' || d END AS doi_key
FROM (SELECT id, substr({PLAIN_SQL.format("coalesce(title, '')")}, 1, 90) AS t,
  regexp_replace(regexp_extract(lower('https://doi.org/10.1234/' || regexp_extract(canonical_url, '([^/]+)$', 1)), '(10\\.\\d{{4,9}}/[^\\s"''<>]+)', 1), '[.,;]+$', '') AS d FROM a )""")
def record_keys(spark, sf):
    doi = F.concat(F.lit("https://doi.org/10.1234/"), F.regexp_extract("canonical_url", "([^/]+)$", 1))
    return articles(spark, sf).select("id", text.title_key(F.col("title")).alias("title_key"), text.doi_key(doi).alias("doi_key"))


_STEM_SQL = (
    "CASE WHEN length(x) > 5 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 5 AND x LIKE '%ing' THEN x[:-4] WHEN length(x) > 4 AND x LIKE '%ed' THEN x[:-3]"
    " WHEN length(x) > 4 AND x LIKE '%es' THEN x[:-3] WHEN length(x) > 3 AND x LIKE '%s' THEN x[:-2] ELSE x END"
)


def _tokens_sql(c: str) -> str:
    return (
        f"list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '([A-Za-z0-9]+([''’][A-Za-z0-9]+)*)', 1),"
        f" lambda x: regexp_replace(lower(x), '[''’]s$', '')), lambda x: x NOT IN ({quoted(text.STOP_WORDS)})), lambda x: {_STEM_SQL}), lambda x: length(x) > 1))"
    )


@query("token_overlap", f"""
SELECT id, len(t) AS title_tokens, len(s) AS summary_tokens, len(list_intersect(t, s)) AS shared,
       CASE WHEN len(list_distinct(list_concat(t, s))) > 0 THEN floor(len(list_intersect(t, s)) / len(list_distinct(list_concat(t, s))) * 1e6 + 0.5) / 1e6 ELSE 0.0 END AS jaccard
FROM (SELECT id, {_tokens_sql('title')} AS t, {_tokens_sql('summary')} AS s FROM a )""")
def token_overlap(spark, sf):
    t, s = text.content_tokens(F.col("title")), text.content_tokens(F.col("summary"))
    return articles(spark, sf).select(
        "id", F.size(t).alias("title_tokens"), F.size(s).alias("summary_tokens"), F.size(F.array_intersect(t, s)).alias("shared"), scoring.rounded(text.jaccard(t, s), 6).alias("jaccard")
    )


_COMPLETE_SQL = (
    "(v <> '' AND NOT regexp_matches(v, '(\\.\\.\\.|…)[\"''’”)\\]]*$') AND regexp_matches(regexp_replace(v, '[\"''’”)\\]]+$', ''), '[.!?]$')"
    " AND NOT regexp_matches(regexp_replace(v, '[\"''’”)\\]]+$', ''), '\\s[a-z]\\.$'))"
)
_NOISE_SQL = "regexp_matches(lower(v), '" + "|".join(f"(?:{p})" for p in text.NOISE).replace("'", "''") + "')"
_VAGUE_SQL = "regexp_matches(lower(v), '" + "|".join(f"(?:{p})" for p in text.VAGUE).replace("'", "''") + "')"


@query("summary_gate", f"""
SELECT id, {_COMPLETE_SQL} AS complete, {_NOISE_SQL} AS noise, {_VAGUE_SQL} AS vague,
  (length(v) >= 55 AND len(regexp_extract_all(v, '([A-Za-z0-9]+([''’][A-Za-z0-9]+)*)', 1)) >= 10 AND len({_tokens_sql('v')}) >= 5 AND {_COMPLETE_SQL} AND NOT {_NOISE_SQL} AND NOT {_VAGUE_SQL}
   AND NOT (pt <> '' AND (pt = pv OR (len(t) >= 3 AND len(s) > 0 AND len(list_intersect(t, s)) / greatest(len(t), 1) >= 0.8
     AND (len(list_intersect(t, s)) / greatest(len(list_distinct(list_concat(t, s))), 1) >= 0.78 OR len(s) - len(list_intersect(t, s)) <= 1))))) AS useful
FROM (SELECT id, v, {_tokens_sql('title')} AS t, {_tokens_sql('v')} AS s, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS pt,
        trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) AS pv
      FROM (SELECT id, title, trim(regexp_replace(coalesce(summary, ''), '\\s+', ' ', 'g')) AS v FROM a ))""")
def summary_gate(spark, sf):
    v = text.squashed(F.col("summary"))
    return articles(spark, sf).select(
        "id", text.is_complete(v).alias("complete"), text.is_noise(v).alias("noise"), text.is_vague(v).alias("vague"), text.is_summary_useful(F.col("summary"), F.col("title")).alias("useful")
    )


_PIECES_SQL = "list_filter(regexp_extract_all(v, '([^.!?]*[.!?]+[\"''’”)\\]]*)(?:\\s+|$)', 1), lambda x: true)"


@query("extractive_summaries", f"""
WITH p AS (SELECT id, title, CASE WHEN is_paper THEN 360 ELSE 300 END AS cap, {_PIECES_SQL} AS pieces FROM (SELECT *, trim(regexp_replace(coalesce(summary, ''), '\\s+', ' ', 'g')) AS v FROM a )),
s AS (SELECT id, title, i, trim(x) AS v FROM (SELECT id, title, unnest(pieces) AS x, unnest(range(len(pieces))) AS i FROM p)),
j AS (SELECT id, i, v, {_COMPLETE_SQL} AND NOT {_NOISE_SQL} AND NOT {_VAGUE_SQL} AND len(regexp_extract_all(v, '([A-Za-z0-9]+([''’][A-Za-z0-9]+)*)', 1)) >= 5
    AND NOT (pt <> '' AND (pt = pv OR (len(t) >= 3 AND len(s) > 0 AND len(list_intersect(t, s)) / greatest(len(t), 1) >= 0.8
      AND (len(list_intersect(t, s)) / greatest(len(list_distinct(list_concat(t, s))), 1) >= 0.78 OR len(s) - len(list_intersect(t, s)) <= 1)))) AS ok
  FROM (SELECT *, {_tokens_sql('title')} AS t, {_tokens_sql('v')} AS s, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS pt, trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) AS pv FROM s)),
l AS (SELECT id, list({{'text': v, 'n': CAST(ok AS INTEGER), 'done': false}} ORDER BY i) AS xs, arg_min(v, i) FILTER (length(v) >= 40) AS lead FROM j GROUP BY id)
SELECT p.id, coalesce(list_reduce(list_prepend({{'text': '', 'n': 0, 'done': false}}, xs), lambda acc, x: CASE WHEN acc.done OR x.n = 0 THEN acc
    WHEN length(CASE WHEN acc.n = 0 THEN x.text ELSE acc.text || ' ' || x.text END) <= cap THEN {{'text': CASE WHEN acc.n = 0 THEN x.text ELSE acc.text || ' ' || x.text END, 'n': acc.n + 1, 'done': acc.n + 1 >= 2}}
    ELSE {{'text': acc.text, 'n': acc.n, 'done': acc.n > 0}} END).text, '') AS short, lead FROM p LEFT JOIN l USING (id)""")
def extractive_summaries(spark, sf):
    cap = F.when(F.col("is_paper"), 360).otherwise(300)
    return articles(spark, sf).select("id", text.extractive_summary(F.col("summary"), F.col("title"), cap).alias("short"), text.lead_sentence(F.col("summary")).alias("lead"))


@query("summary_takeaways", r"""
SELECT id, len(p) AS n, p[1] AS first_piece FROM (SELECT id, CASE WHEN len(q) > 0 THEN list_transform(q[1:4], lambda x: trim(x)) ELSE [coalesce(summary, '')] END AS p
  FROM (SELECT id, summary, regexp_extract_all(coalesce(summary, ''), '([^.!?]+[.!?])', 1) AS q FROM a ))""")
def summary_takeaways(spark, sf):
    t = text.takeaways(F.col("summary"))
    return articles(spark, sf).select("id", F.size(t).alias("n"), F.get(t, 0).alias("first_piece"))


@query("junk_titles", r"""
SELECT id, (length(t) < 14 OR length(regexp_replace(t, '[^ -~]', '', 'g')) < 0.9 * length(t) OR regexp_matches(t, '^[^A-Za-z0-9"''(]')) AS junk
FROM (SELECT id, trim(coalesce(title, '')) AS t FROM a )""")
def junk_titles(spark, sf):
    return articles(spark, sf).select("id", text.junk_title(F.col("title")).alias("junk"))


@query("slugs", r"""
SELECT id, substr(regexp_replace(regexp_replace(lower(strip_accents(coalesce(topic, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS topic_slug,
       substr(regexp_replace(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS title_slug FROM a """)
def slugs(spark, sf):
    return articles(spark, sf).select("id", text.slug(F.col("topic")).alias("topic_slug"), text.slug(F.col("title")).alias("title_slug"))


@query("pretty_sources", """
SELECT DISTINCT source, array_to_string(list_filter(list_transform(string_split(source, '_'), lambda w: CASE WHEN regexp_matches(w, '^\\d+$') OR w = '' THEN ''
  WHEN w = 'openshelf' THEN 'OpenShelf' WHEN w = 'fr' THEN 'FR' ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), lambda w: w <> ''), ' ') AS pretty FROM documents WHERE source IS NOT NULL""")
def pretty_sources(spark, sf):
    hyphened = F.replace(F.col("source"), F.lit("_"), F.lit("-"))
    return docs(spark, sf).filter("source is not null").select("source", text.prettified(hyphened, {"openshelf": "OpenShelf"}, ["fr"]).alias("pretty")).distinct()


@query("url_parts", r"""
SELECT doc_id, CASE WHEN regexp_matches(p, '(^|/)videos?(/|$)') THEN 'video' WHEN regexp_matches(p, '(^|/)(podcasts?|episodes?)(/|$)') THEN 'podcast' ELSE 'article' END AS content_type,
  nullif(lower(regexp_extract(coalesce(url, ''), '(?i)^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]+)', 1)), '') AS host,
  CASE WHEN regexp_matches(coalesce(url, ''), '(?i)^https?://[^\s/?#]+') THEN regexp_replace(url, '[?#].*$', '') ELSE '/' END AS page
FROM (SELECT doc_id, url, lower(CASE WHEN regexp_matches(coalesce(url, ''), '(?i)^[a-z][a-z0-9+.-]*://') THEN regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) ELSE coalesce(url, '') END) AS p FROM documents)""")
def url_parts(spark, sf):
    u = F.col("url")
    return docs(spark, sf).select("doc_id", urls.content_type(u).alias("content_type"), urls.host(u).alias("host"), urls.redacted_page(u).alias("page"))


@query("poster_urls", """
SELECT id, CASE WHEN link <> '' THEN link || CASE WHEN contains(link, '?') THEN '&' ELSE '?' END || 'w=420&h=260&crop=1' END AS thumbnail FROM a """)
def poster_urls(spark, sf):
    return articles(spark, sf).select("id", urls.thumbnail(F.col("link")).alias("thumbnail"))


@query("publication_lines", r"""
SELECT id, trim(split_part(l, ' - ', 1)) AS authors, trim(regexp_replace(split_part(l, ' - ', 2), ',?\s*(?:19|20)\d{2}\s*$', '')) AS venue,
  CAST(nullif(regexp_extract(split_part(l, ' - ', 2), '((?:19|20)\d{2})\s*$', 1), '') AS INTEGER) AS year, trim(split_part(l, ' - ', 3)) AS host
FROM (SELECT id, 'A Author' || ' - ' || regexp_replace(coalesce(nullif(venue, ''), 'None'), '\s+', ' ', 'g') || ', ' || published_year || ' - ' || coalesce(nullif(host_domain, ''), 'none.example') AS l FROM a )
WHERE len(string_split(l, ' - ')) = 3""")
def publication_lines(spark, sf):
    line = F.concat(
        F.lit("A Author - "), F.regexp_replace(F.coalesce(F.nullif("venue", F.lit("")), F.lit("None")), r"\s+", " "), F.lit(", "), F.col("published_year").cast("string"), F.lit(" - "),
        F.coalesce(F.nullif("host_domain", F.lit("")), F.lit("none.example")),
    )
    return articles(spark, sf).select("id", line.alias("l")).filter(F.size(F.split("l", " - ")) == 3).select("id", text.publication_info(F.col("l")).alias("i")).select("id", "i.*")


@query("reading_labels", r"""
SELECT id, least(12, greatest(2, CAST(floor(len(list_filter(string_split(trim(regexp_replace(coalesce(summary, ''), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) / 60 + 0.5) AS INTEGER))) AS minutes,
  CASE WHEN c >= 1000000 THEN regexp_replace(printf('%.1f', floor(c / 1e6 * 10 + 0.5) / 10), '\.0$', '') || 'M' WHEN c >= 1000 THEN regexp_replace(printf('%.1f', floor(c / 1e3 * 10 + 0.5) / 10), '\.0$', '') || 'K' ELSE CAST(c AS VARCHAR) END AS citations_label
FROM (SELECT id, summary, greatest(0, least(coalesce(citations, 0), 99999)) AS c FROM a )""")
def reading_labels(spark, sf):
    c = F.greatest(F.lit(0), F.least(F.coalesce("citations", F.lit(0)), F.lit(99999)))
    return articles(spark, sf).select("id", text.read_minutes(F.col("summary")).alias("minutes"), text.compact_count(c).alias("citations_label"))


INCLUDE, EXCLUDE = ("tendon", "cartilage", "muscle"), ("placebo", "registry")


@query("topic_gate", "SELECT doc_id FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS t FROM documents) WHERE ("
       + " OR ".join(f"contains(t, '{x}')" for x in INCLUDE) + ") AND NOT (" + " OR ".join(f"contains(t, '{x}')" for x in EXCLUDE) + ")")
def topic_gate(spark, sf):
    return docs(spark, sf).filter(text.matches_topic(F.col("text"), INCLUDE, EXCLUDE)).select("doc_id")


ON, OFF = r"(^|[^a-z])(squat|barbell|treadmill|recovery)([^a-z]|$)", r"(^|[^a-z])(pregnancy|diabetes|surgery)([^a-z]|$)"


@query("relevance_gate", f"""
SELECT id, CASE WHEN junk THEN false WHEN section = 'Research' OR source_id = 'predraft' THEN true WHEN regexp_matches(h, '{OFF}') AND NOT regexp_matches(h, '{ON}') THEN false ELSE regexp_matches(h, '{ON}') END AS relevant
FROM (SELECT id, section, source_id, lower(concat_ws(' ', title, summary)) AS h, (length(t) < 14 OR length(regexp_replace(t, '[^ -~]', '', 'g')) < 0.9 * length(t) OR regexp_matches(t, '^[^A-Za-z0-9"''(]')) AS junk
  FROM (SELECT *, trim(coalesce(title, '')) AS t FROM a ))""")
def relevance_gate(spark, sf):
    keep = filters.relevant(F.col("title"), F.col("summary"), F.col("section"), F.col("source_id"), trusted_sections=["Research"], trusted_sources=["predraft"], off_topic=OFF, on_topic=ON)
    return articles(spark, sf).select("id", keep.alias("relevant"))


@query("commerce_rows", """
SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(cheap|discount|wholesale|free-shipping)') OR lower(coalesce(topic, '')) IN ('deals', 'shopping')""")
def commerce_rows(spark, sf):
    shop = filters.commerce(F.col("text"), F.array("topic"), "(cheap|discount|wholesale|free-shipping)", ["deals", "shopping"])
    return docs(spark, sf).filter(shop | F.lower(F.coalesce("topic", F.lit(""))).isin("deals", "shopping")).select("doc_id")


@query("date_windows", f"""
SELECT id, s AS strict_date, coalesce(s >= CAST((CAST({N} AS DATE) - INTERVAL 24 MONTH) AS TIMESTAMP) AND s <= {N}, false) AS in_window,
  coalesce(published_year BETWEEN 2024 AND 2027, false) AS in_years FROM (SELECT id, published_year, {STRICT_SQL} AS s FROM a )""")
def date_windows(spark, sf):
    p = F.col("published")
    return articles(spark, sf).select("id", dates.strict_date(p).alias("strict_date"), dates.in_rolling_window(p, now()).alias("in_window"), dates.in_year_window(F.col("published_year"), now()).alias("in_years"))


def _phrase_sql(phrases) -> str:
    return "(" + " OR ".join(f"contains(p, ' {x} ')" for x in phrases) + ")"


def _venue_sql(tiers=scoring.TIERS) -> str:
    out = f"CASE WHEN n = '' THEN 0.45 WHEN n IN ({quoted(scoring.FLAGSHIPS)}) THEN 1.0 WHEN {_phrase_sql(scoring.PREPRINTS)} THEN 0.55"
    for s, ps in tiers:
        out += f" WHEN {_phrase_sql(ps)} THEN {s}"
    return out + " ELSE 0.45 END"


_VENUES = f"(SELECT *, ' ' || n || ' ' AS p FROM (SELECT *, {PLAIN_SQL.format(chr(34) + 'v' + chr(34))} AS n FROM (SELECT *, coalesce(nullif(venue, ''), publisher, '') AS v FROM a )))"


@query("venue_scores", f"SELECT id, CAST({_venue_sql()} AS DOUBLE) AS venue_score FROM {_VENUES}")
def venue_scores(spark, sf):
    return articles(spark, sf).select("id", scoring.venue_score(F.coalesce(F.nullif("venue", F.lit("")), "publisher")).alias("venue_score"))


_R4 = "floor(({}) * 10000 + 0.5) / 10000"
_DAYS = f"greatest(0.0, epoch_us({N} - d) / 1e6 / 86400)"
_PER_YEAR = f"CASE WHEN d IS NULL THEN 0.0 ELSE greatest(0, least(coalesce(citations, 0), 999999)) / greatest(1.0, {_DAYS} / 365.25) END"
_PARTS = f"""
SELECT id, title, citations, topic, {_R4.format(f"least(1.0, log10(1 + {_PER_YEAR}) / log10(151.0))")} AS impact,
  {_R4.format(f"CASE WHEN d IS NULL THEN 0.5 ELSE pow(0.5, {_DAYS} / 400) END")} AS recency, {_R4.format(_venue_sql())} AS venue_part,
  CASE WHEN len(providers) >= 3 THEN 1.0 WHEN len(providers) = 2 THEN 0.78 ELSE 0.4 END AS corroboration,
  CASE WHEN coalesce(open_access_pdf, '') <> '' THEN 1.0 WHEN coalesce(full_text_available, false) OR coalesce(rights_status, '') = 'verified_open_access' THEN 0.85 ELSE 0.35 END AS access
FROM (SELECT *, coalesce({STRICT_SQL}, make_timestamp(published_year, 6, 30, 0, 0, 0)) AS d FROM {_VENUES})"""
_WORLD = "CAST(floor(100 * (impact * 0.42 + recency * 0.24 + venue_part * 0.16 + corroboration * 0.11 + access * 0.07) + 0.5) AS INTEGER)"


def scored(spark, sf):
    """Articles with `breakdown` and `score`."""
    d = dates.scoring_date(dates.strict_date(F.col("published")), F.col("published_year"))
    sane = F.least(F.coalesce("citations", F.lit(0)), F.lit(999_999))
    parts = scoring.score_breakdown(
        sane, d, F.coalesce(F.nullif("venue", F.lit("")), "publisher"), F.col("providers"), F.col("open_access_pdf"), F.col("full_text_available"), F.col("rights_status"), now()
    )
    return articles(spark, sf).withColumn("breakdown", parts).withColumn("score", scoring.world_score(F.col("breakdown")))


@query("world_scores", f"SELECT id, {_WORLD} AS score, impact, recency FROM ({_PARTS})")
def world_scores(spark, sf):
    return scored(spark, sf).select("id", "score", "breakdown.impact", "breakdown.recency")


@query("world_rank", f"""
SELECT topic, id, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, coalesce(citations, 0) DESC, id) AS INTEGER) AS rank FROM (SELECT *, {_WORLD} AS score FROM ({_PARTS}))""")
def world_rank(spark, sf):
    from feedloom.operators.ranking import ranked

    out = ranked(scored(spark, sf), "rank", F.desc("score"), F.coalesce("citations", F.lit(0)).desc(), F.col("id"), partition=["topic"])
    return out.select("topic", "id", "score", "rank")


@query("trend_scores", f"""
SELECT id, CAST(CASE WHEN source_id = 'tallyhub' AND coalesce(citations, 0) > 0 THEN least(99, greatest(20, floor(least(citations, 99999) / 25 + 0.5)))
  WHEN s IS NOT NULL THEN least(70, greatest(1, floor(45 - greatest(0.0, epoch_us({N} - s) / 1e6 / 86400) + 0.5)))
  WHEN coalesce(citations, 0) > 0 THEN least(60, floor(least(citations, 99999) / 40 + 0.5)) ELSE 5 END AS INTEGER) AS trend FROM (SELECT *, {STRICT_SQL} AS s FROM a )""")
def trend_scores(spark, sf):
    c = F.when(F.col("citations").isNotNull(), F.least("citations", F.lit(99_999)))  # least() leaves nulls out
    return articles(spark, sf).select("id", scoring.trend_score(F.col("source_id") == "tallyhub", c, dates.strict_date(F.col("published")), now()).alias("trend"))


BANTER, ANNOUNCE, TECH, BUSINESS = ("together", "apparently", "overall"), ("reported", "we followed", "confirmed"), ("protocol", "sensor", "wearable", "endpoint"), ("group-led", "registry", "cohort")
POSITIVE, NEGATIVE = ("improved", "supported", "restored", "raised"), ("limited", "masked", "blunted", "lowered", "reduced")


def _hits_sql(terms) -> str:
    import re

    one = lambda t: f"regexp_matches(t, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" if re.fullmatch("[a-z0-9$]+", t) else f"contains(t, '{t}')"
    return "(" + " + ".join(f"CAST({one(t)} AS INTEGER)" for t in terms) + ")"


_METRIC_SQL = "regexp_matches(r, '" + scoring.METRICS + "')"


@query("post_scores", f"""
SELECT id, CAST(greatest(0, least(100, 30 + CASE WHEN len < 25 THEN -22 WHEN len > 90 THEN 6 ELSE 0 END - 12 * least(b, 3) + CASE WHEN n > 0 THEN 22 + 8 * least(n - 1, 3) ELSE 0 END
   + CASE WHEN k > 0 THEN 10 + 5 * least(k - 1, 4) ELSE 0 END + CASE WHEN m > 0 THEN 14 + 6 * least(m - 1, 3) ELSE 0 END
   + CASE WHEN eng > 0 THEN least(18, floor(6 * log10(eng + 1.0) + 0.5)) ELSE 0 END + CASE WHEN metric THEN 8 ELSE 0 END)) AS INTEGER) AS score,
  CASE WHEN s > 0.15 THEN 'positive' WHEN s < -0.15 THEN 'negative' ELSE 'neutral' END AS tone
FROM (SELECT id, length(trim(r)) AS len, {_hits_sql(BANTER)} AS b, {_hits_sql(ANNOUNCE)} AS n, {_hits_sql(TECH)} AS k, {_hits_sql(BUSINESS)} AS m, {_METRIC_SQL} AS metric,
        greatest(0, least(coalesce(citations, 0), 999999)) AS eng,
        greatest(-1.0, least(1.0, ({_hits_sql(POSITIVE)} - {_hits_sql(NEGATIVE)}) / greatest(2, {_hits_sql(POSITIVE)} + {_hits_sql(NEGATIVE)}))) AS s
      FROM (SELECT id, citations, coalesce(summary, '') AS r, lower(trim(regexp_replace(coalesce(summary, ''), '\\s+', ' ', 'g'))) AS t FROM a ))""")
def post_scores(spark, sf):
    likes = F.greatest(F.lit(0), F.least(F.coalesce("citations", F.lit(0)), F.lit(999_999)))
    v = scoring.newsworthiness(F.col("summary"), banter=BANTER, announce=ANNOUNCE, tech=TECH, business=BUSINESS, likes=likes)
    s = scoring.sentiment(F.lower(text.squashed(F.col("summary"))), POSITIVE, NEGATIVE)
    return articles(spark, sf).select("id", v["score"].alias("score"), scoring.sentiment_label(s).alias("tone"))


def _found_sql(terms) -> str:
    """The terms found, in order."""
    import re

    one = lambda t: f"regexp_matches(t, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" if re.fullmatch("[a-z0-9$]+", t) else f"contains(t, '{t}')"
    return "list_filter([" + ", ".join(f"CASE WHEN {one(t)} THEN '{t}' END" for t in terms) + "], lambda x: x IS NOT NULL)"


_LEXICA = (("b", BANTER, "casual tone"), ("n", ANNOUNCE, "announcement language"), ("k", TECH, "tech substance"), ("m", BUSINESS, "business signal"))
_REASONS_SQL = "array_to_string(list_filter([CASE WHEN score >= 55 THEN 'report-worthy' END, CASE WHEN len < 25 THEN 'very short' END, " + ", ".join(
    f"CASE WHEN len({c}) > 0 THEN '{name} (' || array_to_string({c}[1:3], ', ') || ')' END" for c, _, name in _LEXICA) + ", CASE WHEN metric THEN 'concrete metrics' END], lambda x: x IS NOT NULL), '; ')"


@query("post_verdicts", f"""
SELECT id, score >= 55 AS worthy, CASE WHEN len(m) > 0 AND regexp_matches(t, '(^|[^a-z0-9_])(rais|fund|valuation|ipo|acqui|million|billion)([^a-z0-9_]|$)') THEN 'Funding & deals'
  WHEN regexp_matches(t, '(^|[^a-z0-9_])(research|paper|preprint|benchmark|sota|reasoning|training)([^a-z0-9_]|$)') THEN 'Research' WHEN len(n) > 0 AND len(k) > 0 THEN 'Product launch'
  WHEN len(n) > 0 THEN 'Announcement' WHEN len(k) > 0 THEN 'Product' ELSE 'Commentary' END AS category, {_REASONS_SQL} AS reasons
FROM (SELECT *, greatest(0, least(100, 30 + CASE WHEN len < 25 THEN -22 WHEN len > 90 THEN 6 ELSE 0 END - 12 * least(len(b), 3) + CASE WHEN len(n) > 0 THEN 22 + 8 * least(len(n) - 1, 3) ELSE 0 END
    + CASE WHEN len(k) > 0 THEN 10 + 5 * least(len(k) - 1, 4) ELSE 0 END + CASE WHEN len(m) > 0 THEN 14 + 6 * least(len(m) - 1, 3) ELSE 0 END + CASE WHEN metric THEN 8 ELSE 0 END)) AS score
  FROM (SELECT id, t, length(trim(r)) AS len, {", ".join(f"{_found_sql(terms)} AS {c}" for c, terms, _ in _LEXICA)}, {_METRIC_SQL} AS metric
    FROM (SELECT id, coalesce(summary, '') AS r, lower(trim(regexp_replace(coalesce(summary, ''), '\\s+', ' ', 'g'))) AS t FROM a )))""")
def post_verdicts(spark, sf):
    v = scoring.newsworthiness(F.col("summary"), banter=BANTER, announce=ANNOUNCE, tech=TECH, business=BUSINESS)
    return articles(spark, sf).select("id", v.alias("v")).select("id", "v.worthy", "v.category", F.array_join("v.reasons", "; ").alias("reasons"))


def _rules_sql(rules) -> str:
    return " ".join(f"WHEN len(list_filter(t, lambda x: {' OR '.join(f'''contains(x, '{n}')''' for n in needles)})) > 0 THEN '{name}'" for name, needles in rules)


CLASS_SQL = (
    f"coalesce(list_filter(c, lambda x: x IN ({quoted(full for full, _ in filters.CATEGORIES)}))[1], CASE {_rules_sql(classify.EARLY_RULES)} "
    + " ".join(f"WHEN sec = '{k}' THEN '{v}'" for k, v in classify.SECTIONS.items())
    + f" {_rules_sql(classify.LATE_RULES)} WHEN lower(reg) = 'research' THEN 'Science' ELSE 'Big Tech' END)"
)
CLASSIFIED = f"""(SELECT *, {CLASS_SQL} AS app_category FROM (SELECT *, lower(trim(coalesce(scholar_query, ''))) AS sec, coalesce(region, '') AS reg, coalesce(categories[2:], []) AS c,
  list_transform(list_concat([coalesce(scholar_query, '')], coalesce(categories[2:], [])), lambda x: lower(trim(x))) AS t FROM a ))"""


def classified(spark, sf):
    """Articles with app_category, judged on their query, in place of a section, and their categories without the first."""
    rest = F.slice("categories", 2, 100)
    category = classify.article_category(F.col("scholar_query"), rest, F.col("region"))
    return articles(spark, sf).withColumn("app_category", category)


@query("article_categories", f"SELECT id, app_category FROM {CLASSIFIED}")
def article_categories(spark, sf):
    return classified(spark, sf).select("id", "app_category")


GENRES = (("Mind", r"sleep|memory"), ("Fitness", r"strength|balance|tempo|sprint"), ("Nutrition", r"protein|creatine|caffeine"))


@query("paper_genres", "SELECT id, CASE WHEN topic = 'Sleep & Rest' THEN 'Rest' " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{n}'" for n, p in GENRES)
       + " ELSE 'Other' END AS genre FROM (SELECT id, topic, lower(concat_ws(' ', scholar_query, title)) AS h FROM a )")
def paper_genres(spark, sf):
    hay = F.lower(F.concat_ws(" ", "scholar_query", "title"))
    return articles(spark, sf).select("id", classify.tagged(F.col("topic"), {"Sleep & Rest": "Rest"}, classify.first_pattern(hay, GENRES, "Other")).alias("genre"))


@query("client_categories", "SELECT id, coalesce(CASE WHEN list_contains(categories, 'Fitness') THEN 'Fitness' END, CASE WHEN lower(section) = 'science' THEN 'Science' END, categories[1], 'Big Tech') AS category FROM a ")
def client_categories(spark, sf):
    labels = (("Fitness", "Fitness"), ("Science", "Science"))
    return articles(spark, sf).select("id", classify.client_category(F.col("categories"), F.col("section"), labels).alias("category"))


@query("inverted_index_text", r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS rebuilt FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")
def inverted_index_text(spark, sf):
    words = docs(spark, sf).select("doc_id", F.posexplode(F.split(text.squashed(F.col("text")), " ")).alias("p", "w")).filter("w <> ''")
    inverted = words.groupBy("doc_id", "w").agg(F.array_sort(F.collect_list("p")).alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return inverted.select("doc_id", feeds.from_inverted(F.col("m")).alias("rebuilt"))


@query("page_screens", """SELECT doc_id, CASE WHEN page = 'article' THEN 'article' WHEN page LIKE 'app/%' THEN 'app_other' ELSE 'site_other' END AS screen FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'app/x' ELSE 'about' END AS page FROM documents)""")
def page_screens(spark, sf):
    p = F.element_at(F.array(F.lit("/article.html"), F.lit("/app/x/"), F.lit("/about")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs(spark, sf).select("doc_id", urls.screen_name(p, {"/article": "article"}).alias("screen"))


@query("aliases", "SELECT c_custkey, printf('%04d', CAST('0x' || substr(md5(lower(c_name)), 1, 8) AS BIGINT) % 10000) AS alias, md5(lower(c_name)) AS opaque FROM customer")
def aliases(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hashing.alias_number(F.col("c_name")).alias("alias"), hashing.opaque_id(F.col("c_name")).alias("opaque"))


@query("embedded_objects", "SELECT doc_id, text AS t FROM documents")
def embedded_objects(spark, sf):
    page = F.concat(F.lit("<script>var data = "), F.to_json(F.struct("doc_id", F.col("text").alias("t"))), F.lit(";</script>"))
    return docs(spark, sf).select("doc_id", feeds.embedded_json(page, "var data").alias("j")).select("doc_id", F.get_json_object("j", "$.t").alias("t"))
