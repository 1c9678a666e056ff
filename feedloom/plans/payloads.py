"""Queries over raw payloads: feeds, indexes, pages and stored files, written from the test tables and read back by the sources.

Each payload is built from columns of the table, so its SQL says what the reader must find in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import dates, hashing, text, urls
from feedloom.operators import classify, merges
from feedloom.plans.base import NOW, Registry, articles, now
from feedloom.plans.texts import docs
from feedloom.runtime import shared_path, table
from feedloom.sources import feeds, tables

query = Registry()
N = f"TIMESTAMP '{NOW}'"
#: Records with a title and a link: what every feed delivers.
GIVEN = "a2 AS (SELECT *, date_trunc('second', refreshed_at) AS at_s FROM a WHERE coalesce(title, '') <> '' AND coalesce(link, '') <> '')"


def given(spark, sf):
    return articles(spark, sf).filter("title <> '' and link <> ''").withColumn("at", F.date_trunc("second", "refreshed_at"))


def _with(sql: str) -> str:
    return sql.replace("{A}", f"(WITH {GIVEN} SELECT * FROM a2) AS g").replace("FROM a WHERE", "FROM a WHERE")


def _tag(name: str, value, attributes: str = ""):
    return F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>"))


# --- feeds -----------------------------------------------------------------------------------------------------------------


@query("blog_posts", _with("""
SELECT id, link, title, strftime(at_s, '%Y-%m-%d %H:%M:%S') AS published, 'fitness' AS section, 'fitness,' || source_id AS categories, 'https://img.example/' || id || '.jpg' AS image FROM {A}"""))  # fmt: skip
def blog_posts(spark, sf):
    post = F.struct(
        F.lit(1).cast("bigint").alias("id"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("date_gmt"), "link", F.struct(F.col("title").alias("rendered")).alias("title"),
        F.struct(F.lit("<p>x</p>").alias("rendered")).alias("excerpt"), F.array(F.lit("post"), F.lit("category-fitness"), F.concat(F.lit("tag-"), "source_id"), F.lit("category-fitness")).alias("class_list"),
        F.concat(F.lit("https://img.example/"), "id", F.lit(".jpg")).alias("jetpack_featured_media_url"),
    )
    found = feeds.wp_posts(given(spark, sf).select("id", F.to_json(F.array(post)).alias("json")))
    return found.select("id", "link", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "section", F.array_join("categories", ",").alias("categories"), "image")


@query("syndicated_items", _with("""
SELECT id, link, title, strftime(at_s, '%Y-%m-%d %H:%M:%S') AS published, source_id AS author, array_to_string(list_distinct_in_order, ',') AS categories,
  CASE WHEN is_paper THEN NULL ELSE 'https://img.example/' || id || '.png' END AS image
FROM (SELECT *, list_filter(['News', topic], lambda x: x <> '') AS list_distinct_in_order FROM {A})"""))  # fmt: skip
def syndicated_items(spark, sf):
    a = given(spark, sf).withColumn("is_paper", F.coalesce("is_paper", F.lit(False)))
    topic = _tag("category", F.col("topic"))
    rss = F.concat(
        F.lit("<rss><channel><item>"), _tag("title", F.concat(F.lit("<![CDATA["), "title", F.lit("]]>"))), _tag("link", F.col("link")), _tag("pubDate", F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")),
        _tag("dc:creator", F.col("source_id")), _tag("category", F.lit("News")), topic, _tag("category", F.lit("News")), F.lit('<media:thumbnail width="9" url="https://img.example/'), "id", F.lit('.png"/></item></channel></rss>'),
    )
    atom = F.concat(
        F.lit("<feed><entry>"), _tag("title", F.col("title")), F.lit('<link href="'), "link", F.lit('" rel="alternate"/>'), _tag("updated", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _tag("author", _tag("name", F.col("source_id"))), F.lit('<category term="News"/><category term="'), "topic", F.lit('"/></entry></feed>'),
    )
    found = feeds.feed_items(a.select("id", F.when(F.col("is_paper"), atom).otherwise(rss).alias("xml")))
    return found.select("id", "link", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "author", F.array_join("categories", ",").alias("categories"), "image")


@query("preprint_entries", _with("""
SELECT id, title, link, source_id || ' +2' AS author, topic AS categories, strftime(at_s, '%Y-%m-%d %H:%M:%S') AS published FROM {A}"""))
def preprint_entries(spark, sf):
    entry = F.concat(
        F.lit("<feed><entry>"), _tag("id", F.col("link")), _tag("title", F.col("title")), _tag("summary", F.lit("s")), _tag("published", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        *[_tag("author", _tag("name", n)) for n in (F.col("source_id"), F.lit("B"), F.lit("C"))], F.lit('<category term="'), "topic", F.lit('"/></entry></feed>'),
    )
    found = feeds.preprints(given(spark, sf).select("id", entry.alias("xml")))
    return found.select("id", "title", "link", "author", F.array_join("categories", ",").alias("categories"), F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


# --- indexes ---------------------------------------------------------------------------------------------------------------


def index_works(spark, sf):
    """fitness as works of an index."""
    return given(spark, sf).select(
        F.col("id").alias("ord"), F.col("link").alias("id"), F.lit(None).cast("string").alias("doi"), F.when(F.col("is_paper"), "article").otherwise("dataset").alias("type"), "title",
        F.lit(False).alias("is_retracted"), F.lit(False).alias("is_paratext"), F.date_format("at", "yyyy-MM-dd").alias("publication_date"), F.col("citations").alias("cited_by_count"),
        F.struct(F.struct(F.col("venue").alias("display_name"), F.lit("journal").alias("type"), F.lit(True).alias("is_core")).alias("source"), F.col("canonical_url").alias("landing_page_url"), F.col("open_access_pdf").alias("pdf_url"), F.col("license_id").alias("license")).alias("primary_location"),
        F.struct(F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("pdf_url")).alias("best_oa_location"), F.array().cast("array<struct<license: string, pdf_url: string>>").alias("locations"),
        F.array(*[F.struct(F.struct(n.alias("display_name")).alias("author")) for n in (F.col("source_id"), F.lit("B"))]).alias("authorships"), F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"),
        F.array(F.struct(F.col("topic").alias("display_name"), F.lit(0.9).alias("score")), F.struct(F.lit("Weak").alias("display_name"), F.lit(0.1).alias("score"))).alias("concepts"),
        F.array(F.struct(F.col("scholar_query").alias("display_name"))).alias("topics"), F.array().cast("array<struct<display_name: string>>").alias("keywords"),
        F.struct(F.concat(F.lit("https://ids.example/"), F.regexp_extract("canonical_url", "/([0-9]+)", 1)).alias("pmid"), F.concat(F.lit("https://ids.example/articles/PMC"), F.regexp_extract("canonical_url", "/([0-9]+)", 1)).alias("pmcid")).alias("ids"),
    )


_DIGITS = "regexp_extract(canonical_url, '/([0-9]+)', 1)"
_WORKS = _with(f"""(SELECT id AS ord, title, coalesce(canonical_url, link) AS link, coalesce(citations, 0) AS citations, venue, source_id || ', B' AS author, 'a b a' AS summary, topic AS categories,
  CASE WHEN regexp_matches(coalesce(open_access_pdf, ''), '(?i)^https?://[^\\s/?#]+') THEN open_access_pdf END AS open_access_pdf, nullif(license_id, '') AS license_id, {_DIGITS} AS pmid, is_paper, scholar_query, at_s
  FROM {{A}} WHERE len(regexp_split_to_array(trim(title), '\\s+')) >= 3 AND date_trunc('day', at_s) <= {N})""")  # fmt: skip


@query("index_papers", f"SELECT ord, title, link, citations, venue, author, summary, categories, open_access_pdf, license_id, pmid, CASE WHEN pmid <> '' THEN 'PMC' || pmid ELSE '' END AS pmcid FROM {_WORKS}")
def index_papers(spark, sf):
    w = feeds.works(index_works(spark, sf), now())
    return w.select("ord", "title", "link", "citations", "venue", "author", "summary", F.array_join("categories", ",").alias("categories"), "open_access_pdf", "license_id", "pmid", "pmcid")


@query("trusted_works", f"""
SELECT ord FROM {_WORKS} WHERE is_paper AND coalesce(venue, '') <> '' AND date_trunc('day', at_s) >= CAST(CAST({N} AS DATE) - INTERVAL 24 MONTH AS TIMESTAMP)
  AND contains(lower(concat_ws(' ', title, scholar_query)), 'sleep') AND NOT contains(lower(concat_ws(' ', title, scholar_query)), 'placebo')""")
def trusted_works(spark, sf):
    works = index_works(spark, sf).withColumn("doi", F.concat(F.lit("https://doi.org/10.1234/"), "ord"))
    return feeds.trusted(feeds.works(works, now()), now(), ["sleep"], ["placebo"]).select("ord")


@query("index_topic_text", _with("SELECT id, concat_ws(' ', title, scholar_query, '', topic || ' Weak') AS topic_text, nullif(license_id, '') AS licence FROM {A}"))
def index_topic_text(spark, sf):
    return index_works(spark, sf).select(F.col("ord").alias("id"), feeds.topic_text().alias("topic_text"), feeds.license_hint().alias("licence"))


@query("resolved_ids", f"SELECT w.ord, a.id AS body_id FROM {_WORKS} w JOIN a ON regexp_extract(a.canonical_url, '/([0-9]+)', 1) = w.pmid AND w.pmid <> '' WHERE strlen(coalesce(a.summary, '')) BETWEEN 1 AND 200 ")
def resolved_ids(spark, sf):
    """Works whose id resolves to a body by an exact match, of bodies that have text and not more bytes than allowed."""
    bodies = articles(spark, sf).filter(F.octet_length(F.coalesce("summary", F.lit(""))).between(1, 200)).select(F.regexp_extract("canonical_url", "/([0-9]+)", 1).alias("pmid"), F.col("id").alias("body_id"))
    return feeds.works(index_works(spark, sf), now()).filter("pmid <> ''").join(bodies, "pmid").select("ord", "body_id")


@query("scholar_papers", _with(f"""
SELECT link, title, scholar_query AS topic, 'A Author' AS authors, nullif(trim(regexp_replace(v, ',?\\s*(?:19|20)\\d{{2}}\\s*$', '')), '') AS venue, published_year, greatest(0, coalesce(citations, 0)) AS citations
FROM (SELECT *, regexp_replace(coalesce(nullif(trim(venue), ''), 'None'), '\\s+', ' ', 'g') AS v FROM {{A}})
WHERE published_year BETWEEN 2024 AND 2027 AND regexp_matches(link, '(?i)^https?://[^\\s/?#]+')"""))  # fmt: skip
def scholar_papers(spark, sf):
    venue = F.regexp_replace(F.coalesce(F.nullif(F.trim("venue"), F.lit("")), F.lit("None")), r"\s+", " ")
    rows = given(spark, sf).select(
        F.col("scholar_query").alias("searchTerm"), F.lit(1).alias("position"), "title", "link", F.concat(F.lit("A Author - "), venue, F.lit(", "), F.col("published_year").cast("string"), F.lit(" - x.example")).alias("publicationInfo"),
        F.lit("").alias("snippet"), F.col("published_year").alias("year"), F.col("citations").alias("citedBy"), F.lit(None).cast("string").alias("pdfUrl"), "id",
    )
    return feeds.scholar_rows(rows, now()).select("link", "title", "topic", "authors", "venue", "published_year", "citations")


# --- posts -----------------------------------------------------------------------------------------------------------------


@query("social_posts", _with("""
SELECT id, title || ' see ' || canonical_url AS text, is_paper AS is_reply, source_id = 'citegrid' AS is_repost, length(id) % 2 = 0 AS is_quote, coalesce(open_access_pdf, '') <> '' AS has_media, topic AS categories
FROM (SELECT * REPLACE (coalesce(is_paper, false) AS is_paper) FROM {A}) WHERE canonical_url <> ''"""))  # fmt: skip
def social_posts(spark, sf):
    a = given(spark, sf).filter("canonical_url <> ''")
    post = a.select(
        "id", F.col("id").alias("id_str"), F.concat("title", F.lit(" see https://t.co/abc https://t.co/m1 ")).alias("full_text"), F.lit("").alias("created_at"), F.when(F.col("is_paper"), F.lit("1")).alias("in_reply_to_status_id_str"),
        (F.col("source_id") == "citegrid").alias("retweeted"), (F.length("id") % 2 == 0).alias("quoted"), F.col("citations").alias("favorite_count"), F.lit(0).cast("bigint").alias("retweet_count"),
        F.array(F.struct(F.lit("https://t.co/abc").alias("url"), F.col("canonical_url").alias("expanded_url"))).alias("urls"), F.when(text.truthy(F.col("open_access_pdf")), F.array(F.lit("m"))).alias("media"),
        F.array("topic", "topic").alias("hashtags"),
    )
    return feeds.posts(post).select("id", "text", "is_reply", "is_repost", "is_quote", "has_media", F.array_join("categories", ",").alias("categories"))


@query("labelled_items", _with("""
SELECT g.id, to_base_id AS short, s.source AS source, 'Europe' AS region, array_to_string(CASE WHEN list_contains(g.categories, s.provider) THEN g.categories ELSE list_append(g.categories, s.provider) END, ',') AS categories
FROM (SELECT *, lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(link, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, x: xor(h * 33, x) & 4294967295), 36)) AS to_base_id
  FROM (SELECT * REPLACE (coalesce(categories, []) AS categories) FROM {A})) g JOIN sources s USING (source_id)"""))  # fmt: skip
def labelled_items(spark, sf):
    dims = table(spark, sf, "sources").select(F.col("source_id").alias("id"), F.col("source").alias("name"), F.lit("Europe").alias("region"), F.lit("f").alias("focus"), F.col("provider").alias("cat"), F.lit(None).cast("string").alias("content_type"))
    items = given(spark, sf).select(F.col("id").alias("item"), "source_id", "link", "categories", "section")
    return feeds.labelled(items, dims).select(F.col("item").alias("id"), F.col("id").alias("short"), "source", "region", F.array_join("categories", ",").alias("categories")).filter("source is not null")


# --- pages -----------------------------------------------------------------------------------------------------------------


@query("page_images", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://cdn.example/' || doc_id || '.jpg' WHEN doc_id % 3 = 1 THEN 'https://site.example/img/' || doc_id || '.png' END AS image FROM documents")
def page_images(spark, sf):
    n = F.col("doc_id").cast("string")
    og = F.concat(F.lit('<head><meta property="og:image" content="https://cdn.example/'), n, F.lit('.jpg"></head>'))
    relative = F.concat(F.lit('<head><meta content="/img/'), n, F.lit('.png" name="twitter:image"></head>'))
    vector = F.concat(F.lit('<head><meta property="og:image" content="https://cdn.example/'), n, F.lit('.svg"></head>'))
    html = F.when(F.col("doc_id") % 3 == 0, og).when(F.col("doc_id") % 3 == 1, relative).otherwise(vector)
    return docs(spark, sf).select("doc_id", feeds.page_image(html, F.lit("https://site.example/a/b")).alias("image"))


_ARTICLE = "(SELECT id, title, trim(regexp_replace(coalesce(summary, ''), '\\s+', ' ', 'g')) AS s, source_id, coalesce(is_paper, false) AS p FROM {A} WHERE NOT regexp_matches(coalesce(summary, ''), '[<&]'))"


@query("article_blocks", _with(f"""
SELECT id, block_no, type, text, false AS truncated FROM (
  SELECT id, 0 AS block_no, 'heading' AS type, regexp_replace(title, '\\s+([,.;:!?])', '\\1', 'g') AS text FROM {_ARTICLE} UNION ALL
  SELECT id, 1, CASE WHEN p THEN 'citation' ELSE 'paragraph' END, regexp_replace(regexp_replace(s, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+([,.;:!?])', '\\1', 'g') FROM {_ARTICLE} UNION ALL
  SELECT id, 2, 'paragraph', 'The end' FROM {_ARTICLE}) WHERE length(text) >= 2"""))  # fmt: skip
def article_blocks(spark, sf):
    a = given(spark, sf).filter(~F.coalesce("summary", F.lit("")).rlike("[<&]"))
    opening = F.when(F.col("is_paper"), '<p content-type="citation">').otherwise("<p>")
    xml = F.concat(F.lit("<article><body><sec>"), _tag("title", F.col("title")), opening, F.coalesce("summary", F.lit("")), F.lit("</p><p>The <b>end</b></p></sec></body></article>"))
    return feeds.article_blocks(a.select("id", xml.alias("xml")), "id", "xml").select("id", "block_no", "type", "text", "truncated")


@query("article_people", _with("SELECT id, 'Ann ' || source_id || ', Bo Duval' AS people, CASE WHEN source_id = 'citegrid' THEN NULL ELSE 'CC-BY-4.0' END AS licence FROM {A}"))
def article_people(spark, sf):
    """Authors, each once, and the licence: none if the document's licences differ."""
    who = lambda given, family: F.concat(F.lit('<contrib contrib-type="author"><surname>'), family, F.lit("</surname><given-names>"), given, F.lit("</given-names></contrib>"))
    xml = F.concat(F.lit("<front>"), who(F.lit("Ann"), F.col("source_id")), who(F.lit("Bo"), F.lit("Duval")), who(F.lit("Bo"), F.lit("Duval")), F.lit("</front>"))
    by = "https://creativecommons.org/licenses/by/4.0/"
    stated = F.when(F.col("source_id") == "citegrid", F.array(F.lit(by), F.lit("https://creativecommons.org/licenses/by/3.0/"))).otherwise(F.array(F.lit(by), F.lit(by)))
    return given(spark, sf).select("id", F.array_join(feeds.article_authors(xml), ", ").alias("people"), classify.one_licence(stated).alias("licence"))


_LICENCE_TEXTS = ("cc-by-4.0", "CC BY 4.0", "Creative Commons cc by 3.0", "https://creativecommons.org/publicdomain/zero/1.0/", "public domain", "https://evil.example/licenses/by/4.0/", "all rights", "")


@query("licence_ids", "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'CC-BY-4.0' WHEN 1 THEN 'CC-BY-4.0' WHEN 2 THEN 'CC-BY-3.0' WHEN 3 THEN 'CC0-1.0' WHEN 4 THEN 'PDM-1.0' END AS licence FROM documents")
def licence_ids(spark, sf):
    stated = F.element_at(F.array(*map(F.lit, _LICENCE_TEXTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return docs(spark, sf).select("doc_id", classify.licence(stated).alias("licence"))


@query("allowed_addresses", r"SELECT id, coalesce(regexp_full_match(link, 'https://[^/:@]*\.example(/article/.*)') AND split_part(link, '/', 3) = 'tamvik-library.example', false) AS allowed FROM a ")
def allowed_addresses(spark, sf):
    return articles(spark, sf).select("id", F.coalesce(urls.is_allowed(F.col("link"), ["tamvik-library.example"], "/article/.*"), F.lit(False)).alias("allowed"))


@query("valid_ids", r"SELECT doc_id, regexp_full_match(h, '[0-9a-f]{32}') AS valid, regexp_full_match(coalesce(CAST(CAST(fetched_at AS DATE) AS VARCHAR), ''), '\d{4}-\d{2}-\d{2}') AS dated FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN md5(CAST(doc_id AS VARCHAR)) ELSE upper(md5(CAST(doc_id AS VARCHAR))) || 'x' END AS h FROM documents)")
def valid_ids(spark, sf):
    md5 = F.md5(F.col("doc_id").cast("string"))
    h = F.when(F.col("doc_id") % 2 == 0, md5).otherwise(F.concat(F.upper(md5), F.lit("x")))
    return docs(spark, sf).select("doc_id", h.rlike("^[0-9a-f]{32}$").alias("valid"), F.coalesce(F.to_date("fetched_at").cast("string"), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$").alias("dated"))


# --- stored tables -----------------------------------------------------------------------------------------------------------


@query("stored_json", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier")
def stored_json(spark, sf):
    """A JSON table written and read under its schema; a column that is not in the schema is left behind."""
    path = shared_path(spark, "stored-json")
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit(1).alias("unknown")).write.json(path)
    missing = tables.json_table(spark, path + "-none", "key bigint, name string, balance double", multi_line=False)
    return tables.json_table(spark, path, "key bigint, name string, balance double", multi_line=False).unionByName(missing)


@query("stored_partitions", "SELECT source_id, count(*) AS n FROM a WHERE source_id = 'openshelf' GROUP BY 1 UNION ALL SELECT 'none', count(*) FROM a WHERE false")
def stored_partitions(spark, sf):
    """A table written by partitions, of which one is read; others are not listed. A missing table reads as empty."""
    path = shared_path(spark, "stored-partitions")
    merges.write_partitions(articles(spark, sf).filter("source_id <> ''").select("id", "world_score", "source_id"), path, "source_id")
    schema = "id string, world_score int, source_id string"
    one = tables.partition(tables.parquet_table(spark, path, schema), "source_id", "openshelf").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(tables.parquet_table(spark, path + "-none", schema).agg(F.lit("none").alias("source_id"), F.count(F.lit(1)).alias("n")))


@query("orphans_removed", "SELECT source_id, count(*) AS n FROM a WHERE source_id <> '' AND source_id <> 'openshelf' GROUP BY 1")
def orphans_removed(spark, sf):
    """Partitions that a full run no longer delivers are removed with it."""
    path = shared_path(spark, "orphans")
    rows = articles(spark, sf).filter("source_id <> ''").select("id", "source_id")
    merges.write_partitions(rows, path, "source_id")
    merges.write_partitions(rows.filter("source_id <> 'openshelf'"), path, "source_id", whole=True)
    return spark.read.parquet(path).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("published_table", "SELECT doc_id, 2 AS version FROM documents")
def published_table(spark, sf):
    path = shared_path(spark, "published")
    for v in (1, 2):
        merges.publish(spark, docs(spark, sf).select("doc_id", F.lit(v).alias("version")), path)
    return merges.published(spark, path)


@query("key_violations", "SELECT 'fitness' AS \"table\", (SELECT count(*) FROM (SELECT id FROM fitness GROUP BY id HAVING count(*) > 1)) AS repeated UNION ALL SELECT 'customer', (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1))")
def key_violations(spark, sf):
    return merges.key_violations({"fitness": (table(spark, sf, "fitness"), ("id",)), "customer": (table(spark, sf, "customer"), ("c_custkey",))})


@query("dated_boards", "SELECT b.board, CAST(d AS DATE) AS date FROM (VALUES ('text'), ('code')) b(board), generate_series(DATE '2026-05-26', DATE '2026-06-01', INTERVAL 1 DAY) t(d)")
def dated_boards(spark, sf):
    return tables.date_spine(spark, ["text", "code"], "2026-06-01")


@query("query_plan", "SELECT topic, q.query, s.sort, CAST((q.i - 1) * 2 + s.i AS INTEGER) AS ord FROM (SELECT DISTINCT topic FROM a), (VALUES ('x', 1), ('y', 2)) q(query, i), (VALUES ('new', 0), ('best', 1)) s(sort, i)")
def query_plan(spark, sf):
    topics = articles(spark, sf).select("topic").distinct().withColumn("queries", F.array(F.lit("x"), F.lit("y")))
    return tables.query_plan(topics, "topic", "queries", ["new", "best"])


@query("fallback_text", "SELECT id, coalesce(nullif(summary, ''), nullif(title, ''), nullif(publisher, '')) AS payload FROM a ")
def fallback_text(spark, sf):
    ordered = F.array(*[F.struct(F.lit(i).alias("priority"), F.col(c).alias("payload")) for i, c in enumerate(("summary", "title", "publisher"))])
    return tables.first_non_empty(articles(spark, sf).select("id", F.inline(ordered)), "id", "priority", "payload").select("id", "payload")


@query("snapshot_or_live", f"SELECT id, 'live' AS origin FROM a UNION ALL SELECT id, 'fresh' FROM a WHERE coalesce(epoch_us({N} - refreshed_at) <= 7776000000000, false)")
def snapshot_or_live(spark, sf):
    """A snapshot that is too old reads as empty and the live rows take its place; one that is not, stays."""
    a = articles(spark, sf).select("id", "refreshed_at")
    old = tables.unless_stale(a, F.lit("2026-05-01").cast("timestamp_ntz"), now())
    fresh = tables.unless_stale(a, F.col("refreshed_at"), now(), 90)
    return tables.or_else(old, a).select("id", F.lit("live").alias("origin")).unionByName(tables.or_else(fresh, a.limit(0)).select("id", F.lit("fresh").alias("origin")))


# --- dates and small texts ---------------------------------------------------------------------------------------------------


@query("feed_dates", _with("SELECT id, at_s AS rfc, at_s - INTERVAL 2 HOUR AS iso, at_s + INTERVAL 7 HOUR AS platform, at_s - INTERVAL 21 DAY AS ago FROM {A}"))
def feed_dates(spark, sf):
    at = F.col("at")
    found = given(spark, sf).select(
        "id", dates.feed_date(F.date_format(at, "dd MMM yyyy HH:mm:ss 'GMT'")).alias("rfc"), dates.feed_date(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).alias("iso"),
        dates.feed_date(F.date_format(at, "EEE MMM dd HH:mm:ss '-0700' yyyy")).alias("platform"), dates.relative_instant(F.lit("3 weeks ago"), at).alias("ago"),
    )
    return found


_SPOKEN = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(coalesce({}, ''), '<[^>]+>', ' ', 'g')), 'https?://\\S+', ' ', 'g'), '\\b10\\.\\d{{4,9}}/\\S+', ' ', 'g'), '\\[[^\\]]{{0,40}}\\]', ' ', 'g')"
_SPOKEN_STEPS = (
    ("[*_`#|]+", " "), (r"\bet al\.?", "and colleagues"), (r"\be\.g\.,?", "for example,"), (r"\bi\.e\.,?", "that is,"), (r"\bvs\.?\b", "versus"), ("[“”]", '"'), ("[‘’]", "''"), ("[‐‑‒–—]", "-"),
    (r"\s-\s", ", "), ("…", " "), (r"\s+", " "), (r"^\s+|\s+$", ""), (r"\s+([,.;:!?])", r"\1"), (r"\.\.+", "."), (",,+", ","), (";;+", ";"), ("::+", ":"), ("!!+", "!"), (r"\?\?+", "?"), (r",\s*([.!?])", r"\1"), (r"^[^A-Za-z0-9\"'']+", ""),
)


def spoken_sql(c: str, limit: int) -> str:
    out = _SPOKEN.format(c)
    for pattern, by in _SPOKEN_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'gi')"
    return f"(SELECT trim(CASE WHEN length(x) > {limit} THEN regexp_replace(substr(x, 1, {limit}), '\\s+\\S*$', '') ELSE x END) FROM (SELECT {out} AS x))"


@query("spoken_texts", f"SELECT id, {spoken_sql('title', 220)} AS title, {spoken_sql('venue', 90)} AS venue FROM a ")
def spoken_texts(spark, sf):
    return articles(spark, sf).select("id", text.speakable(F.col("title"), 220).alias("title"), text.speakable(F.col("venue"), 90).alias("venue"))


@query("redacted_addresses", "SELECT doc_id, 'db://[redacted]@h.example/' || doc_id || ' and ' || coalesce(url, '') AS safe FROM documents")
def redacted_addresses(spark, sf):
    return docs(spark, sf).select("doc_id", text.redacted(F.concat(F.lit("db://user:secret@h.example/"), F.col("doc_id").cast("string"), F.lit(" and "), F.coalesce("url", F.lit("")))).alias("safe"))


@query("chunked_keywords", "SELECT id, CAST(ceil(len(categories) / 2) AS INTEGER) AS n, array_to_string(categories[1:2], ',') AS first_chunk FROM a WHERE len(categories) > 0")
def chunked_keywords(spark, sf):
    c = text.chunks(F.col("categories"), 2)
    return articles(spark, sf).filter(F.size("categories") > 0).select("id", F.size(c).alias("n"), F.array_join(F.get(c, 0), ",").alias("first_chunk"))


@query("tag_texts", "SELECT doc_id, coalesce(topic, '') AS inner FROM documents")
def tag_texts(spark, sf):
    return docs(spark, sf).select("doc_id", text.tag_text(F.concat(F.lit('<a><b x="1">'), F.coalesce("topic", F.lit("")), F.lit("</b><b>no</b></a>")), "b").alias("inner"))


@query("poster_addresses", "SELECT doc_id, 'https://img.example/p?t=' || doc_id || '&s=a+b%26c' AS poster, CASE WHEN regexp_matches(coalesce(url, ''), '(?i)^https?://[^\\s/?#]+') AND NOT regexp_matches(lower(url), '\\.svg(?:[?#]|$)|image/svg') THEN true ELSE false END AS raster FROM documents")
def poster_addresses(spark, sf):
    return docs(spark, sf).select("doc_id", urls.poster("https://img.example/p", t=F.col("doc_id").cast("string"), s=F.lit("a b&c")).alias("poster"), urls.is_raster(F.col("url")).alias("raster"))


@query("offset_times", "SELECT doc_id, floor([0.0, 0.1234567, 2.5][CAST(least(greatest(0, doc_id % 5), 2) AS INTEGER) + 1] * 1000 + 0.5) / 1000 AS at FROM documents")
def offset_times(spark, sf):
    from feedloom.operators.documents import time_at

    times = F.array(*[F.lit(x).cast("double") for x in (0.0, 0.1234567, 2.5)])
    return docs(spark, sf).select("doc_id", time_at(times, (F.col("doc_id") % 5).cast("double")).alias("at"))


@query("hashed_ids", """
SELECT doc_id, lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(url, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, x: xor(h * 33, x) & 4294967295), 36)) AS short_id FROM documents WHERE url <> ''""")
def hashed_ids(spark, sf):
    return docs(spark, sf).filter("url <> ''").select("doc_id", hashing.short_id(F.col("url")).alias("short_id"))
