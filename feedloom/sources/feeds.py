"""Raw payloads of feeds and indexes to records. Input: one row per payload, with `ord`, its place in the order of collection."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import dates, hashing, text, urls

# --- posts of the common blog API -----------------------------------------------------------------------------------------

WP_POST = (
    "struct<id: bigint, date_gmt: string, link: string, title: struct<rendered: string>, excerpt: struct<rendered: string>, class_list: array<string>, jetpack_featured_media_url: string>"
)


def wp_posts(pages: DataFrame, payload: str = "json") -> DataFrame:
    """One row per post of each page (a JSON array): categories are tags after categories, the first is the section."""
    posts = pages.select("*", F.posexplode_outer(F.from_json(payload, f"array<{WP_POST}>")).alias("post_no", "p")).filter("p is not null")
    prefixed = lambda p: F.transform(F.filter(F.coalesce("p.class_list", F.array().cast("array<string>")), lambda c: c.startswith(p)), lambda c: c.substr(F.lit(len(p) + 1), F.length(c)))
    cats, tags = prefixed("category-"), prefixed("tag-")
    return posts.select(
        *[c for c in pages.columns if c != payload], "post_no", F.col("p.link").alias("link"), text.clean_text(F.col("p.title.rendered"), 300).alias("title"),
        text.clean_text(F.col("p.excerpt.rendered")).alias("summary"), dates.strict_date(F.concat(F.regexp_replace("p.date_gmt", "Z$", ""), F.lit("Z"))).alias("published"),
        F.array_distinct(F.concat(cats, tags)).alias("categories"), F.get(cats, 0).alias("section"), F.nullif(F.col("p.jetpack_featured_media_url"), F.lit("")).alias("image"),
    )


# --- RSS and Atom -----------------------------------------------------------------------------------------------------------


def attribute(xml: Column, tag: str, name: str, where: str = "") -> Column:
    """The first value of an attribute of a tag, wherever in the tag it stands."""
    element = F.regexp_extract(xml, rf"(?is)(<{tag}\b[^>]*{where}[^>]*>)", 1)
    return F.nullif(F.regexp_extract(element, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def image_of(block: Column) -> Column:
    """The first of: raster media content, media thumbnail, image enclosure, first image in the content."""
    raster = lambda u: F.when(urls.is_raster(u), u)
    content = text.decoded_entities(F.concat_ws(" ", text.without_cdata(text.tag_text(block, "content:encoded")), text.without_cdata(text.tag_text(block, "description"))))
    return F.coalesce(
        F.when(attribute(block, "media:content", "url").rlike(r"(?i)\.(jpe?g|png|webp|gif|avif)(\?|$)"), attribute(block, "media:content", "url")),
        raster(attribute(block, "media:thumbnail", "url")), raster(attribute(block, "enclosure", "url", r"type\s*=\s*[\"']image/")), raster(attribute(content, "img", "src")),
    )


def feed_items(feeds: DataFrame, payload: str = "xml", most: int = 30, drop_title: str | None = None) -> DataFrame:
    """One row per item of an RSS or Atom text. The cap counts blocks before any validity check, as sources deliver them."""
    atom = F.col(payload).rlike(r"(?i)<entry\b") & ~F.col(payload).rlike(r"(?i)<item\b")
    blocks = F.when(atom, F.regexp_extract_all(payload, F.lit(r"(?is)(<entry\b.*?</entry>)"), 1)).otherwise(F.regexp_extract_all(payload, F.lit(r"(?is)(<item\b.*?</item>)"), 1))
    b = F.col("block")
    inner = lambda t: text.without_cdata(text.tag_text(b, t))
    link = F.coalesce(F.nullif(F.trim(text.decoded_entities(inner("link"))), F.lit("")), attribute(b, "link", "href", r"rel\s*=\s*[\"']alternate[\"']"), attribute(b, "link", "href"))
    labels = F.when(F.col("atom"), F.regexp_extract_all("block", F.lit(r"(?is)<category\b[^>]*term\s*=\s*[\"']([^\"']*)[\"']"), 1)).otherwise(
        F.regexp_extract_all("block", F.lit(r"(?is)<category\b[^>]*>(.*?)</category>"), 1)
    )
    when = F.coalesce(*[F.nullif(F.trim(inner(t)), F.lit("")) for t in ("pubDate", "published", "updated", "dc:date")])
    items = feeds.withColumn("atom", atom).select(*[c for c in feeds.columns if c != payload], "atom", F.posexplode(F.slice(blocks, 1, most)).alias("item_no", "block"))
    out = items.select(
        *[c for c in feeds.columns if c != payload], "item_no", text.clean_text(inner("title"), 300).alias("title"), link.alias("link"),
        text.clean_text(F.coalesce(*[F.nullif(inner(t), F.lit("")) for t in ("description", "summary", "content")])).alias("summary"), dates.feed_date(when).alias("published"),
        text.clean_text(F.coalesce(F.nullif(inner("dc:creator"), F.lit("")), text.tag_text(inner("author"), "name"), inner("author")), 120).alias("author"),
        F.slice(F.array_distinct(F.filter(F.transform(labels, lambda c: text.clean_text(c, 80)), lambda c: c != "")), 1, 12).alias("categories"), image_of(b).alias("image"),
    )
    out = out.filter((F.col("title") != "") & F.col("link").isNotNull())
    return out.filter(~F.col("title").rlike(drop_title)) if drop_title else out


def preprints(feeds: DataFrame, payload: str = "xml", most: int = 100) -> DataFrame:
    """Atom entries of a preprint server: up to six authors, one label "first +n"; subject labels and raw codes, at most twelve."""
    b = F.col("block")
    entries = feeds.select(*[c for c in feeds.columns if c != payload], F.posexplode(F.slice(F.regexp_extract_all(payload, F.lit(r"(?is)(<entry\b.*?</entry>)"), 1), 1, most)).alias("item_no", "block"))
    authors = F.slice(F.transform(F.regexp_extract_all(b, F.lit(r"(?is)<name>(.*?)</name>"), 1), lambda a: text.clean_text(a, 80)), 1, 6)
    label = F.when(F.size(authors) > 2, F.concat(F.get(authors, 0), F.lit(" +"), (F.size(authors) - 1).cast("string"))).otherwise(F.array_join(authors, ", "))
    codes = F.regexp_extract_all(b, F.lit(r"(?is)<category\b[^>]*term\s*=\s*[\"']([^\"']*)[\"']"), 1)
    return entries.select(
        *[c for c in feeds.columns if c != payload], "item_no", text.clean_text(text.tag_text(b, "title"), 300).alias("title"), F.trim(text.tag_text(b, "id")).alias("link"),
        text.clean_text(text.tag_text(b, "summary"), 360).alias("summary"), dates.feed_date(F.trim(text.tag_text(b, "published"))).alias("published"), label.alias("author"),
        F.slice(F.array_distinct(codes), 1, 12).alias("categories"),
    )


# --- scholarly indexes ------------------------------------------------------------------------------------------------------

WORK = (
    "id string, doi string, type string, title string, is_retracted boolean, is_paratext boolean, publication_date string, cited_by_count bigint, "
    "primary_location struct<source: struct<display_name: string, type: string, is_core: boolean>, landing_page_url: string, pdf_url: string, license: string>, "
    "best_oa_location struct<license: string, pdf_url: string>, locations array<struct<license: string, pdf_url: string>>, "
    "authorships array<struct<author: struct<display_name: string>>>, abstract_inverted_index map<string, array<int>>, "
    "concepts array<struct<display_name: string, score: double>>, topics array<struct<display_name: string>>, keywords array<struct<display_name: string>>, ids struct<pmid: string, pmcid: string>"
)


def from_inverted(index: Column) -> Column:
    """Text of an inverted index: words placed at their positions, gaps closed."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def topic_text(df_prefix: str = "") -> Column:
    """Title, topics, keywords and concepts in one text; the abstract is left out on purpose."""
    names = lambda c: F.array_join(F.transform(F.coalesce(F.col(df_prefix + c), F.array().cast("array<struct<display_name: string>>")), lambda x: x["display_name"]), " ")
    concepts = F.array_join(F.transform(F.coalesce(F.col(df_prefix + "concepts"), F.array().cast("array<struct<display_name: string, score: double>>")), lambda x: x["display_name"]), " ")
    return F.concat_ws(" ", F.col(df_prefix + "title"), names("topics"), names("keywords"), concepts)


def license_hint() -> Column:
    """The first licence among best, primary and all locations."""
    every = F.concat(F.array("best_oa_location.license", "primary_location.license"), F.transform(F.coalesce("locations", F.array().cast("array<struct<license: string, pdf_url: string>>")), lambda x: x["license"]))
    return F.get(F.filter(every, lambda x: F.coalesce(x != "", F.lit(False))), 0)


def works(df: DataFrame, now: Column) -> DataFrame:
    """Index works to papers: three words of title at least, a link, no future date; concepts above .3 are categories."""
    link = F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.col("primary_location.landing_page_url"), F.col("id"))
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda a: a.isNotNull())
    author = F.when(F.size(names) > 2, F.concat(F.get(names, 0), F.lit(" +"), (F.size(names) - 1).cast("string"))).otherwise(F.array_join(names, ", "))
    strong = F.slice(F.transform(F.filter("concepts", lambda c: c["score"] > 0.3), lambda c: c["display_name"]), 1, 4)
    out = df.select(
        *[c for c in ("ord",) if c in df.columns], hashing.short_id(link).alias("id"), text.clean_text(F.col("title"), 300).alias("title"), link.alias("link"), F.col("doi"),
        dates.strict_date(F.col("publication_date")).alias("published"), F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.col("primary_location.source.display_name").alias("venue"),
        author.alias("author"), text.clipped(from_inverted(F.col("abstract_inverted_index")), 360).alias("summary"), F.slice(strong, 1, 8).alias("categories"),
        urls.first_valid(F.col("best_oa_location.pdf_url"), F.col("primary_location.pdf_url"), F.get(F.transform("locations", lambda x: x["pdf_url"]), 0)).alias("open_access_pdf"),
        license_hint().alias("license_id"), F.regexp_extract(F.coalesce("ids.pmcid", F.lit("")), r"(PMC\d+)", 1).alias("pmcid"), F.regexp_extract(F.coalesce("ids.pmid", F.lit("")), r"(\d+)/?$", 1).alias("pmid"),
        "type", "is_retracted", "is_paratext", F.col("primary_location.source.type").alias("source_type"), F.col("primary_location.source.is_core").alias("is_core"), topic_text().alias("topic_text"),
    )
    return out.filter((F.size(F.split("title", r"\s+")) >= 3) & F.col("link").isNotNull() & (F.col("published").isNull() | (F.col("published") <= now)))


def trusted(papers: DataFrame, now: Column, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Articles with a DOI in a core named journal, neither retracted nor paratext, in the window and on the topic."""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    window = (F.col("published") >= dates.rolling_cutoff(now).cast("timestamp_ntz")) & (F.col("published") <= now)
    return papers.filter(
        (F.col("type") == "article") & ~true("is_retracted") & ~true("is_paratext") & (urls.host(F.col("doi")) == "doi.org") & true("is_core") & (F.col("source_type") == "journal")
        & text.truthy(F.col("venue")) & window & text.matches_topic(F.col("topic_text"), include, exclude)
    )


SCHOLAR_ROW = "searchTerm string, position int, title string, link string, publicationInfo string, snippet string, year int, citedBy bigint, pdfUrl string, id string"


def scholar_rows(df: DataFrame, now: Column, rejected_host: str = r"^scholar\.") -> DataFrame:
    """Search rows to papers of year precision: a title and a link that leaves the search engine, in the window of years."""
    info = text.publication_info(F.col("publicationInfo"))
    out = df.withColumn("__i", info).select(
        *[c for c in ("ord",) if c in df.columns], F.col("searchTerm").alias("topic"), text.clean_text(F.col("title"), 300).alias("title"), "link", F.col("__i.authors").alias("authors"),
        F.nullif("__i.venue", F.lit("")).alias("venue"), F.coalesce("year", "__i.year").alias("published_year"), F.lit("year").alias("date_precision"),
        F.greatest(F.lit(0), F.coalesce("citedBy", F.lit(0))).alias("citations"), text.clean_text(F.col("snippet"), 300).alias("summary"), F.nullif("pdfUrl", F.lit("")).alias("open_access_pdf"),
    )
    return out.filter((F.col("title") != "") & urls.is_http(F.col("link")) & ~urls.host(F.col("link")).rlike(rejected_host) & dates.in_year_window(F.col("published_year"), now))


# --- pages ------------------------------------------------------------------------------------------------------------------


def _balanced(source: str, start: int) -> str | None:
    """The object or array that begins at start, by counting brackets outside strings."""
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(source)):
        ch = source[i]
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth == 0:
                return source[start : i + 1]
    return None


def embedded_json(html: Column, name: str) -> Column:
    """The JSON assigned to a name in a page's scripts; null if there is none that parses. Brackets are no regular language, hence Python."""

    def run(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages:
            found = None
            at = (p or "").find(name)
            while at >= 0 and found is None:
                starts = [x for x in ((p.find("{", at)), (p.find("[", at))) if x >= 0]
                piece = _balanced(p, min(starts)) if starts and p[at + len(name) : min(starts)].strip(" =:\"'\n\t") == "" else None
                if piece:
                    try:
                        json.loads(piece)
                        found = piece
                    except ValueError:
                        pass
                at = p.find(name, at + 1)
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(html)


def first_object(reply: Column) -> Column:
    """The first JSON object in prose, reasoning blocks dropped; null if none parses."""

    def run(texts: pd.Series) -> pd.Series:
        import re

        out = []
        for t in texts:
            t = re.sub(r"<think>.*?</think>", "", t or "", flags=re.S | re.I)
            found = None
            at = t.find("{")
            while at >= 0 and found is None:
                piece = _balanced(t, at)
                try:
                    found = piece and json.dumps(json.loads(piece), ensure_ascii=False)
                except ValueError:
                    pass
                at = t.find("{", at + 1)
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(reply)


def nested_objects(payload: Column, key: str, most: int | None = None) -> Column:
    """All objects anywhere in a JSON text that have `key`, one per value of it, as an array of JSON texts."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found: dict = {}

            def walk(x, found=found):
                if isinstance(x, dict):
                    if isinstance(x.get(key), str):
                        found.setdefault(x[key], json.dumps(x, ensure_ascii=False))
                    for v in x.values():
                        walk(v)
                elif isinstance(x, list):
                    for v in x:
                        walk(v)

            try:
                walk(json.loads(t) if t else None)
            except ValueError:
                pass
            out.append(list(found.values())[:most])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<string>")(payload)


#: Names under which pages declare their preview image, in order.
IMAGE_NAMES = ("og:image:secure_url", "og:image", "twitter:image", "twitter:image:src")


def page_image(html: Column, page_url: Column, cap: int = 300_000) -> Column:
    """The declared preview image, absolute, and no vector graphic."""
    head = F.substring(html, 1, cap)
    found = []
    for n in IMAGE_NAMES:
        found.append(F.regexp_extract(head, rf"(?is)<meta\b[^>]*(?:property|name)\s*=\s*[\"']{n}[\"'][^>]*content\s*=\s*[\"']([^\"']+)[\"']", 1))
        found.append(F.regexp_extract(head, rf"(?is)<meta\b[^>]*content\s*=\s*[\"']([^\"']+)[\"'][^>]*(?:property|name)\s*=\s*[\"']{n}[\"']", 1))
    url = urls.resolved(text.decoded_entities(F.coalesce(*[F.nullif(f, F.lit("")) for f in found])), page_url)
    return F.when(urls.is_raster(url), url)


def article_blocks(documents: DataFrame, key: str, xml: str, chars: int = 120_000, count: int = 160) -> DataFrame:
    """Typed blocks (heading, paragraph, citation) of a structured article's body, in order, cut off with a flag."""
    from feedloom.operators.documents import cut_off

    body = F.regexp_extract(xml, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    parts = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:title|p)\b[^>]*>.*?</(?:title|p)>)"), 1)
    out = documents.select(key, F.posexplode(parts).alias("block_no", "raw"))
    opening = F.regexp_extract("raw", "^(<[^>]*>)", 1)
    heading = F.lower("raw").startswith("<title")
    cited = opening.rlike(r"(?i)\b(content-type|specific-use)\s*=\s*[\"'](citation|reference)[\"']")
    kind = F.when(heading, "heading").when(cited, "citation").otherwise("paragraph")
    out = out.select(key, "block_no", kind.alias("type"), F.when(heading, text.sanitized(F.col("raw"), 500)).otherwise(text.sanitized(F.col("raw"), 8000)).alias("text"))
    return cut_off(out.filter(F.length("text") >= 2), key, "block_no", "text", chars, count)


def article_authors(xml: Column, most: int = 12) -> Column:
    """Distinct "given surname" of the contributors."""
    names = F.regexp_extract_all(xml, F.lit(r"(?is)<contrib\b[^>]*>(.*?)</contrib>"), 1)
    full = F.transform(names, lambda n: F.trim(F.concat_ws(" ", text.sanitized(text.tag_text(n, "given-names")), text.sanitized(text.tag_text(n, "surname")))))
    return F.slice(F.array_distinct(F.filter(full, lambda n: n != "")), 1, most)


# --- posts ------------------------------------------------------------------------------------------------------------------

POST = (
    "id_str string, full_text string, created_at string, in_reply_to_status_id_str string, retweeted boolean, quoted boolean, favorite_count bigint, retweet_count bigint, "
    "urls array<struct<url: string, expanded_url: string>>, media array<string>, hashtags array<string>"
)


def post_text(full: Column, links: Column) -> Column:
    """Short links expanded, media links at the end dropped."""
    t = F.aggregate(F.coalesce(links, F.array().cast("array<struct<url: string, expanded_url: string>>")), text.text_of(full), lambda acc, u: F.replace(acc, u["url"], F.coalesce(u["expanded_url"], F.lit(""))))
    return text.squashed(F.regexp_replace(t, r"(?:\s*https://t\.co/\w+)+\s*$", ""))


def posts(df: DataFrame) -> DataFrame:
    """Social posts with their flags; hashtags become categories, at most ten."""
    t = F.col("full_text")
    return df.select(
        "*", post_text(t, F.col("urls")).alias("text"), (F.col("in_reply_to_status_id_str").isNotNull() | t.startswith("@")).alias("is_reply"),
        (F.coalesce("retweeted", F.lit(False)) | t.startswith("RT @")).alias("is_repost"), F.coalesce("quoted", F.lit(False)).alias("is_quote"),
        (F.size(F.coalesce("media", F.array().cast("array<string>"))) > 0).alias("has_media"), F.slice(F.array_distinct(F.coalesce("hashtags", F.array().cast("array<string>"))), 1, 10).alias("categories"),
    )


def labelled(items: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Items with their source's label, region and focus; its category hint comes last, and the section has a default."""
    d = sources.select(F.col("id").alias(key), F.col("name").alias("source"), "region", "focus", F.col("cat").alias("__cat"), F.col("content_type").alias("__type"))
    cats = F.coalesce("categories", F.array().cast("array<string>"))
    hinted = F.when(F.col("__cat").isNotNull() & ~F.array_contains(cats, F.col("__cat")), F.array_append(cats, F.col("__cat"))).otherwise(cats)
    out = items.drop("source", "region", "focus", "content_type").join(d, key, "left").withColumn("categories", hinted)
    return (
        out.withColumn("id", hashing.short_id(F.col("link"))).withColumn("content_type", F.coalesce("__type", urls.content_type(F.col("link"))))
        .withColumn("section", F.coalesce(F.nullif(F.col("section"), F.lit("")) if "section" in items.columns else F.lit(None), F.get("categories", 0), "focus")).drop("__cat", "__type")
    )
