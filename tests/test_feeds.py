import json

from pyspark.sql import functions as F

from feedloom.sources import feeds, tables

RSS = """<rss><channel><item><title><![CDATA[One &amp; two]]></title><link>https://a.example/1</link><description>&lt;p&gt;Text &lt;img src="https://a.example/i.jpg"&gt;&lt;/p&gt;</description>
<pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><category>News</category><category>News</category><dc:creator>Ann</dc:creator></item>
<item><title></title><link>https://a.example/2</link></item><item><title>Third</title><link>https://a.example/3</link><enclosure type="image/png" url="https://a.example/e.png"/></item></channel></rss>"""
ATOM = """<feed><entry><title>Atom one</title><link rel="alternate" href="https://b.example/1"/><updated>2024-01-02T10:00:00Z</updated><category term="x"/><author><name>Bob</name></author></entry></feed>"""


def test_feed_items(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("n", None), ("e", "")], "feed string, xml string")
    rows = {(r["feed"], r["item_no"]): r for r in feeds.feed_items(df).collect()}
    assert set(rows) == {("r", 0), ("r", 2), ("a", 0)}
    one = rows["r", 0]
    assert (one["title"], one["link"], one["summary"], one["author"], one["categories"], one["image"]) == ("One & two", "https://a.example/1", "Text", "Ann", ["News"], "https://a.example/i.jpg")
    assert str(one["published"]) == "2024-01-02 10:00:00" == str(rows["a", 0]["published"])
    assert rows["r", 2]["image"] == "https://a.example/e.png"
    assert rows["a", 0]["link"] == "https://b.example/1"
    # The cap comes before validity.
    assert {r["item_no"] for r in feeds.feed_items(df.filter("feed = 'r'"), most=2).collect()} == {0}


def test_wp_posts(spark):
    page = json.dumps([{"id": 1, "date_gmt": "2024-01-02T03:04:05", "link": "https://a.example/p", "title": {"rendered": "T &#8211; x"}, "excerpt": {"rendered": "<p>E</p>"}, "class_list": ["category-ai", "tag-ml", "post", "category-ai"]}])
    df = spark.createDataFrame([("s", page), ("bad", "{"), ("none", None)], "source_id string, json string")
    (r,) = feeds.wp_posts(df).collect()
    assert (r["title"], r["summary"], r["categories"], r["section"], str(r["published"])) == ("T – x", "E", ["ai", "ml"], "ai", "2024-01-02 03:04:05")


def test_preprints(spark):
    names = "".join(f"<author><name>N{i}</name></author>" for i in range(8))
    xml = f'<feed><entry><id>http://x/1v2</id><title>A title</title><summary>S</summary><published>2024-01-01T00:00:00Z</published>{names}<category term="cs.AI"/></entry></feed>'
    (r,) = feeds.preprints(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert (r["author"], r["categories"]) == ("N0 +5", ["cs.AI"])


def test_works(spark):
    base = {
        "id": "W1", "doi": "https://doi.org/10.1/x", "type": "article", "title": "A study of muscle", "is_retracted": False, "is_paratext": False, "publication_date": "2025-01-01", "cited_by_count": 3,
        "primary_location": {"source": {"display_name": "J", "type": "journal", "is_core": True}, "pdf_url": "https://p.example/a.pdf"}, "best_oa_location": {"license": "cc-by"},
        "authorships": [{"author": {"display_name": n}} for n in ("A", "B", "C")], "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "concepts": [{"display_name": "Muscle", "score": 0.9}, {"display_name": "No", "score": 0.1}],
    }
    variants = [base] + [base | x for x in ({"type": "book"}, {"is_retracted": True}, {"is_paratext": True}, {"doi": "https://elsewhere.example/1"}, {"publication_date": "2019-01-01"}, {"publication_date": "2024-02-30"}, {"title": "About something else entirely", "concepts": []})]
    df = spark.createDataFrame([(json.dumps(v),) for v in variants], "j string").select(F.from_json("j", feeds.WORK).alias("w")).select("w.*")
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    papers = feeds.works(df, now)
    kept = feeds.trusted(papers, now, ["muscle"], ["placebo"]).collect()
    assert len(kept) == 1
    r = kept[0]
    assert (r["author"], r["summary"], r["categories"], r["license_id"], r["open_access_pdf"], r["citations"]) == ("A +2", "a b a", ["Muscle"], "cc-by", "https://p.example/a.pdf", 3)


def test_scholar_rows(spark):
    rows = [("t", 1, "A title here", "https://x.example/1", "A - J of X, 2025 - x.example", "s", None, 5, None, "i"), ("t", 2, "B", "https://scholar.x.example/1", "", "", 2025, 1, None, "i"), ("t", 3, "C", "https://x.example/2", "", "", 2001, 1, None, "i")]
    (r,) = feeds.scholar_rows(spark.createDataFrame(rows, feeds.SCHOLAR_ROW), F.lit("2026-01-01").cast("timestamp_ntz")).collect()
    assert (r["venue"], r["published_year"], r["citations"]) == ("J of X", 2025, 5)


def test_json_in_pages(spark):
    page = 'var x = 1; var data = {"a": "}\\"", "b": [{"videoId": "v1", "t": 1}, {"videoId": "v1"}, {"videoId": "v2"}]}; more'
    df = spark.createDataFrame([(page,), ("var data = {broken",), (None,)], "p string")
    got = [r[0] for r in df.select(feeds.embedded_json(F.col("p"), "var data")).collect()]
    assert json.loads(got[0])["a"] == '}"' and got[1:] == [None, None]
    inner = df.select(feeds.embedded_json(F.col("p"), "var data").alias("j")).select(feeds.nested_objects(F.col("j"), "videoId").alias("v")).first()["v"]
    assert [json.loads(v)["videoId"] for v in inner] == ["v1", "v2"]
    reply = spark.createDataFrame([('<think>{"no": 1}</think> Sure: {"yes": {"a": 1}} done',)], "r string")
    assert json.loads(reply.select(feeds.first_object(F.col("r"))).first()[0]) == {"yes": {"a": 1}}


def test_page_image(spark):
    html = '<meta content="//c.example/i.png" property="og:image">'
    df = spark.createDataFrame([(html, "https://a.example/x"), ('<meta property="og:image" content="/i.svg">', "https://a.example/x"), ("", "https://a.example/")], "h string, u string")
    assert [r[0] for r in df.select(feeds.page_image(F.col("h"), F.col("u"))).collect()] == ["https://c.example/i.png", None, None]


def test_article_blocks(spark):
    xml = "<front><contrib><surname>S</surname><given-names>G</given-names></contrib><contrib><surname>S</surname><given-names>G</given-names></contrib></front><body><sec><title>Head</title><p>One <b>two</b></p><p></p></sec></body>"
    df = spark.createDataFrame([("p", xml)], "pmcid string, xml string")
    rows = feeds.article_blocks(df, "pmcid", "xml").orderBy("block_no").collect()
    assert [(r["type"], r["text"], r["truncated"]) for r in rows] == [("heading", "Head", False), ("paragraph", "One two", False)]
    assert df.select(feeds.article_authors(F.col("xml"))).first()[0] == ["G S"]


def test_posts(spark):
    df = spark.createDataFrame([("1", "@a hi https://t.co/1 https://t.co/2", None, None, False, False, 1, 1, [("https://t.co/1", "https://long.example/x")], ["m"], ["x", "x"])], feeds.POST)
    r = feeds.posts(df).first()
    assert (r["text"], r["is_reply"], r["is_repost"], r["has_media"], r["categories"]) == ("@a hi https://long.example/x", True, False, True, ["x"])


def test_labels(spark):
    items = spark.createDataFrame([("https://a.example/videos/1", "s", ["AI"], None), ("https://a.example/2", "s", ["Science"], "sec")], "link string, source_id string, categories array<string>, section string")
    sources = spark.createDataFrame([("s", "Source", "US", "tech", "Science", None)], "id string, name string, region string, focus string, cat string, content_type string")
    rows = {r["link"]: r for r in feeds.labelled(items, sources).collect()}
    assert rows["https://a.example/videos/1"]["categories"] == ["AI", "Science"] and rows["https://a.example/videos/1"]["content_type"] == "video" and rows["https://a.example/videos/1"]["section"] == "AI"
    assert rows["https://a.example/2"]["categories"] == ["Science"] and rows["https://a.example/2"]["section"] == "sec"


def test_tables(spark, tmp_path):
    assert tables.json_table(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert tables.json_table(spark, str(tmp_path / "x.json"), "a int").collect()[0]["a"] == 1
    assert tables.parquet_table(spark, str(tmp_path / "none"), "a int, b int", ["a"]).columns == ["a"]
    c = spark.createDataFrame([("k", 0, ""), ("k", 1, "second"), ("k", 2, "third"), ("l", 0, None)], "k string, p int, v string")
    assert {r["k"]: r["v"] for r in tables.first_non_empty(c, "k", "p", "v").collect()} == {"k": "second", "l": None}
    assert tables.date_spine(spark, ["a", "b"], "2024-01-07").count() == 14
    topics = spark.createDataFrame([("t", ["q1", "q2"])], "topic string, queries array<string>")
    assert [(r["query"], r["sort"]) for r in tables.query_plan(topics, "topic", "queries", ["new", "cited"]).orderBy("ord").collect()] == [("q1", "new"), ("q1", "cited"), ("q2", "new"), ("q2", "cited")]
