import datetime as dt

from pyspark.sql import functions as F

from feedloom.functions import buckets, dates, hashing, scoring, text, urls


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if hasattr(v, "_jc") else F.lit(v)).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("r")).first()["r"]


def test_entities(spark):
    c = F.col("t")
    assert one(spark, text.decoded_entities(c), t="a &amp; b &#8217; &#x1F600; &zwnj;c &unknown; &AMP; &#55296;") == "a & b ’ 😀 c &unknown; & �"
    assert one(spark, text.decoded_entities(c, " "), t="x&unknown;y") == "x y"
    assert one(spark, text.decoded_entities(c), t=F.lit(None).cast("string")) == ""


def test_clean_and_clip(spark):
    c = F.col("t")
    assert one(spark, text.clean_text(c), t="<![CDATA[<p>One  two</p> Read full article here]]>") == "One two"
    assert one(spark, text.clean_text(c), t="Article URL: http://a Points: 12 # Comments: 3 rest") == "rest"
    assert one(spark, text.clipped(c, 10), t="hello wonderful world") == "hello…"
    assert one(spark, text.clipped(c, 10), t="hello") == "hello"
    assert one(spark, text.sanitized(c), t="a<script>x()</script><b>b</b> <!-- c --> d .") == "a b d."
    assert one(spark, text.redacted(c), t="mongodb+srv://u:p@host/x") == "mongodb+srv://[redacted]@host/x"


def test_keys(spark):
    c = F.col("t")
    assert one(spark, text.title_key(c), t="Évaluation — of  Things!") == "title:evaluation of things"
    assert one(spark, text.doi_key(c), t="https://doi.org/10.1000/ABC.1.") == "doi:10.1000/abc.1"
    assert one(spark, text.title_fingerprint(c), t="The new chip by Us: Fast, fast chip for all phones") == "all chip fast phones"
    assert one(spark, text.title_fingerprint(c), t="Too few") == ""
    assert one(spark, text.slug(c), t="Sleep & Rest!") == "sleep-rest"


def test_gates(spark):
    s, t = F.col("s"), F.col("t")
    good = "Researchers measured recovery in forty runners and found that longer sleep improved their training results."
    assert one(spark, text.is_summary_useful(s, t), s=good, t="Sleep and training") is True
    for bad in ("Short.", good[:-1] + "…", "Read more about how researchers measured recovery in forty runners during training season today.", good.replace(".", " x.")):
        assert one(spark, text.is_summary_useful(s, t), s=bad, t="Sleep") is False
    assert one(spark, text.is_summary_useful(s, t), s=good, t=good) is False
    summary = "Click here to win. " + good + " A second sentence adds more detail about the measured effect. Third one is left out of it."
    assert one(spark, text.extractive_summary(s, t), s=summary, t="Other words").startswith(good + " A second")
    assert one(spark, text.takeaways(s), s="One. Two! Three? Four. Five.") == ["One.", "Two!", "Three?", "Four."]
    assert one(spark, text.junk_title(t), t="SΔϕ") is True
    assert one(spark, text.stemmed(t), t="studies") == "study"


def test_formats(spark):
    c = F.col("n")
    assert [one(spark, text.compact_count(c), n=n) for n in (7, 1000, 1550, 2_000_000)] == ["7", "1K", "1.6K", "2M"]
    assert one(spark, text.wrapped(F.col("t"), 8, 2), t="one two three four") == ["one two", "three…"]
    assert one(spark, text.publication_info(F.col("t")), t="A B, C D - Journal of X, 2024 - host.example").asDict() == {"authors": "A B, C D", "venue": "Journal of X", "year": 2024, "host": "host.example"}
    spoken = lambda t: one(spark, text.speakable(F.col("t"), 60), t=t)
    assert spoken("Up 5% & more — see https://x.y/z") == "Up 5% & more, see" and spoken("As in [12], Lee et al. found it (10.1234/ab.c), e.g. $x^2$ vs. y…") == "As in, Lee and colleagues found it ( for example, versus. y"
    assert spoken("word " * 30) == ("word " * 12).strip() and spoken("— “Quoted”, text.") == '"Quoted", text.'
    assert [one(spark, text.usable_venue(F.col("t")), t=t) for t in ("of the Society", "Transactions on the", "Of", "Journal of X", None)] == ["", "Transactions", "", "Journal of X", ""]
    assert one(spark, text.chunks(F.col("a"), 2), a=[1, 2, 3]) == [[1, 2], [3]]
    assert one(spark, text.without_dangling(F.col("t")), t="Journal of the") == "Journal"
    assert one(spark, text.prettified(F.col("t"), {"iphone": "iPhone"}, ["ai"]), t="new-iphone-ai-2024-news") == "New iPhone AI News"
    then, now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2026-01-03 01:00:00").cast("timestamp_ntz")
    assert one(spark, text.time_ago(then, now)) == "2d"


def test_hashes(spark):
    def short(s):
        h = 5381
        for ch in s:
            h = ((h * 33) ^ ord(ch)) & 0xFFFFFFFF
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = digits[r] + out
        return out

    for s in ("https://a.example/x", "é😀"):
        assert one(spark, hashing.short_id(F.col("t")), t=s) == short(s)
    assert len(one(spark, hashing.alias_number(F.col("t")), t="abc")) == 4


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.content_type(u), u="https://a.b/Videos/x") == "video"
    assert one(spark, urls.content_type(u), u="https://a.b/x-videos-y") == "article"
    assert one(spark, urls.redacted_page(u), u="https://u:p@a.b/c?d#e") == "https://a.b/c"
    assert one(spark, urls.redacted_page(u), u="file:///x") == "/"
    assert one(spark, urls.form_encoded(u), u="a b~*") == "a+b%7E*"
    assert one(spark, urls.is_raster(u), u="https://a.b/x.svg?1") is False
    assert one(spark, urls.resolved(u, F.col("p")), u="/i.png", p="https://a.b/c/d") == "https://a.b/i.png"
    assert one(spark, urls.resolved(u, F.col("p")), u="i.png", p="https://a.b/c/d?e") == "https://a.b/c/i.png"
    assert one(spark, urls.is_allowed(u, ["a.b"], r"/x/\d+"), u="https://a.b/x/12") is True
    assert one(spark, urls.is_allowed(u, ["a.b"]), u="https://a.b:8443/x") is False


def test_dates(spark):
    d = F.col("d")
    assert one(spark, dates.strict_date(d), d="2024-02-30") is None
    assert one(spark, dates.strict_date(d), d="2024-02-29T10:00:00.5Z") == dt.datetime(2024, 2, 29, 10, 0, 0, 500000)
    assert one(spark, dates.strict_date(d), d="2024-02-29T10:00:00+01:00") is None
    assert one(spark, dates.feed_date(d), d="Tue, 02 Jan 2024 10:00:00 +0200") == dt.datetime(2024, 1, 2, 8)
    now = F.lit("2024-02-29 12:00:00").cast("timestamp_ntz")
    assert one(spark, dates.rolling_cutoff(now)) == dt.date(2022, 2, 28)
    assert one(spark, dates.in_rolling_window(d, now), d="2022-02-28") is True
    assert one(spark, dates.in_rolling_window(d, now), d="2022-02-27") is False
    assert one(spark, dates.in_rolling_window(d, now), d="2024-03-01") is False
    assert one(spark, dates.relative_instant(d, now), d="3 days ago") == dt.datetime(2024, 2, 26, 12)
    assert one(spark, dates.relative_instant(d, now), d="later") is None


def test_buckets(spark):
    c = F.col("n")
    assert [one(spark, buckets.duration_bucket(c), n=n) for n in (29.9, 30.0, 120.0, 600.0)] == ["under_30s", "30s_2m", "2m_5m", "10m_plus"]
    assert [one(spark, buckets.count_bucket(c), n=n) for n in (0, 3, 4, 11)] == ["0", "1_3", "4_10", "11_plus"]
    props = F.create_map(F.lit("a"), F.lit(" Some Value! "), F.lit("b"), F.lit("x"))
    assert one(spark, buckets.sanitized_event(F.lit("e"), props, {"e": ("a",)})) == {"a": "some_value"}
    assert one(spark, buckets.sanitized_event(F.lit("f"), props, {"e": ("a",)})) is None


def test_scores(spark):
    assert abs(sum(scoring.WEIGHTS.values()) - 1) < 1e-9
    v = lambda name: one(spark, scoring.venue_score(F.lit(name)))
    assert [v(n) for n in ("Nature", "arXiv preprint", "Nature Medicine", "Journal of Things", "MDPI Sensors", "", "Excellence in Cells")] == [1.0, 0.55, 0.85, 0.62, 0.38, 0.45, 0.45]
    words = dict(banter=("lol",), announce=("introducing",), tech=("model",), business=("funding",))
    s = one(spark, scoring.newsworthiness(F.lit("Introducing our new model, 40% faster than anything we had before; read all about it on the site today."), **words, urls=F.lit(1)))
    assert (s["score"], s["worthy"], s["category"]) == (86, True, "Product launch")
    assert one(spark, scoring.newsworthiness(F.lit("lol"), **words))["score"] == 0
    assert one(spark, scoring.newsworthiness(F.lit("Introducing"), **words, is_repost=F.lit(True)))["score"] == 0
