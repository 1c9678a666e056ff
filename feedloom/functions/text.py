"""Text as column expressions: cleaning, keys, tokens, gates and clipping. Null text behaves like empty text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- basics --------------------------------------------------------------------------------------------------------------


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c.cast("string") != "", F.lit(False))


def squashed(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text_of(c), r"\s+", " "))


def clipped(c: Column, n: int) -> Column:
    """At most n code points, cut before a partial word, with an ellipsis."""
    t = text_of(c)
    return F.when(F.length(t) > n, F.concat(F.regexp_replace(F.substring(t, 1, n), r"\s+\S*$", ""), F.lit("…"))).otherwise(t)


#: Named entities and their characters; invisible ones vanish.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”",
    "ldquo": "“", "ndash": "–", "mdash": "—", "trade": "™", "reg": "®", "copy": "©", "deg": "°", "zwnj": "", "zwj": "", "shy": "", "lrm": "", "rlm": "",
}


def _from_code(code: Column) -> Column:
    """The character of a code point; U+FFFD if there is none. Spark's chr() only knows 256 of them."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    hexed = F.lpad(F.hex(code), 8, "0")
    return F.when(valid, F.decode(F.unhex(hexed), "UTF-32")).otherwise(F.lit("�"))


def _by_part(c: Column, pattern: str, one) -> Column:
    """Replace every match by one(match)."""
    return F.array_join(
        F.transform(F.split(F.regexp_replace(c, f"({pattern})", "\u0001$1\u0001"), "\u0001"), lambda p: F.when(p.rlike(f"^(?:{pattern})$"), one(p)).otherwise(p)), ""
    )


def decoded_entities(c: Column, unknown: str | None = None) -> Column:
    """Decimal and hexadecimal entities, then named ones; an unknown name stays, or becomes `unknown`."""
    plain = text_of(c)
    t = _by_part(plain, r"&#[0-9]{1,7};", lambda p: _from_code(F.regexp_extract(p, "([0-9]+)", 1).try_cast("bigint")))
    t = _by_part(t, r"&#[xX][0-9a-fA-F]{1,6};", lambda p: _from_code(F.conv(F.regexp_extract(p, "[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("bigint")))
    table = F.create_map(*[x for k, v in ENTITIES.items() for x in (F.lit(k), F.lit(v))])
    t = _by_part(t, r"&[A-Za-z]{2,8};", lambda p: F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(p, "[A-Za-z]+", 0))), p if unknown is None else F.lit(unknown)))
    return F.when(plain.contains("&"), t).otherwise(plain)  # most texts hold none


def without_cdata(c: Column) -> Column:
    t = F.trim(text_of(c))
    return F.trim(F.when(t.rlike(r"(?s)^<!\[CDATA\[.*\]\]>$"), F.regexp_replace(t, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")).otherwise(t))


def clean_text(c: Column, limit: int = 320) -> Column:
    """Entities decoded, tags and boilerplate tails stripped, white space collapsed, clipped."""
    t = squashed(F.regexp_replace(decoded_entities(without_cdata(c)), r"<[^>]+>", ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?is)Read full article.*$", ""), r"(?i)Comments$", ""))
    t = F.regexp_replace(t, r"(?i)(^|[^A-Za-z0-9_])(?:Article|Comments) URL:\s*\S+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)(^|[^A-Za-z0-9_])Points:\s*\d+", "$1"), r"(?i)#\s*Comments:\s*\d+", "")
    return clipped(squashed(t), limit)


def sanitized(c: Column, limit: int = 4000) -> Column:
    """Unsafe elements with their content, comments, tags and control characters removed; cut hard at limit."""
    t = F.regexp_replace(text_of(c), r"(?is)<(script|style|iframe|object|embed|svg|math|form)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    t = F.regexp_replace(decoded_entities(t, " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.substring(F.regexp_replace(squashed(t), r"\s+([,.;:!?])", "$1"), 1, limit)


def redacted(c: Column) -> Column:
    """Credentials in connection addresses replaced."""
    return F.regexp_replace(text_of(c), r"([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1[redacted]@")


# --- folding and keys ----------------------------------------------------------------------------------------------------

#: Accented Latin letters and their base letters, for folding without a normalisation function.
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľńņňñòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžÀÁÂÃÄÅĀĂĄÇĆĈĊČĎÈÉÊËĒĔĖĘĚĜĞĠĢĤÌÍÎÏĨĪĬĮİĴĶĹĻĽŃŅŇÑÒÓÔÕÖŌŎŐŔŖŘŚŜŞŠŢŤÙÚÛÜŨŪŬŮŰŲŴÝŸŶŹŻŽ"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzzAAAAAAAAACCCCCDEEEEEEEEEGGGGHIIIIIIIIIJKLLLNNNNOOOOOOOORRRSSSSTTUUUUUUUUUUWYYYZZZ"


def folded(c: Column) -> Column:
    """Accents of Latin letters removed."""
    return F.translate(text_of(c), ACCENTED, PLAIN)


def alnum_words(c: Column) -> Column:
    """Lower-cased and folded, everything but letters, digits and blanks one blank."""
    return squashed(F.regexp_replace(F.lower(folded(c)), r"[^a-z0-9 ]+", " "))


def title_key(c: Column) -> Column:
    t = F.substring(alnum_words(c), 1, 90)
    return F.when(t != "", F.concat(F.lit("title:"), t))


def doi_key(*candidates: Column) -> Column:
    """The first non-empty candidate's DOI."""
    t = F.lower(F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates]))
    doi = F.regexp_replace(F.regexp_extract(t, r"(10\.\d{4,9}/[^\s\"'<>]+)", 1), r"[.,;]+$", "")
    return F.when(doi != "", F.concat(F.lit("doi:"), doi))


#: Words that a headline's fingerprint leaves out.
FINGERPRINT_STOP = ("the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "with", "at", "by", "is", "are", "this", "that", "its", "it", "as", "from", "how", "why", "what", "new", "report")


def title_fingerprint(c: Column) -> Column:
    """The first eight significant words in order of the alphabet; empty if there are less than three."""
    ws = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), r"[^a-z0-9\s]", " "), r"\s+", " ")), " ")
    ws = F.filter(ws, lambda w: (F.length(w) > 2) & ~w.isin(*FINGERPRINT_STOP))
    return F.when(F.size(ws) < 3, "").otherwise(F.array_join(F.slice(F.array_sort(F.array_distinct(ws)), 1, 8), " "))


def slug(c: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(folded(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, limit)


def prettified(c: Column, brands: dict[str, str], acronyms: Sequence[str]) -> Column:
    """A slug's words capitalised, brands and acronyms in their own spelling, numbers dropped."""
    named = F.create_map(*[x for k, v in brands.items() for x in (F.lit(k), F.lit(v))])
    word = lambda w: (
        F.when(w.rlike(r"^\d+$") | (w == ""), F.lit("")).when(F.try_element_at(named, w).isNotNull(), F.try_element_at(named, w))
        .when(w.isin(*acronyms), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    )
    whole = F.array_join(F.filter(F.transform(F.split(text_of(c), "-"), word), lambda w: w != ""), " ")
    return F.coalesce(F.try_element_at(named, text_of(c)), whole)


# --- phrases and lexicons --------------------------------------------------------------------------------------------------


def has_phrase(normalized: Column, phrases: Sequence[str]) -> Column:
    """Does one of the phrases occur as whole words? The text holds single blanks only."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    result = F.lit(False)
    for p in phrases:
        result = result | padded.contains(f" {p} ")
    return result


def has_any(haystack: Column, needles: Sequence[str]) -> Column:
    result = F.lit(False)
    for n in needles:
        result = result | haystack.contains(n)
    return result


def lexicon_hits(lowered: Column, terms: Sequence[str]) -> Column:
    """The terms found, in order: single words between other characters, terms with blanks or punctuation anywhere.

    Single words are looked up among the text's runs of letters, digits and dollar signs, read once, so a lexicon of hundreds
    costs no more passes than one of three.
    """
    import re

    words = [t for t in terms if re.fullmatch("[a-z0-9]+", t)]
    priced = [t for t in terms if t not in words and re.fullmatch("[a-z0-9$]+", t)]
    inside = F.regexp_extract_all(lowered, F.lit("([a-z0-9]+)"), 1)

    def one(found: Column) -> Column:
        parts = [
            F.when(F.array_contains(found, t) if t in words else lowered.rlike(f"(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)") if t in priced else lowered.contains(t), F.lit(t))
            for t in terms
        ]
        return F.array_compact(F.array(*parts))

    # Bound once by the lambda, else every term would read the text again.
    return F.get(F.transform(F.array(inside), one), 0) if terms else F.array().cast("array<string>")


def matches_topic(text: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    t = F.regexp_replace(F.lower(text_of(text)), r"\s+", " ")
    return has_any(t, include) & ~has_any(t, exclude)


# --- tokens and gates ------------------------------------------------------------------------------------------------------

#: Words that content tokens leave out.
STOP_WORDS = tuple(
    "a an and are as at be been being but by for from has have how in into is it its of on or that the their this to was were what when where which who why will with".split()
)
_WORD = r"([A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*)"


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(_WORD), 1)


def stemmed(w: Column) -> Column:
    n = F.length(w)
    cut = lambda k: w.substr(F.lit(1), n - k)
    return (
        F.when((n > 5) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 5) & w.endswith("ing"), cut(3)).when((n > 4) & w.endswith("ed"), cut(2))
        .when((n > 4) & w.endswith("es"), cut(2)).when((n > 3) & w.endswith("s"), cut(1)).otherwise(w)
    )


def content_tokens(c: Column) -> Column:
    """Distinct stems of the words that say something."""
    ws = F.transform(word_list(c), lambda w: F.regexp_replace(F.lower(w), r"['’]s$", ""))
    ws = F.transform(F.filter(ws, lambda w: ~w.isin(*STOP_WORDS)), stemmed)
    return F.array_distinct(F.filter(ws, lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def echoes_title(summary: Column, title: Column) -> Column:
    plain = lambda c: F.trim(F.regexp_replace(F.lower(text_of(c)), r"[^a-z0-9]+", " "))

    def similar(x: Column) -> Column:
        t, s = x["t"], x["s"]
        shared = F.size(F.array_intersect(t, s))
        close = (shared / F.greatest(F.size(t), F.lit(1)) >= 0.8) & ((jaccard(t, s) >= 0.78) | (F.size(s) - shared <= 1))
        return (F.size(t) >= 3) & (F.size(s) > 0) & close

    # Bound once by the lambda, else every use would read both texts again.
    both = F.array(F.struct(content_tokens(title).alias("t"), content_tokens(summary).alias("s")))
    return (plain(title) != "") & ((plain(summary) == plain(title)) | F.get(F.transform(both, lambda x: similar(x)), 0))


def is_complete(c: Column) -> Column:
    """Ends like a sentence: with a full stop and no ellipsis or single letter before it."""
    v = squashed(c)
    bare = F.regexp_replace(v, r"[\"'’”)\]]+$", "")
    return (v != "") & ~v.rlike(r"(\.\.\.|…)[\"'’”)\]]*$") & bare.rlike(r"[.!?]$") & ~bare.rlike(r"\s[a-z]\.$")


_B, _E = "(^|[^a-z0-9_])", "([^a-z0-9_]|$)"
#: Phrases of boilerplate and of promotion, which stand as whole words; and what else is noise: addresses, also
#: bare ones at the end, markup, and counters. Word boundaries are spelled out, so that other engines read them alike; all run
#: on lower-cased text in one line.
NOISE_PHRASES = (
    "read (more|the (full|original) article)", "continue reading", r"the post\b.*[^a-z0-9_]appeared first on", "click here", "subscribe", "sign up for (our|the) newsletter", "all rights reserved",
    "follow us (on|for)", "originally (appeared|published) (at|in|on)",
    "sponsored content", "sponsored post", "sponsored by", "sponsor message", "paid content", "paid post", "paid partnership", "advertorial", "advertisement", "affiliate links?", "buy now", "shop now",
    "order now", "free credits?", "use code", "promo code", "coupon code", "discount code", "limited[- ]time offer", "sign up now", "sign up today", "sign up for free", "subscribe now", "brought to you by",
    r"(claim|redeem) (your|the|these)?\s*(free|offer|discount|credits?)", "(sign|get) up (now|today|for free)", "try (it|this|[a-z0-9_]+) (for )?free", "get [0-9]+ (in )?free credits?",
)
#: The phrases share their first boundary, so a text's characters inside words are passed over at once.
NOISE = (
    r"https?://\S", r"www\.\S", r"</?[a-z][^>]*>", _B + "(" + "|".join(NOISE_PHRASES) + ")" + _E, _B + r"((article|comments) url\s*:|points\s*:\s*[0-9])",
    _B + r"[a-z0-9]([a-z0-9-]*[a-z0-9])?\.(com|org|net|io|ai|co|app|dev)([/?#]\S*)?[.!?,;:]?\s*$",
)
VAGUE = (
    "^(discover|explore|learn|find out|unlock|experience|reimagine|supercharge)" + _E,
    "^(this (article|post|story)|in this (article|post|story)|we (explore|explain|take a look))" + _E,
    _B + "((everything|all|what) you need to know|the future is here|game[- ]changer|one [a-z0-9_]+ at a time|worth (a look|checking out|reading))" + _E,
)


def is_noise(c: Column) -> Column:
    return F.lower(text_of(c)).rlike("|".join(f"(?:{p})" for p in NOISE))


def is_vague(c: Column) -> Column:
    return F.lower(text_of(c)).rlike("|".join(f"(?:{p})" for p in VAGUE))


def is_summary_useful(summary: Column, title: Column) -> Column:
    t = squashed(summary)
    enough = (F.length(t) >= 55) & (F.size(word_list(t)) >= 10) & (F.size(content_tokens(t)) >= 5)
    return enough & is_complete(t) & ~is_noise(t) & ~is_vague(t) & ~echoes_title(t, title)


_SENTENCE = r"([^.!?]*[.!?]+[\"'’”)\]]*)(?:\s+|$)"


def sentences(c: Column) -> Column:
    """Complete sentences: up to a full stop and its closers, before white space or the end."""
    return F.transform(F.regexp_extract_all(squashed(c), F.lit(_SENTENCE), 1), lambda s: F.trim(s))


def extractive_summary(summary: Column, title: Column, cap: Column | int = 300) -> Column:
    """The first two acceptable sentences within cap: long ones are skipped at first, and stop it later."""
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        ok = is_complete(s) & ~is_noise(s) & ~is_vague(s) & (F.size(word_list(s)) >= 5) & ~echoes_title(s, title)
        joined = F.when(acc["n"] == 0, s).otherwise(F.concat(acc["text"], F.lit(" "), s))
        fits = F.length(joined) <= cap
        return (
            F.when(acc["done"] | ~ok, acc)
            .when(fits, F.struct(joined.alias("text"), (acc["n"] + 1).alias("n"), (acc["n"] + 1 >= 2).alias("done")))
            .otherwise(F.struct(acc["text"].alias("text"), acc["n"].alias("n"), (acc["n"] > 0).alias("done")))
        )

    return F.aggregate(sentences(summary), start, step, lambda acc: acc["text"])


def lead_sentence(c: Column, least: int = 40) -> Column:
    """The first sentence of at least `least` code points; null if there is none."""
    return F.get(F.filter(sentences(c), lambda s: F.length(s) >= least), 0)


def takeaways(c: Column, n: int = 4) -> Column:
    """Up to n pieces that end in punctuation, else the whole text."""
    t = text_of(c)
    parts = F.slice(F.transform(F.regexp_extract_all(t, F.lit(r"([^.!?]+[.!?])"), 1), lambda x: F.trim(x)), 1, n)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(t))


def junk_title(c: Column) -> Column:
    """Too short, mostly not plain ASCII, or led by a symbol."""
    t = F.trim(text_of(c))
    return (F.length(t) < 14) | (F.length(F.regexp_replace(t, r"[^ -~]", "")) < 0.9 * F.length(t)) | t.rlike(r"^[^A-Za-z0-9\"'(]")


# --- small formats -----------------------------------------------------------------------------------------------------------


def compact_count(c: Column) -> Column:
    one = lambda x, u: F.concat(F.regexp_replace(F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10), r"\.0$", ""), F.lit(u))
    return F.when(c >= 1_000_000, one(c / 1_000_000, "M")).when(c >= 1000, one(c / 1000, "K")).otherwise(c.cast("string"))


def read_minutes(c: Column) -> Column:
    n = F.size(F.filter(F.split(squashed(c), " "), lambda w: w != ""))
    return F.least(F.lit(12), F.greatest(F.lit(2), F.floor(n / 60 + 0.5).cast("int")))


def time_ago(then: Column, now: Column) -> Column:
    m = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000)
    say = lambda n, u: F.concat(F.floor(n).cast("string"), F.lit(u))
    return F.when(m < 1, "now").when(m < 60, say(m, "m")).when(m < 1440, say(m / 60, "h")).when(m < 10080, say(m / 1440, "d")).otherwise(say(m / 10080, "w"))


def wrapped(c: Column, width: int, max_lines: int) -> Column:
    """Words folded into lines of at most `width`; what exceeds max_lines is dropped with an ellipsis."""
    ws = F.filter(F.split(squashed(c), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        fits = (F.length(longer) <= width) | (acc["line"] == "")
        return F.when(fits, F.struct(acc["lines"].alias("lines"), longer.alias("line"))).otherwise(F.struct(F.array_append(acc["lines"], acc["line"]).alias("lines"), w.alias("line")))

    lines = F.aggregate(ws, start, step, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"])))
    return F.transform(
        F.slice(lines, 1, max_lines), lambda line, i: F.when((i == max_lines - 1) & (F.size(lines) > max_lines), F.concat(line, F.lit("…"))).otherwise(line)
    )


def tag_text(xml: Column, tag: str) -> Column:
    """The text of the first element with this name; empty if there is none."""
    return F.regexp_extract(text_of(xml), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)


def publication_info(c: Column) -> Column:
    """struct(authors, venue, year, host) of "authors - venue, year - host"."""
    parts = F.split(text_of(c), r"\s+-\s+")
    n = F.size(parts)
    middle = F.when(n >= 3, F.get(parts, n - 2)).when(n == 2, F.get(parts, F.lit(1))).otherwise(F.lit(""))
    year = F.regexp_extract(middle, r"((?:19|20)\d{2})\s*$", 1)
    return F.struct(
        F.trim(F.get(parts, 0)).alias("authors"), F.trim(F.regexp_replace(middle, r",?\s*(?:19|20)\d{2}\s*$", "")).alias("venue"),
        F.nullif(year, F.lit("")).cast("int").alias("year"), F.when(n >= 3, F.trim(F.get(parts, n - 1))).otherwise("").alias("host"),
    )


#: What is replaced before text is read aloud, in this order.
SPOKEN = (
    (r"<[^>]+>", " "), (r"https?://\S+", " "), (r"\b10\.\d{4,9}/\S+", " "), (r"\$[^$]{1,120}\$", " "), (r"\\[a-zA-Z]+\{[^}]*\}", " "), (r"\[[^\]]{0,40}\]", " "), (r"[*_`#|]+", " "),
    (r"(?i)\bet al\.?", "and colleagues"), (r"(?i)\be\.g\.,?", "for example,"), (r"(?i)\bi\.e\.,?", "that is,"), (r"(?i)\bvs\.?\b", "versus"), ("[“”]", '"'), ("[‘’]", "'"),
    ("[\u2010\u2011\u2012\u2013\u2014]", "-"), (r"\s-\s", ", "), ("…", " "), (r"\s+", " "), (r"^\s+|\s+$", ""), (r"\s+([,.;:!?])", "$1"), (r"([.,;:!?])\1+", "$1"), (r",\s*([.!?])", "$1"),
    (r"^[^A-Za-z0-9\"']+", ""),
)


def speakable(c: Column, limit: int = 400) -> Column:
    """Text for reading aloud: links, markup and formulas dropped, abbreviations as words, cut before a partial word."""
    t = text_of(c)
    for pattern, by in SPOKEN:
        t = F.regexp_replace(t, pattern, by)
    return F.trim(F.when(F.length(t) > limit, F.regexp_replace(F.substring(t, 1, limit), r"\s+\S*$", "")).otherwise(t))


def without_dangling(c: Column) -> Column:
    """Prepositions and articles at the end dropped, as often as there are some."""
    return F.trim(F.regexp_replace(text_of(c), r"(?i)([\s,]+(of|on|in|for|and|the|to|at|with))+\s*$", ""))


def usable_venue(c: Column) -> Column:
    """A venue fit to be read out; empty if it begins in the middle of a phrase or nothing is left of it."""
    t = F.trim(text_of(c))
    rest = without_dangling(t)
    return F.when(t.rlike("^[a-z]") | (F.length(rest) < 3), "").otherwise(rest)


def chunks(values: Column, n: int) -> Column:
    """An array in groups of n, the last may be smaller."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i, n))
