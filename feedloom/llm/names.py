"""Variant spellings of names typed by people.

Strings are linked by a pigeonhole segment join: a string is cut into k + 1 segments; if another is within k edits, one
of its substrings equals one of the segments, shifted by at most k places. Segments form an inverted index that substrings
are looked up in, by an equi-join; letters that differ by too many are dropped by a bit count, and what is left is
verified by a banded edit distance in which a swap of neighbours is one slip.

For persons the joined strings are family names and given names, for organisations the words of their names. A person is a
family name with the initial of the formal given name; an organisation is its sequence of full words, to which
abbreviations are resolved; the order of the words, which inversions change, does not count.

Everything is joined by key. A family name, word or segment that very many rows share is an ordinary hot key of an
equi-join whose skewed partitions are split at run time; nothing is collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.runtime import stage

# --- strings within a few slips ------------------------------------------------------------------------------------------


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 segments of a string, as even as possible."""
    base, extra = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = base + (i >= k + 1 - extra)
        out.append((at, n))
        at += n
    return out


def slips(a: str, b: str, limit: int) -> int:
    """Edits from a to b, a swap of neighbours counting one; limit + 1 if there are more than limit. Banded."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    big = limit + 1
    before: list[int] = []
    row = [j if j <= limit else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [big] * (len(b) + 1)
        if i <= limit:
            new[0] = i
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            y = b[j - 1]
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new[j] = v
        if min(new) > limit:
            return big
        before, row = row, new
    return min(row[-1], big)


def _mask(s: str) -> int:
    m = 0
    for ch in s:
        m |= 1 << (ord(ch) % 61)
    return m


def segment_join(strings: DataFrame, column: str, limit: int = 1) -> DataFrame:
    """(a, b, slips), a < b: the distinct strings at most `limit` slips apart. Null and empty strings are left out."""
    k = 2 * limit  # a swap is two plain edits

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf[column]:
                m = _mask(s)
                for i, (at, n) in enumerate(segments(len(s), k)):
                    rows.append((s, m, True, f"{len(s)}:{i}:{s[at : at + n]}"))
                for length in range(max(1, len(s) - limit), len(s) + limit + 1):
                    found = set()
                    for i, (at, n) in enumerate(segments(length, k)):
                        for p in range(max(0, at - k), min(len(s) - n, at + k) + 1):
                            found.add(f"{length}:{i}:{s[p : p + n]}")
                    rows += [(s, m, False, key) for key in found]
            yield pd.DataFrame(rows, columns=["s", "m", "indexed", "key"])

    distinct = strings.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    all_keys = distinct.mapInPandas(keys, "s string, m bigint, indexed boolean, key string")
    index = all_keys.filter("indexed").select(F.col("s").alias("a"), F.col("m").alias("ma"), "key")
    probe = all_keys.filter("not indexed").select(F.col("s").alias("b"), F.col("m").alias("mb"), "key")
    candidates = (
        index.join(probe, "key").filter(F.col("a") != F.col("b")).filter(F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2 * limit)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    verify = F.pandas_udf(_slips_of(limit), "int")
    return candidates.withColumn("slips", verify("a", "b")).filter(F.col("slips") <= limit)


def _slips_of(limit: int):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([slips(x, y, limit) for x, y in zip(a, b)], dtype="int32")

    return run


# --- reading names -------------------------------------------------------------------------------------------------------

#: What precedes or follows a person's name.
TITLES = frozenset("dr prof professor med mr mrs ms miss mx sir dame dipl ing herr frau mme".split())
DEGREES = frozenset("phd dphil msc bsc md ma ba mba mph mphil dsc dds rn jr sr ii iii iv".split())
PARTICLES = frozenset("van von de der den del della di da dos du la le al el bin ten ter zu".split())

#: Letters that Unicode does not decompose, and their plain spelling.
LETTERS = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ð": "d", "þ": "th", "ł": "l", "đ": "d", "ı": "i"})

#: Short forms of given names that are in common use, as a start; what a table itself shows is learned (`short_forms`).
COMMON_SHORT_FORMS = {
    "alexander": "sasha alex sandy xander", "alexandra": "sasha alex sandra", "aleksandra": "sasha alex ola", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny",
    "catherine": "kate cathy kitty", "charles": "charlie chuck", "charlotte": "lottie charlie lotte", "christopher": "chris kit", "daniel": "dan danny", "david": "dave",
    "deborah": "deb debbie", "dmitri": "dima mitya", "dorothea": "thea dora", "dorothy": "dot dottie dolly", "edward": "ned ted ed eddie teddy", "elisabeth": "liz betty lisa beth elsa",
    "elizabeth": "liz betty lisa beth eliza lizzie", "francisco": "paco pancho kiko", "frederick": "fred freddie", "gabriela": "gabi gaby", "gregory": "greg", "helene": "lena",
    "henry": "harry hank hal", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon",
    "joseph": "joe joey", "katharina": "kathi katja kati", "katherine": "kathy kate katie kit", "lawrence": "larry", "leonard": "leo len lenny", "margaret": "peggy maggie meg greta",
    "matthew": "matt", "michael": "mike mick", "nicholas": "nick nico", "nikolaus": "niko klaus", "olivia": "liv livvy ollie", "patricia": "pat trish patty tricia", "patrick": "pat paddy", "peter": "pete",
    "philip": "phil", "rebecca": "becky", "richard": "dick rick rich", "robert": "bob rob bobby robbie bert", "ronald": "ron", "samantha": "sam", "samuel": "sam", "stephen": "steve",
    "susan": "sue susie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori", "william": "bill will billy willy liam",
}
#: Letters that may be written with an e instead.
UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ø": "oe", "Ä": "AE", "Ö": "OE", "Ü": "UE", "Ø": "OE"})

#: In pairs with a string of fewer letters, one slip is weak evidence; see `_weak`.
SHORT_FAMILY, SHORT_GIVEN, SHORT_WORD, SHORT_RATIO = 5, 4, 4, 4.0

def folded(text: str) -> str:
    """Lower case, without accents. An umlaut written with an e is another string; `respelled` tells which."""
    t = unicodedata.normalize("NFKC", text).lower().translate(LETTERS)
    return "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))


def respelled(typed: str) -> str | None:
    """The text with its umlauts written with an e; None if it has none."""
    t = unicodedata.normalize("NFKC", typed)
    e = t.translate(UMLAUTS)
    return e if e != t else None


def without_e(s: str) -> str:
    return re.sub("([aou])e", r"\1", s)


def read_person(typed: str) -> tuple[str, str, bool]:
    """(family, given or initials, are they initials), folded; ('', '', False) if there is no family name."""
    t = " ".join(unicodedata.normalize("NFKC", typed).replace("…", " ").split()).strip(" ,;")
    parts = [p.split() for p in t.split(",")]
    bare = lambda w: w.replace(".", "").lower()
    while len(parts) > 1 and all(bare(w) in DEGREES for w in parts[-1]) and (len(parts) > 2 or len(parts[0]) > 1):
        parts.pop()
    while parts[0] and bare(parts[0][0]) in TITLES and (len(parts[0]) > 1 or len(parts) > 1):
        parts[0].pop(0)
    if len(parts) > 1:
        family, given = parts[0], [w for p in parts[1:] for w in p if bare(w) not in TITLES]
    else:
        ws = parts[0]
        while len(ws) > 2 and bare(ws[-1]) in DEGREES and (len(ws) > 3 or len(bare(ws[0])) > 3 or bare(ws[-1]) not in ("ma", "md", "ba")):
            ws.pop()
        initials = lambda w: w.isupper() and len(w.replace(".", "")) <= 3 and ("." in w or len(w) <= 3)
        if len(ws) < 2:
            family, given = ws, []
        elif initials(ws[-1]) and len(bare(ws[-1])) <= 3 and not all(map(initials, ws[:-1])):
            at = len(ws) - 1
            while at > 1 and initials(ws[at - 1]):
                at -= 1
            family, given = ws[:at], ws[at:]
        elif ws[0].isupper() and len(ws[0]) > 3 and not any(w.isupper() and len(w) > 3 for w in ws[1:]):
            family, given = ws[:1], ws[1:]
        else:
            at = len(ws) - 1
            while at > 1 and bare(ws[at - 1]) in PARTICLES:
                at -= 1
            family, given = ws[at:], ws[:at]
    family_key = re.sub(r"[^a-z0-9]", "", folded(" ".join(family)))
    if not family_key:
        return "", "", False
    if not given:
        return family_key, "", True
    first = given[0]
    letters = re.sub(r"[^\w]", "", first)
    short = len(letters) <= 1 or "." in first and len(letters) <= 3 or first.isupper() and len(letters) <= 3
    return family_key, re.sub(r"[^a-z]", "", folded(letters)), short


def _person_reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, typed in zip(pdf["name_id"].to_numpy(), pdf["typed_name"]):
            family, given, short = read_person(typed or "")
            if family:
                e = respelled(typed)
                with_e = read_person(e)[0] if e else family
                rows.append((i, family, given, short, with_e if with_e != family and without_e(with_e) == without_e(family) else None))
        yield pd.DataFrame(rows, columns=["name_id", "family", "given", "short", "with_e"])


def _pieces(name: str) -> Column:
    """Every two neighbouring letters of a column, once."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(F.col(name), i, F.lit(2))))


def short_forms(givens: DataFrame, *, least_share: float = 0.5, least_evidence: float = 10.0) -> DataFrame:
    """(short, formal) of given names with different initials, learned from (family, given).

    If one name is a short form of another, one person bears both: of the families that have the short form, far more have
    the formal name too than by chance. Counted are all families, by how much they say: beside the short form, one of k
    given names has the formal name by chance with (k - 1) * formal_n / (total - short_n), 1 at most and no less than any
    family, where total counts the given names of all families, formal_n and short_n the families of each; so one that has
    them all says nothing. Pairs of
    names share two neighbouring letters. least_share of the short form's families must have both, each counting with
    1 - chance, and the sum of the logarithms of how much more often than by chance that is must reach least_evidence. The
    rarer name is the short form.
    """
    distinct = givens.select("family", "given").distinct()
    sized = stage(distinct.join(distinct.groupBy("family").agg(F.count(F.lit(1)).alias("k")), "family"), "givens-by-family")
    total, families = (max(1, n) for n in sized.agg(F.count(F.lit(1)), F.countDistinct("family")).first())
    over = lambda sizes, value: F.aggregate(sizes, F.lit(0.0), lambda so_far, x: so_far + x["c"] * value(x["k"]))
    held = sized.groupBy("given", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("given").agg(F.sum("c").alias("n"), F.collect_list(F.struct("k", "c")).alias("sizes"))
    # No pair reaches more evidence than either name if all its families had both, and by a chance no greater than this.
    most = over(F.filter("sizes", lambda x: x["k"] > 1), lambda k: F.greatest(F.lit(0.0), F.log(F.lit(float(total)) / ((k - 1) * F.col("n")))))
    held = stage(held.filter(most >= least_evidence), "telling-givens")
    lettered = sized.join(held.select("given", "n"), "given").filter(F.length("given") > 1).withColumn("two", F.explode(_pieces("given")))
    x = lettered.select("family", "k", "two", F.col("given").alias("short"), F.col("n").alias("short_n"))
    y = lettered.select("family", "two", F.col("given").alias("formal"), F.col("n").alias("formal_n"))
    both = (
        x.join(y, ["family", "two"]).filter((F.col("formal_n") > F.col("short_n")) & (F.substring("short", 1, 1) != F.substring("formal", 1, 1)))
        .filter((F.col("k") - 1) * F.col("formal_n") < total - F.col("short_n"))
    )
    counted = (
        both.groupBy("short", "formal", "short_n", "formal_n", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("short", "formal", "short_n", "formal_n").agg(F.collect_list(F.struct("k", "c")).alias("both"))
        .join(held.select(F.col("given").alias("short"), "sizes"), "short")
    )
    chance = lambda k: F.least(F.lit(1.0), F.greatest((k - 1) * F.col("formal_n") / (total - F.col("short_n")), F.col("formal_n") / families))
    times = F.size(F.array_intersect(_pieces("short"), _pieces("formal")))  # a family counts once for each two letters
    counted = counted.withColumn("times", times).withColumn("share", over("both", lambda k: 1 - chance(k)) / F.col("times") / over("sizes", lambda k: 1 - chance(k)))
    evidence = over("both", lambda k: F.greatest(F.lit(0.0), F.log(F.col("share") / chance(k)))) / F.col("times")
    return counted.filter((F.col("share") >= least_share) & (evidence >= least_evidence)).select("short", "formal")


def _both_ways(near: DataFrame) -> DataFrame:
    """(s, other) of pairs (a, b)."""
    return near.select(F.col("a").alias("s"), F.col("b").alias("other")).union(near.select("b", "a"))


def _long(near: DataFrame, letters: int) -> DataFrame:
    return near.filter((F.length("a") >= letters) & (F.length("b") >= letters))


def _weak_pairs(near: DataFrame, letters: int) -> DataFrame:
    """(s, other, swapped) of the pairs of which a string has fewer than `letters` letters; swapped: only letters' order differs."""
    letters_of = lambda c: F.array_sort(F.split(c, ""))
    return _both_ways(near.filter((F.length("a") < letters) | (F.length("b") < letters))).withColumn("swapped", letters_of("s") == letters_of("other"))


def _weak(strings: DataFrame, both: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(s, other, other_n, swapped) of weak pairs: what a string may be a slip of.

    Short strings differ by one letter in truth as well, so `other` must be SHORT_RATIO times as common, or `ratio` times if
    only two neighbours are swapped, which hardly makes another name; and the caller must find both beside the same.
    """
    counted = strings.select(F.col("s").alias("other"), F.col("n").alias("other_n"))
    later = F.struct("other_n", "other") > F.struct(F.col("n").alias("other_n"), F.col("s").alias("other"))
    common = F.when(F.col("swapped"), (F.col("other_n") >= ratio * F.col("n")) & later).otherwise(F.col("other_n") >= SHORT_RATIO * F.col("n"))
    return both.join(strings, "s").join(counted, "other").filter(common).select("s", "other", "other_n", "swapped")


def _short_families(persons: DataFrame, both: DataFrame) -> DataFrame:
    """(s, initial, of): the family that a short one is a slip of in the names with that initial.

    A family name with an initial is one person, so both must have the initial, and a given name in common unless one of
    them has initials only.
    """
    families = persons.groupBy(F.col("family").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    said = persons.withColumn("formal", F.explode("formal")).withColumn("initial", F.substring("formal", 1, 1))
    people = said.groupBy(F.col("family").alias("s"), "initial").agg(
        F.countDistinct("name_id").alias("n"), F.collect_set(F.when(~F.col("short") & (F.col("given") != ""), F.col("formal"))).alias("givens")
    )
    others = people.select(F.col("s").alias("other"), "initial", F.col("n").alias("person_n"), F.col("givens").alias("other_givens"))
    same = F.arrays_overlap("givens", "other_givens")
    unnamed = (F.size("givens") == 0) | (F.size("other_givens") == 0)
    much = F.col("person_n") >= SHORT_RATIO * F.col("n")
    linked = (
        _weak(families, both).join(people, "s").join(others, ["other", "initial"])
        .filter((same | unnamed) & (F.col("swapped") | much))
    )
    return _followed(linked.groupBy("s", "initial").agg(F.max_by("other", F.struct("other_n", "other")).alias("of")))


def _slipped_people(families: DataFrame, people: DataFrame, near: DataFrame) -> DataFrame:
    """(s, initial, of): the family that a long one is a slip of in the names with that initial: the commonest that may be.

    Both must have the initial, and a family of more than two persons is a name of its own unless the other is SHORT_RATIO
    times as common.
    """
    counted = families.join(people.groupBy("s").agg(F.count(F.lit(1)).alias("persons")), "s")
    others = families.select(F.col("s").alias("other"), F.col("n").alias("other_n"))
    later = F.struct("other_n", "other") > F.struct(F.col("n").alias("other_n"), F.col("s").alias("other"))
    may = _both_ways(near).join(counted, "s").join(others, "other").filter(later & ((F.col("persons") <= 2) | (F.col("other_n") >= SHORT_RATIO * F.col("n"))))
    beside = may.join(people.select("s", "initial"), "s").join(people.select(F.col("s").alias("other"), "initial"), ["other", "initial"])
    return beside.groupBy("s", "initial").agg(F.max_by("other", F.struct("other_n", "other")).alias("of"))


def _followed(of: DataFrame) -> DataFrame:
    """(s, initial, of) with every `of` replaced by where it leads in the end. Each `of` is more common, so there is no circle."""
    while True:
        of = stage(of, "slips")
        further = of.select(F.col("s").alias("of"), "initial", F.col("of").alias("further"))
        if of.join(further, ["of", "initial"], "left_semi").isEmpty():
            return of
        of = of.join(further, ["of", "initial"], "left").select("s", "initial", F.coalesce("further", "of").alias("of"))


def _moved(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows with `root` replaced, for those of which an initial has another family in (s, initial, of)."""
    initials = rows.select("name_id", "root", F.explode("formal").alias("formal")).withColumn("initial", F.substring("formal", 1, 1))
    to = initials.join(of.withColumnRenamed("s", "root"), ["root", "initial"]).groupBy("name_id", "root").agg(F.max("of").alias("of"))
    return rows.join(to, ["name_id", "root"], "left").withColumn("root", F.coalesce("of", "root")).drop("of")


def _people(rows: DataFrame) -> DataFrame:
    """(s, initial): the persons of each family."""
    return rows.select(F.col("root").alias("s"), F.explode("formal").alias("formal")).select("s", F.substring("formal", 1, 1).alias("initial")).distinct()


def _attached(strings: DataFrame, near: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(s, of): each string with the commonest string it may be a slip of: at least `ratio` times as common, ties by the string."""
    counted = strings.select(F.col("s").alias("other"), F.col("n").alias("other_n"))
    linked = _both_ways(near).join(strings, "s").join(counted, "other").filter(
        (F.col("other_n") >= ratio * F.col("n")) & (F.struct("other_n", "other") > F.struct(F.col("n").alias("other_n"), F.col("s").alias("other")))
    )
    return linked.groupBy("s").agg(F.max_by("other", F.struct("other_n", "other")).alias("of"))


def link_persons(names: DataFrame, nicknames: Mapping[str, str] = COMMON_SHORT_FORMS, learn: bool = True) -> DataFrame:
    """(name_id, entity) of names (name_id, typed_name): names of one entity mean one person.

    nicknames: formal given names and their short forms, parted by blanks; with `learn`, those that the names show are added.
    Null and empty names, and those without letters, are left out. Repeated rows count once; other columns are ignored.
    """
    read = stage(
        names.select(F.col("name_id").cast("bigint").alias("name_id"), F.col("typed_name").cast("string").alias("typed_name")).distinct()
        .filter("name_id is not null and typed_name is not null")
        .mapInPandas(_person_reader, "name_id bigint, family string, given string, short boolean, with_e string"), "persons",
    )
    listed = names.sparkSession.createDataFrame([(s, f) for f, short in nicknames.items() for s in short.split()], "short string, formal string")
    nick = listed.union(short_forms(read.filter("not short and given <> ''"))) if learn else listed
    formals = stage(nick.groupBy(F.col("short").alias("given")).agg(F.collect_set("formal").alias("formals")), "short-forms")  # a few each
    none = F.array().cast("array<string>")
    full_name = F.array_distinct(F.concat(F.array("given"), F.coalesce("formals", none)))
    read = read.join(formals, "given", "left").withColumn("formal", F.when(F.col("short"), F.array(F.substring("given", 1, 1))).otherwise(full_name)).drop("formals")
    read = stage(read, "persons-read")
    # A family that somebody types with an umlaut is the same with an e, which takes no slip; both count together.
    plain = stage(read.filter("with_e is not null").groupBy(F.col("with_e").alias("family")).agg(F.min("family").alias("plain")), "umlauts")
    families = read.groupBy("family").agg(F.count(F.lit(1)).alias("n")).join(plain, "family", "left").withColumn("plain", F.coalesce("plain", "family"))
    families = stage(families.select(F.col("family").alias("s"), F.sum("n").over(Window.partitionBy("plain")).alias("n")), "families")
    near = stage(segment_join(families, "s", 1), "near-families")
    rows = read.drop("with_e").withColumn("root", F.col("family"))
    slipped = _followed(_slipped_people(families, _people(rows), _long(near, SHORT_FAMILY)))
    rooted = (
        _moved(rows, slipped).join(plain.withColumnRenamed("family", "root"), "root", "left").withColumn("root", F.coalesce("plain", "root")).drop("plain")
    )
    rooted = stage(rooted, "rooted")
    persons = rooted.select("name_id", F.col("root").alias("family"), "given", "short", "formal")
    both = _weak_pairs(near, SHORT_FAMILY)
    for c in ("s", "other"):
        both = both.join(plain.withColumnRenamed("family", c), c, "left").withColumn(c, F.coalesce("plain", c)).drop("plain")
    short = _short_families(persons, both.filter("s <> other").groupBy("s", "other").agg(F.max("swapped").alias("swapped")))
    rows = _moved(rooted, short)
    rows = stage(rows, "person-rows")
    # Given names as they occur in each family; slips are resolved to the commonest close name of the family.
    full = stage(rows.filter("not short and given <> ''").groupBy("root", "given").agg(F.count(F.lit(1)).alias("n")), "givens")
    pairs = stage(segment_join(full, "given", 1), "near-givens")
    # Of short ones, a listed name is none, and the close name must be much commoner over all families too.
    everywhere = full.groupBy(F.col("given").alias("s")).agg(F.sum("n").alias("n"))
    known = formals.select(F.col("given").alias("s")).union(nick.select(F.col("formal").alias("s"))).distinct()
    weak = _weak(everywhere, _weak_pairs(pairs, SHORT_GIVEN)).join(known, "s", "left_anti")
    both = (
        _both_ways(_long(pairs, SHORT_GIVEN)).withColumn("least", F.lit(1.0))
        .union(weak.select("s", "other", F.when(F.col("swapped"), 1.0).otherwise(SHORT_RATIO))).withColumnRenamed("s", "given")
    )
    other = full.select("root", F.col("given").alias("other"), F.col("n").alias("other_n"))
    close = full.join(both, "given").join(other, ["root", "other"]).filter("other_n > n and other_n >= least * n")
    fixed = close.groupBy("root", "given").agg(F.max_by("other", F.struct("other_n", "other")).alias("fixed"))
    # Every given name's possible formal names; one that occurs in the family is it, else one whose initial does.
    options = full.join(fixed, ["root", "given"], "left").withColumn("said", F.coalesce("fixed", "given"))
    said = options.join(formals.withColumnRenamed("given", "said"), "said", "left")
    options = said.select("root", "given", "said", F.explode(F.array_distinct(F.concat(F.array("said"), F.coalesce("formals", none)))).alias("formal"))
    present = full.select("root", F.col("given").alias("formal"), F.col("n").alias("present_n"))
    initials = rows.filter("short and given <> ''").groupBy("root", F.substring("given", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("initial_n"))
    weighed = (
        options.withColumn("initial", F.substring("formal", 1, 1))
        .join(present, ["root", "formal"], "left").join(initials, ["root", "initial"], "left").fillna(0, ["present_n", "initial_n"])
    )
    has_formal = F.max(F.col("formal") != F.col("said")).over(Window.partitionBy("root", "given"))
    # A short form stands for a formal name that is there; being there itself says nothing.
    weighed = weighed.withColumn("is_formal", F.when(has_formal, F.col("formal") != F.col("said")).otherwise(True)).withColumn(
        "here", F.when(F.col("is_formal"), F.col("present_n")).otherwise(0)
    )
    chosen = weighed.groupBy("root", "given").agg(F.max_by("initial", F.struct("here", "initial_n", "is_formal", "formal")).alias("initial"))
    of_full = rows.filter("not short and given <> ''").join(chosen, ["root", "given"])
    of_short = rows.filter("short and given <> ''").withColumn("initial", F.substring("given", 1, 1))
    alone = rows.filter("given = ''").withColumn("initial", F.lit(""))
    key = F.concat_ws("|", F.lit("person"), "root", "initial").alias("entity")
    return of_full.select("name_id", key).union(of_short.select("name_id", key)).union(alone.select("name_id", key))


# --- organisations -------------------------------------------------------------------------------------------------------

#: Words that say nothing about which organisation it is.
FILLERS = frozenset("of the in on and for a an und der die das für et de la le des y".split())
LEGAL = frozenset("ltd limited inc llc plc gmbh ag bv co corp sa sarl verlag".split())
QUALIFIER = re.compile(r"[\[(]\s*(?:online|print|electronic|internet|web|e-?only|cd-?rom|online ed(?:ition)?|print ed(?:ition)?)\.?\s*[\])]", re.I)


def read_organisation(typed: str) -> tuple[list[str], str]:
    """(words in their natural order, series); no words if there are none."""
    t = " ".join(unicodedata.normalize("NFKC", typed).split())
    t = QUALIFIER.sub(" ", t).strip()
    m = re.fullmatch(r"([A-Z][A-Z0-9&.]{1,11})\s*\((.+)\)", t) or re.fullmatch(r"(.+?)\s*\(([A-Z][A-Z0-9&.]{1,11})\)", t)
    if m:
        t = max(m.groups(), key=len)
    t = folded(t)
    series = ""
    m = re.search(r"[,\s\-–:(]+ser(?:ies|\.)?\s*([a-z0-9]{1,3})\b\)?\.?", t)
    if m:
        series, t = m.group(1), (t[: m.start()] + t[m.end() :])
    m = re.fullmatch(r"(.+),\s*((?:the\s+)?[^,]+\s(?:of|on|in|for))\s*", t)
    if m:
        t = f"{m.group(2)} {m.group(1)}"
    ws = [w for w in re.findall(r"[a-z0-9]+", t) if w not in FILLERS]
    while len(ws) > 1 and ws[-1] in LEGAL:
        ws.pop()
    return ws, series


def abbreviates(short: str, word: str) -> bool:
    """Is it a beginning of the word, or its first letter and more of its letters up to the last (`jnl`)?"""
    if short == word or word.startswith(short):
        return True
    if len(short) < 2 or short[0] != word[0] or short[-1] != word[-1] or len(short) >= len(word):
        return False
    rest = iter(word)
    return all(ch in rest for ch in short)


def all_abbreviate(short: list[str], full: list[str]) -> bool:
    """Does each short word abbreviate another full one, in whatever order?"""
    if len(short) != len(full):
        return False
    left = list(full)
    for s in sorted(short, key=len, reverse=True):
        w = next((w for w in left if abbreviates(s, w)), None)
        if w is None:
            return False
        left.remove(w)
    return True


def _organisation_reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, kind, typed in zip(pdf["name_id"].to_numpy(), pdf["kind"], pdf["typed_name"]):
            ws, series = read_organisation(typed or "")
            if ws:
                e = respelled(typed)
                with_e = read_organisation(e)[0] if e else ws
                rows.append((i, kind or "", ws, series, with_e if [*map(without_e, with_e)] == [*map(without_e, ws)] else ws))
        yield pd.DataFrame(rows, columns=["name_id", "kind", "words", "series", "with_e"])


def _short_words(spelled: DataFrame, vocabulary: DataFrame, near: DataFrame) -> DataFrame:
    """(name_id, word, of): the word that a short one of a name is a slip of: another name has it beside the same other words.

    A beginning of a longer word is an abbreviation and no slip. A name's only word has nothing beside it, so only a swap
    counts there.
    """
    begun = vocabulary.filter(F.length("s") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("s") - 1, F.lit(SHORT_WORD))), lambda k: F.substring(F.col("s"), F.lit(1), k))).alias("s")).distinct()
    weak = stage(_weak(vocabulary, _weak_pairs(near, SHORT_WORD), 1.5).join(begun, "s", "left_anti"), "weak-words")
    wanted = weak.select("s").union(weak.select("other")).distinct().withColumnRenamed("s", "word")
    names = spelled.groupBy("name_id", "kind", "series").agg(F.array_sort(F.collect_list("word")).alias("words"))
    uses = stage(
        names.select("*", F.explode(F.array_distinct("words")).alias("word")).join(wanted, "word", "left_semi")
        .select("name_id", "kind", "series", "word", F.concat_ws(" ", F.array_remove("words", F.col("word"))).alias("rest")), "word-uses",
    )
    beside = ["kind", "series", "rest"]
    others = uses.select(*beside, F.col("word").alias("other")).distinct()
    return (
        uses.join(weak.withColumnRenamed("s", "word"), "word").filter(F.col("swapped") | (F.col("rest") != "")).join(others, [*beside, "other"])
        .groupBy("name_id", "word").agg(F.max_by("other", F.struct("other_n", "other")).alias("of"))
    )


def link_organisations(names: DataFrame) -> DataFrame:
    """(name_id, entity) of names (name_id, kind, typed_name): names of one entity mean one organisation of that kind.

    Null and empty names, and those without letters or digits, are left out; a null kind is a kind of its own.
    """
    read = stage(
        names.select(F.col("name_id").cast("bigint").alias("name_id"), F.col("kind").cast("string").alias("kind"), F.col("typed_name").cast("string").alias("typed_name"))
        .distinct().filter("name_id is not null and typed_name is not null")
        .mapInPandas(_organisation_reader, "name_id bigint, kind string, words array<string>, series string, with_e array<string>"), "organisations",
    )
    placed = read.select("name_id", "kind", "series", F.explode("words").alias("word"))
    vocabulary = stage(placed.groupBy(F.col("word").alias("s")).agg(F.count(F.lit(1)).alias("n")), "words")
    near = stage(segment_join(vocabulary, "s", 1), "near-words")
    slipped = _attached(vocabulary, _long(near, SHORT_WORD), 1.5).withColumnRenamed("s", "word")
    plain = (
        read.select(F.explode(F.arrays_zip("words", "with_e")).alias("x")).filter("x.words <> x.with_e")
        .groupBy(F.col("x.with_e").alias("word")).agg(F.min("x.words").alias("plain"))
    )
    spelled = stage(
        placed.join(slipped, "word", "left").withColumn("word", F.coalesce("of", "word")).drop("of")
        .join(plain, "word", "left").withColumn("word", F.coalesce("plain", "word")).drop("plain"), "spelled",
    )
    short = _short_words(spelled, vocabulary, near)
    whole = (
        spelled.join(short, ["name_id", "word"], "left").withColumn("word", F.coalesce("of", "word")).groupBy("name_id", "kind", "series")
        .agg(F.array_sort(F.collect_list("word")).alias("words"))
    )
    whole = stage(whole.withColumn("initials", F.concat_ws("", F.array_sort(F.transform("words", lambda w: F.substring(w, 1, 1))))), "organisation-words")
    # Distinct word sequences, and for each the longest one that it abbreviates.
    forms = whole.groupBy("kind", "series", "initials", "words").agg(F.count(F.lit(1)).alias("n"))
    size = F.length(F.concat_ws("", "words"))
    forms = stage(forms.withColumn("letters", size), "forms")
    keys = ["kind", "series", "initials"]
    longer = forms.select(*keys, F.col("words").alias("full"), F.col("letters").alias("full_letters"), F.col("n").alias("full_n"))

    def stands_for(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([all_abbreviate(list(x), list(y)) for x, y in zip(a, b)], dtype=bool)

    check = F.pandas_udf(stands_for, "boolean")
    resolved = (
        forms.join(longer, keys).filter("full_letters > letters").withColumn("ok", check("words", "full")).filter("ok")
        .groupBy(*keys, "words").agg(F.max_by("full", F.struct("full_letters", "full_n", F.concat_ws(" ", "full"))).alias("full"))
    )
    final = whole.join(resolved, [*keys, "words"], "left")
    return final.select("name_id", F.concat_ws("|", "kind", F.concat_ws(" ", F.coalesce("full", "words")), "series").alias("entity"))


def pairs(entities: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b), a < b, of the names of one entity. For callers that need every pair."""
    x, y = entities.alias("x"), entities.alias("y")
    both = x.join(y, F.col("x.entity") == F.col("y.entity")).filter(F.col("x.name_id") < F.col("y.name_id"))
    return both.select(F.col("x.name_id").alias("name_id_a"), F.col("y.name_id").alias("name_id_b")).distinct()
