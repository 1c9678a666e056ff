import math
import random

import pytest

from feedloom.llm import names


def plain_slips(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("limit", [1, 2])
def test_segment_join_loses_nothing(spark, limit):
    r = random.Random(limit)
    strings = {"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(120)}
    got = {(x["a"], x["b"]): x["slips"] for x in names.segment_join(spark.createDataFrame([(s,) for s in strings] + [(None,), ("",)], "s string"), "s", limit).collect()}
    want = {(a, b): plain_slips(a, b) for a in strings for b in strings if a < b and plain_slips(a, b) <= limit}
    assert got == want


def test_reading():
    assert [names.read_person(t) for t in ("Ann Marie Duval", "Duval, Ann M.", "DUVAL Ann", "A. M. Duval", "Duval AM", "AM Duval", "Dr. med. Ann Duval", "Ann M. Duval, PhD", "ann duval", "Jürgen van der Berg")] == [
        ("duval", "ann", False), ("duval", "ann", False), ("duval", "ann", False), ("duval", "a", True), ("duval", "am", True), ("duval", "am", True), ("duval", "ann", False), ("duval", "ann", False), ("duval", "ann", False), ("vanderberg", "jurgen", False),
    ]
    assert names.read_person("") == names.read_person(" ,. ") == ("", "", False)
    assert names.read_organisation("Applied Load Science, Annals of") == (["annals", "applied", "load", "science"], "")
    assert names.read_organisation("AALS (Annals of Applied Load Science)")[0] == ["annals", "applied", "load", "science"]
    assert names.read_organisation("Ann. Nord. Cogn., Ser. A [electronic]") == (["ann", "nord", "cogn"], "a")
    assert names.abbreviates("jnl", "journal") and names.abbreviates("hse", "house") and not names.abbreviates("arch", "annals")


def entities(df):
    return {r["name_id"]: r["entity"] for r in df.collect()}


def test_persons(spark):
    rows = ["Margaret Duvalier", "Peggy Duvalier", "Duvalier, Margaret", "M Duvalier", "Margaret Duvailer", "Duvalier, Robert", "Bob Duvalier", "R. Duvalier", "Robert Tamsen", "Margraet Duvalier", None, "", "—", "Duvalier, Robert"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "name_id bigint, typed_name string, entity string")
    e = entities(names.link_persons(df))
    assert len({e[i] for i in (0, 1, 2, 3, 4, 9)}) == 1 and len({e[i] for i in (5, 6, 7, 13)}) == 1
    assert len({e[0], e[5], e[8]}) == 3 and not {10, 11, 12} & set(e)


def test_short_family_names(spark):
    """Slips of short names are linked beside the same given name or initial; names that differ in truth are not."""
    rows = ["Li Chen", "Chen, Li", "L. Chen", "Li Chne", "Anna Wolf", "Wolf, Anna", "A. Wolf", "Wolf A", "Wofl, A.", "Anna Wulf", "Wei Chan", "Chan, Wei", "W. Chan", "Wei Chen", "Bo Wofl", "Xue, Li", "Xu, Li"]
    e = entities(names.link_persons(spark.createDataFrame(list(enumerate(rows)), "name_id bigint, typed_name string")))
    assert len({e[i] for i in (0, 1, 2, 3)}) == 1 and len({e[i] for i in (4, 5, 6, 7, 8)}) == 1
    assert len({e[i] for i in (10, 11, 12)}) == 1 and len({e[i] for i in (0, 4, 10, 13, 14, 15, 16)}) == 7


def test_umlauts_take_no_slip(spark):
    rows = ["Eva Böhm", "Eva Boehm", "BÖHM Eva", "Bohm, E.", "Eva Boemh", "Eva Bohme", "Jo\u0308rg Rüdt", "Joerg Ruedt"]
    e = entities(names.link_persons(spark.createDataFrame(list(enumerate(rows)), "name_id bigint, typed_name string")))
    assert len({e[i] for i in (0, 1, 2, 3, 4)}) == 1 and e[6] == e[7] != e[0]


def test_short_given_names(spark):
    rows = ["Bob Duvalier", "Duvalier, Bob", "Robert Duvalier", "Obb Duvalier", "Kim Duvalier", "Jim Duvalier", "Duvalier, Jim", "Jim D. Duvalier"]
    e = entities(names.link_persons(spark.createDataFrame(list(enumerate(rows)), "name_id bigint, typed_name string")))
    assert len({e[i] for i in (0, 1, 2, 3)}) == 1 and len({e[0], e[4], e[5]}) == 3


def test_short_words(spark):
    rows = ["Annals of Art History", "The Annals of Art History", "Art History, Annals of", "Annals of Atr History", "Annals of Nordic Science", "Annals of Nordic Society", "Ann. Nord. Sci.", "Ann. Nord. Soc.", "Oel Review", "Öl Review", "Ol Review"]
    e = entities(names.link_organisations(spark.createDataFrame([(i, "venue", t) for i, t in enumerate(rows)], "name_id bigint, kind string, typed_name string")))
    assert len({e[i] for i in (0, 1, 2, 3)}) == 1 and e[4] == e[6] != e[5] == e[7] and e[8] == e[9] == e[10]


def test_organisations(spark):
    rows = [("venue", t) for t in ("Annals of Load Science", "Ann. Load Sci.", "ANNALS OF LOAD SCIENCE", "Load Science, Annals of", "Anals of Load Science", "The Annals of Load Science (print)", "Annals of Load Science, Series A", "Archives of Load Science", None)]
    rows += [("publisher", "Annals of Load Science"), ("publisher", "Oakend House Ltd"), ("publisher", "House Oakend"), ("publisher", "Oakend Hse.")]
    e = entities(names.link_organisations(spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "name_id bigint, kind string, typed_name string")))
    assert len({e[i] for i in range(6)}) == 1 and len({e[0], e[6], e[7], e[9], e[10]}) == 5 and e[10] == e[11] == e[12]


def generated(seed, families=260):
    """(typed name, person): persons with given names and short forms that are in no list, typed in many ways."""
    r = random.Random(seed)
    letters = lambda n: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(n))
    formal = sorted({letters(4).title() for _ in range(40)})
    nick = {f: (f[2:4] + f[-2:]).title() for f in formal[::3]}  # another initial, letters of the formal name
    rows = []
    for k in range(families):
        family = letters(4).title() + r.choice("kmnrst")
        seen = set()
        for _ in range(r.choice((1, 1, 2, 3))):
            given = r.choice(formal)
            if given[0] in seen or nick.get(given, "Q")[0] in seen:
                continue
            seen |= {given[0], nick.get(given, given)[0]}
            person = (family, given)
            rows += [(f"{given} {family}", person), (f"{family}, {given}", person), (f"{given[0]}. {family}", person), (f"{family} {given[0]}{r.choice('ABC')}", person), (f"Dr. {given} {family}", person)]
            at = r.randrange(2, len(family) - 2)
            rows.append((f"{given} {family[:at]}{family[at + 1]}{family[at]}{family[at + 2:]}", person))
            at = r.randrange(2, len(given) - 2)
            rows.append((f"{given[:at]}{given[at + 1:]} {family}", person))
            if given in nick and r.random() < 0.8:
                rows.append((f"{nick[given]} {family}", person))
    return list(dict(rows).items()), set(nick.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision_on_names_of_no_list(spark, seed):
    rows, nick = generated(seed)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "name_id bigint, typed_name string")
    got = {(r[0], r[1]) for r in names.pairs(names.link_persons(df)).collect()}
    want = {(i, j) for i, (_, p) in enumerate(rows) for j, (_, q) in enumerate(rows) if i < j and p == q}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.99 * len(got)
    without = {(r[0], r[1]) for r in names.pairs(names.link_persons(df, learn=False)).collect()}
    assert len(without & want) < len(got & want)


def plain_short_forms(rows, least_share=0.5, least_evidence=10.0):
    """short_forms by every pair of names, all families counted."""
    family, held = {}, {}
    for f, g in rows:
        family.setdefault(f, set()).add(g)
        held.setdefault(g, set()).add(f)
    total, found = sum(map(len, family.values())), set()
    pieces = lambda g: {g[i : i + 2] for i in range(len(g) - 1)}
    for s in held:
        for g in held:
            if s[0] == g[0] or len(held[g]) <= len(held[s]) or not pieces(s) & pieces(g):
                continue
            chance = {f: min(1.0, max((len(family[f]) - 1) * len(held[g]) / (total - len(held[s])), len(held[g]) / len(family))) for f in held[s]}
            both, room = held[s] & held[g], sum(1 - chance[f] for f in held[s])
            share = sum(1 - chance[f] for f in both) / room if room else 0
            if share >= least_share and sum(max(0.0, math.log(share / chance[f])) for f in both) >= least_evidence:
                found.add((s, g))
    return found


def families_of(sizes, seed, everything=0):
    """(family, given) of families of so many formal names and most of their short forms, and the true (short, formal)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4))
    formal = sorted({word() for _ in range(80)})
    nick = {g: g[2:4] + g[-2:] for g in formal[::3] if g[2] != g[0]}
    rows = set()
    for i, size in enumerate(sizes):
        for g in r.sample(formal, size):
            rows |= {(f"family{i}", g)} | ({(f"family{i}", nick[g])} if g in nick and r.random() < 0.8 else set())
    rows |= {(f"everything{i}", g) for i in range(everything) for g in [*formal, *nick.values()]}
    return sorted(rows), {(short, g) for g, short in nick.items()}


@pytest.mark.parametrize("sizes, everything", [([20] * 200, 0), ([2] * 300, 0), ([2] * 300 + [14] * 60 + [40] * 10, 0), ([2] * 300, 40), ([1] * 300, 60), ([], 60)])
def test_short_forms_count_families_of_any_size(spark, sizes, everything):
    """Families of many given names are counted, by what they say; those that have every name teach nothing."""
    rows, true = families_of(sizes, 3, everything)
    got = {tuple(x) for x in names.short_forms(spark.createDataFrame(rows, "family string, given string")).collect()}
    assert got == plain_short_forms(rows) and got <= true
    if sizes and max(sizes) > 12:
        assert len(got) > 0.9 * len(true)


def test_short_form_in_families_of_many_given_names(spark):
    """Every family has more than a dozen given names; a short form that is in no list still means its formal name."""
    many = [(a + b).title() for a in "bdfgklmnpst" for b in ("avel", "erik", "omon", "ulin")]
    family = [f"Ostervald{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}" for i in range(60)]
    typed = [f"{g} {family[i]}" for i in range(60) for g in random.Random(i).sample(many, 16)]
    typed += [f"Torvin {family[i]}" for i in range(13)] + [f"Qetorvin {family[i]}" for i in range(12)]
    e = entities(names.link_persons(spark.createDataFrame(list(enumerate(typed)), "name_id bigint, typed_name string")))
    of = {t: e[k] for k, t in enumerate(typed)}
    assert all(of[f"Qetorvin {family[i]}"] == of[f"Torvin {family[i]}"] for i in range(12))


def test_families_one_letter_apart(spark):
    """Two families of several persons each are both names of their own, however alike; a slip of one is linked."""
    rows = [f"{g} {f}" for f in ("Hansen", "Jansen") for g in ("Anna", "Bert", "Clara", "A.", "B.", "C.", "Clara M.")] + ["Dirk Hansen", "Jansen, Dirk", "Anna Hasnen", "Bert Hansenn"]
    e = entities(names.link_persons(spark.createDataFrame(list(enumerate(rows)), "name_id bigint, typed_name string")))
    assert e[0] == e[3] == e[16] and e[1] == e[4] == e[17] and e[7] == e[10]
    assert len({e[0], e[1], e[2], e[7], e[8], e[9], e[14], e[15]}) == 8


def test_chains_of_slips(spark):
    """A slip of a slip of a slip leads to the name."""
    rows = ["Ann Duvalier", "Duvalier, Ann", "A Duvalier", "Ann D. Duvalier", "Ann Duvalierr", "Ann A. Duvalierr", "A. Duvalierr", "Ann Duvallierr", "A. Duvallierr", "Ann Duvalllierr"]
    e = entities(names.link_persons(spark.createDataFrame(list(enumerate(rows)), "name_id bigint, typed_name string")))
    assert len(set(e.values())) == 1


def test_empty(spark):
    assert names.pairs(names.link_persons(spark.createDataFrame([], "name_id bigint, typed_name string"))).count() == 0
    assert names.pairs(names.link_organisations(spark.createDataFrame([], "name_id bigint, kind string, typed_name string"))).count() == 0
