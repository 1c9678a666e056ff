import random
import re
from collections import Counter

import pandas as pd

from feedloom.llm import spam
from feedloom.llm.words import WORD

GENUINE = "We followed forty runners for nine weeks and recorded their sleep. The coaches adjusted the load when the heart rate rose. No link between sleep and mood was found in this group."


def share(t):
    return spam.spam_share(t)[1]


def test_kinds():
    r = random.Random(1)
    words = ["yoga mat", "kettlebell", "foam roller", "jump rope", "weight vest"]
    shop = ["buy", "cheap", "best", "online", "sale"]
    pages = [
        " ".join(f"{r.choice(shop)} {r.choice(words)}" for _ in range(80)), "\n".join(f"- {r.choice(words)} https://a.example/{i}" for i in range(40)), " ".join("#" + r.choice(words).title().replace(" ", "") for _ in range(60)),
        "\n".join(f"{r.choice(words)} | SKU A{i} | L | red | 9.99 EUR" for i in range(30)), "\n".join(r.choice(words) for _ in range(60)),
        " ".join("Ask us for yoga mat: yoga mat, yoga mat and yoga mat. Our yoga mat, a yoga mat sale, beats any yoga mat." for _ in range(8)),
    ]
    assert all(share(p) > 0.5 for p in pages)
    assert all(share(t) <= 0.5 for t in (GENUINE, GENUINE + "\n\n#sleep #running", "1. " + GENUINE + " https://a.example/1\n2. " + GENUINE + " https://a.example/2"))
    review = (
        "How we tested the ankle brace. Before using the ankle brace, teachers preceded their circuit. With the ankle brace, walkers halved their trial. After a month with the ankle brace, "
        "veterans delayed their rehearsal. Without the ankle brace, rowers kept to an easy pace. Two nurses found that the ankle brace slipped on long runs, and one of them stopped wearing it."
    )  # a product is named in every sentence, and yet each says something
    assert share(review) <= 0.5
    mixed = GENUINE + "\n" + pages[0]
    assert share(mixed) > 0.5 and share(GENUINE * 9 + "\n" + pages[0]) <= 0.5


def test_automaton_counts():
    r = random.Random(2)
    for _ in range(20):
        ws = [r.randrange(4) for _ in range(60)]
        a = spam.PageAutomaton(ws)
        covered = a.covered(3, 0.1, [False] * 60)
        want = [False] * 60
        for n in range(1, 60):
            at = {}
            for i in range(60 - n + 1):
                at.setdefault(tuple(ws[i : i + n]), []).append(i)
            for starts in at.values():
                if len(starts) >= 3 and len(starts) * n >= 6:
                    for s in starts:
                        want[s : s + n] = [True] * n
        # Maximal substrings that end at each word: the longest that qualifies, so every covered word is covered by one.
        assert all(w for c, w in zip(covered, want) if c)


def test_table(spark):
    df = spark.createDataFrame([(1, GENUINE, True), (2, "kettlebell sale\n" * 30, False), (3, None, None), (4, "", None), (5, "!!!", None), (None, "x", None), (6, "kettlebell sale\n" * 30_000, None)], "doc_id bigint, text string, is_spam boolean")
    assert {r["doc_id"]: r["is_spam"] for r in spam.spam_pages(df).collect()} == {1: False, 2: True, 6: True}
    assert spam.spam_pages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_keywords_in_many_short_words():
    """Keywords cover most characters of each sentence but few of its words; the automaton must not be skipped."""
    fresh = (f"{a}{b}" for a in "bcdfghjklmnpqrstvwxz" for b in "bcdfghjklmnpqrstvwxz")
    text = "\n".join(
        f"Der Krafttrainingsplan ist für {next(fresh)} {next(fresh)} und der Krafttrainingsplan mit {next(fresh)} {next(fresh)} oder {next(fresh)} {next(fresh)}." for _ in range(20)
    )
    assert spam.spam_share(text)[1] > 0.5


def test_long_keyword_strings():
    """A string of 20 keywords between fresh sentences; a sentence as long and as often repeated is none."""
    r = random.Random(4)
    fresh = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6))
    string = "yoga mat kettlebell foam roller for jump rope weight vest resistance band and treadmill ankle brace pullup bar gym gloves"
    sentence = "We found that the runners who had slept for more than eight hours were on the whole in a better mood than before"
    page = lambda x: "\n".join(f"{x} {fresh()} {fresh()}." for _ in range(20))
    assert share(page(string)) > 0.5 and spam.spam_share(page(string))[2] > 0.6 and share(page(sentence)) <= 0.5


def pages_of(language, n=60, seed=5):
    """Sentences of another language, and keyword pages in it."""
    r = random.Random(seed)
    subjects, verbs, objects, places = language
    sentence = lambda: f"{r.choice(subjects)} {r.choice(verbs)} {r.choice(objects)}{r.choice(('', ' ' + r.choice(places)))}.".capitalize()
    genuine = [(i, " ".join(sentence() for _ in range(r.randrange(4, 9)))) for i in range(n)]
    bare = [o.split()[-1] for o in objects]
    stuffed = [(n + i, " ".join(f"{r.choice(bare)} {r.choice(('xoom', 'zilt', 'prak'))}" for _ in range(60))) for i in range(4)]
    return genuine, stuffed


OTHERS = {
    "it": (["il medico", "la squadra", "un corridore", "lo studio"], ["ha visto", "non ha cambiato", "misura", "segue"], ["la caviglia", "il muscolo", "una scarpa", "il sonno"], ["con un sensore nella palestra", "dopo la gara e prima del riposo", "per tre mesi in montagna"]),
    "nl": (["de arts", "het team", "een loper", "de studie"], ["heeft gezien", "veranderde niet", "meet", "volgt"], ["de enkel", "de spier", "een schoen", "het hart"], ["met een sensor in de zaal", "na de wedstrijd en voor de rust", "drie maanden lang op het strand"]),
    "ru": (["врач из города", "наша команда на поле", "бегун из деревни"], ["увидел", "не изменил", "измеряет"], ["сон", "ритм", "мышцу", "обувь"], ["с датчиком в зале", "после забега и до отдыха", "в течение месяца на берегу"]),
}


def test_languages_outside_the_seed_words(spark):
    """Linking words come from the corpus; with none of the seed words at all."""
    rows, spam_ids, at = [], set(), 0
    for lang, words in OTHERS.items():
        genuine, stuffed = pages_of(words)
        rows += [(at + i, t, lang.upper() if i % 5 == 0 else lang) for i, t in genuine + stuffed]
        spam_ids |= {at + i for i, _ in stuffed}
        at += 1000
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for seed in ({}, spam.SEED):
        assert {r["doc_id"] for r in spam.spam_pages(df, seed=seed).filter("is_spam").collect()} == spam_ids
    learned = {(r["lang"], r["word"]) for r in spam.linking_words(df).collect()}
    assert {("it", "con"), ("nl", "met"), ("ru", "в")} <= learned and not {w for _, w in learned} & {"xoom", "caviglia", "enkel"}


def test_automaton_of_pieces():
    """Cutting at rare tokens loses no substring that occurs often enough."""
    r = random.Random(8)
    for least in (2, 3, 4):
        for _ in range(40):
            codes = [r.choice((0, 1, 2, r.randrange(30))) for _ in range(r.randrange(1, 90))]
            for density in (0.0, 0.06):
                assert spam.PageAutomaton(codes, least).covered(least, density) == spam.PageAutomaton(codes).covered(least, density)


def test_no_spam_without_repetition():
    fresh = [f"{a}{b}{c}" for a in "bcdfg" for b in "hjklm" for c in "npqrs"]
    assert share(" ".join(fresh)) == 0.0 and share(" ".join(fresh[:10] * 6)) == 1.0


def test_automaton_is_no_larger_than_what_repeats():
    """Tokens that are frequent, but never beside the same neighbours, have one state each, not one for every place."""
    codes = [(i * step) % 31 for step in range(1, 16) for i in range(31)]
    assert max(Counter(zip(codes, codes[1:])).values()) < 4 <= min(Counter(codes).values())
    a = spam.PageAutomaton(codes, 4)
    assert len(a.by_length) == 31 and {a.count[v] for v in a.by_length} == {15}
    for linking in (None, [c < 3 for c in codes]):
        assert a.covered(4, 0.03, linking) == spam.PageAutomaton(codes).covered(4, 0.03, linking)
    assert spam.PageAutomaton([0], 2).covered(2) == [False] and spam.PageAutomaton([0]).covered(1) == [True]


#: Letters, digits, marks, spaces and signs that tell the ways of splitting apart: a sharp s, a dotted I, a final sigma, a
#: combining accent, digits of other scripts and sizes, white space that is no space, an underscore.
ODD = "abC7 9 0_'’-.,;:!?#|/\"»”)\n\t\r\x0b\u00a0\u2028ßİΣςé\u0301٣²½Ⅷ文ª"


def odd_texts(n=300):
    r = random.Random(11)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(60))) for _ in range(n)]


def test_splitting_finds_what_the_patterns_find():
    for t in odd_texts():
        assert spam._spaced(t.lower()).split() == WORD.findall(t.lower())
        assert spam._nines(t) == re.sub("[0-9]+", "9", t)
        lines = [x.lstrip("> ").rstrip() if x.startswith(">") else x.strip() for x in t.split("\n")]
        assert spam._units(t) == [u for x in lines if x for u in re.split(r"(?<=[.!?;])[\"”’»)\]]*\s+", x)]


def test_word_counts_are_those_of_the_pattern():
    texts = odd_texts()
    held, uses, ends = Counter(), Counter(), Counter()
    for t in texts:
        found = re.findall(r"([^\W_]++)([^\w '’-]?)", t.lower() + "\n")
        held.update({w for w, _ in found})
        uses.update(w for w, _ in found)
        ends.update(w for w, mark in found if mark)
    rows = next(spam._word_counts(iter([pd.DataFrame({"lang": "en", "text": texts})])))
    got = {r.word: (r.held, r.uses, r.ends) for r in rows.itertuples() if isinstance(r.word, str)}
    assert got == {w: (held[w], uses[w], ends[w]) for w in held if not w.isdigit()}
