"""Keyword-stuffed pages, link lists and product-tag lists.

A page is read in units: lines, and the sentences in them. Two things are measured and combined:

* Coverage. The suffix automaton of the whole page, over its words and marks (`#`, `|`, brackets and the like; numbers are
  all one word), counts how often every substring occurs. Its states' longest strings are the maximal repeated substrings;
  their characters are what repetition covers.
* Clause structure. A unit reads as a sentence if enough of its words are linking words, of more than one kind and of
  more kinds the longer it is, and it is not mostly links, tags or cells. Linking words are learned from the corpus, per language: words that a good part of the
  documents hold and that hardly ever end a clause, as articles, prepositions, conjunctions and many verbs do.

Neighbouring units without clause structure are one block. A block counts against the page if repetition covers `loose` of
its characters. A unit with clause structure counts against it if dense keywords (repeated substrings of content words that
make up `density` of the page) cover `stuffed` of its characters. A page more than half of whose words count is spam. So
no page is spam without repetition, and the automaton is built for every page.

Pages never shuffle; a page is handled whole, in memory linear in its own length. The learned words are a bounded table
(at most `most` per language tag of two or three letters), which is broadcast.

Null and empty texts, and texts without a word, have no verdict.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterator, Mapping, Sequence
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.words import WORD
from feedloom.runtime import stage

#: Linking words of English, German, French and Spanish, for corpora too small to learn from.
_SEED = (
    "the of and to in for with by from at on as than that which when while whether who we our their its it is are was were be been has have had will"
    " would can could this these those no not if or but after before under over between during without within through against despite across beyond"
    " alongside around more most how what your you your they he she his her an a into about did does do any each of only whereas below need"
    " der die das den dem des ein eine einer einem einen und oder aber nicht mit ohne bei auf aus im in am an zu zur zum von vom für über unter nach"
    " vor während durch gegen trotz wie als ist sind war wird werden hat haben laut sich es er sie wir ihre seine"
    " le la les l un une des du de d et ou mais ne pas avec sans chez sur sous dans par pour selon pendant après avant au aux ce cette ces qui que est"
    " sont était ont il elle nous leur plus en rapport malgré"
    " el los las una unos unas del y o pero con sin según durante tras ante al este esta estos son era ha han se su sus más lo frente pese desde para por"
)
#: The seed words with a usual share of all words, a guess on the high side.
SEED = dict.fromkeys(_SEED.split(), 0.03)
LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]]*\]\([^)]*\)|https?://\S+|www\.\S+", re.I | re.S)
TAG = re.compile(r"(?<!\w)#\w+")
#: The end of a sentence, its mark captured, which belongs to it.
SENTENCES = re.compile(r"([.!?;])[\"”’»)\]]*\s+")
CELLS = re.compile(r"\s[|»›>·•/]\s|;\s|\t")
#: Without one of these a text has no cells; without one of those it has no links.
CELL_MARKS, LINK_MARKS = "|»›>·•/;\t", ("://", "www.", "](", "<a ")
#: What the automaton reads: words, and the marks that lists, links and tags are made of.
TOKEN = re.compile(r"[^\W_]+|[#|<>\[\]=/@*•·»›]")
MARKS = frozenset("#|<>[]=/@*•·»›")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What may follow a word inside a clause.
INSIDE = frozenset(" '’-_")


def _spaced(lowered: str, clauses: bool = False) -> str:
    """A space for each character that is no letter, digit or line feed, so that splitting gives what WORD finds; with
    `clauses`, a line feed for those that end a clause."""
    for c in set(lowered):
        if not c.isalnum() and c != "\n":
            lowered = lowered.replace(c, "\n" if clauses and c not in INSIDE else " ")
    return lowered


def _nines(text: str) -> str:
    """The text with 9 for every number."""
    for c in "012345678":
        text = text.replace(c, "9")
    while "99" in text:
        text = text.replace("99", "9")
    return text


# --- linking words -----------------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        documents: Counter = Counter()
        counts: dict[str, tuple[Counter, Counter, Counter]] = {}
        for lang, t in zip(pdf["lang"], pdf["text"]):
            held, uses, ends = counts.setdefault(lang, (Counter(), Counter(), Counter()))
            t = _spaced(t.lower(), clauses=True)
            ws = t.split()
            documents[lang] += 1
            held.update(set(ws))
            uses.update(ws)
            ends.update([clause.rpartition(" ")[2] for clause in t.split("\n")])  # '' where no word stands before the end
        rows = [(lang, None, n, 0, 0) for lang, n in documents.items()]
        for lang, (held, uses, ends) in counts.items():
            rows += [(lang, w, n, uses[w], ends[w]) for w, n in held.items() if not w.isdigit()]
        yield pd.DataFrame(rows, columns=["lang", "word", "held", "uses", "ends"])


def linking_words(
    documents: DataFrame, *, text: str = "text", lang: str = "lang", share: float = 0.15, ends: float = 0.02, prior: int = 10, most: int = 400
) -> DataFrame:
    """(lang, word, share, ends, rate) of the words that link others, per language tag (two or three letters, else '').

    A word counts if at least `share` of the language's documents hold it and at most `ends` of its uses end a clause; the
    number of documents is raised by `prior`, so that a language of few documents needs more agreement. The `most` most
    widely held are kept. rate is the word's share of all words of the language. All documents are counted; null and empty
    texts hold no word.
    """
    tag = F.regexp_extract(F.lower(F.coalesce(F.col(lang).cast("string"), F.lit(""))), r"^([a-z]{2,3})(?:[^a-z]|$)", 1)
    some = documents.select(tag.alias("lang"), F.col(text).alias("text")).filter("text <> ''")
    counts = some.mapInPandas(_word_counts, "lang string, word string, held bigint, uses bigint, ends bigint")
    # Read twice below, so staged: else all documents would be counted twice. The row without a word counts documents.
    total = stage(counts.groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in ("held", "uses", "ends")]), "word-counts")
    by_lang = Window.partitionBy("lang")
    sizes = total.groupBy("lang").agg(F.max(F.when(F.col("word").isNull(), F.col("held"))).alias("documents"), F.sum("uses").alias("all_uses"))
    known = (
        total.filter(F.col("word").isNotNull() & (F.col("ends") <= ends * F.col("uses"))).join(sizes, "lang")
        .select("lang", "word", (F.col("held") / (F.col("documents") + prior)).alias("share"), (F.col("ends") / F.col("uses")).alias("ends"), (F.col("uses") / F.col("all_uses")).alias("rate"))
    )
    linking = known.filter(F.col("share") >= share)
    return linking.withColumn("k", F.row_number().over(by_lang.orderBy(F.desc("share"), "word"))).filter(F.col("k") <= most).drop("k")


# --- a page ------------------------------------------------------------------------------------------------------------


def _units(text: str) -> list[str]:
    """Lines' sentences; a line that a sentence runs over (no end, and the next begins small) is joined with the next."""
    lines: list[str] = []
    for raw in text.split("\n"):
        line = raw.lstrip("> ").rstrip() if raw.startswith(">") else raw.strip()
        if not line:
            continue
        if lines and raw.startswith(">") and not lines[-1].endswith((".", "!", "?", ":")):
            lines[-1] += " " + line
        else:
            lines.append(line)
    units = []
    for line in lines:
        parts = SENTENCES.split(line)
        units += [u + mark for u, mark in zip(parts[::2], [*parts[1::2], ""])] if len(parts) > 1 else parts
    return units


#: Share of linking words from which on a string reads as a sentence, and the number of words for which it needs a further kind.
LINKED, WORDS_A_KIND = 0.12, 15


def has_clause(unit: str, core: list[str], linking: Container[str] = SEED, cells: bool = True) -> bool:
    """Does the unit read as a sentence? core: its lower-cased words without those of links and tags. cells: may it hold cells?"""
    n = len(core)
    if n < 4:
        return False
    found = [*filter(linking.__contains__, core)]
    kinds = len(set(found))
    if kinds * WORDS_A_KIND < n or kinds < 2 and n < 6:
        return False
    if cells and len(CELLS.findall(unit)) * 4 > n:
        return False
    if kinds >= 2 and len(found) >= LINKED * n:
        return True
    return len(found) >= 0.05 * n and n >= 6 and unit.rstrip("\"”’»)] ").endswith((".", "!", "?", ";"))


class PageAutomaton:
    """Suffix automaton of one page's tokens, with the number of occurrences of each state.

    The page is cut at the tokens that occur less than `least` times, and between two tokens that follow each other less
    often: no substring that occurs so often holds one, so the automaton of the pieces has every maximal substring that
    occurs `least` times, with its true count. Most pieces are single tokens, which are only counted.
    """

    def __init__(self, codes: Sequence[int], least: int = 1):
        at = np.asarray(codes, dtype=np.int64)
        n = len(at)
        times = np.bincount(at)
        often = times[at] >= least
        joined = np.zeros(n + 1, dtype=bool)  # at i: is token i in one piece with the one before
        pairs = at[:-1] * len(times) + at[1:]
        ordered = np.sort(pairs[often[:-1] & often[1:]])
        if len(ordered) >= least:
            met = ordered[least - 1 :][ordered[least - 1 :] == ordered[: len(ordered) - least + 1]]  # pairs that occur so often, in order
            if len(met):
                joined[1:n] = met[np.minimum(met.searchsorted(pairs), len(met) - 1)] == pairs
        strung = joined[:-1] | joined[1:]
        singles = np.flatnonzero(often & ~strung)
        alone = np.bincount(at[singles], minlength=len(times))
        held = np.flatnonzero(alone)
        new = len(held) + 1  # the next state's number
        state, ended = np.zeros(len(times), dtype=np.int64), np.zeros(len(times), dtype=np.int64)
        state[held] = np.arange(1, new)
        ended[at[singles]] = singles
        strung = np.flatnonzero(strung)
        room = [0] * (2 * len(strung))
        following: list[dict[int, int]] = [dict(zip(held.tolist(), range(1, new))), *({} for _ in range(1, new))]
        link, length, count, end = [-1] + [0] * (new - 1) + room, [0] + [1] * (new - 1) + room, [0, *alone[held].tolist(), *room], [0, *ended[held].tolist(), *room]
        path = np.zeros(n, dtype=np.int64)
        path[singles] = state[at[singles]]
        walked = []
        last = 0
        for i, w, on in zip(strung.tolist(), at[strung].tolist(), joined[strung].tolist()):
            if not on:
                last = 0
            q = following[last].get(w)
            if q is not None:  # only where a piece begins like an earlier one
                if length[last] + 1 != length[q]:
                    self._split(following, link, length, end, last, w, q, new)
                    q, new = new, new + 1
                count[q] += 1
                walked.append(q)
                last = q
                continue
            this = new
            walked.append(this)
            new += 1
            following.append({})
            length[this] = length[last] + 1
            count[this] = 1
            end[this] = i
            p = last
            while p != -1:
                known = following[p]
                if w in known:
                    q = known[w]
                    if length[p] + 1 != length[q]:
                        self._split(following, link, length, end, p, w, q, new)
                        q, new = new, new + 1
                    link[this] = q
                    break
                known[w] = this
                p = link[p]
            last = this
        path[strung] = walked
        order = sorted(range(1, new), key=length.__getitem__, reverse=True)
        for v in order:
            count[link[v]] += count[v]
        order.reverse()
        self.path, self.link, self.length, self.count, self.end, self.by_length = path, link, length, count, end, order

    @staticmethod
    def _split(following, link, length, end, p: int, w: int, q: int, clone: int) -> None:
        """The state `clone`: a copy of q for the shorter strings that reach it from p."""
        following.append(following[q].copy())
        length[clone] = length[p] + 1
        link[clone] = link[q]
        end[clone] = end[q]
        link[q] = clone
        while p != -1 and following[p].get(w) == q:
            following[p][w] = clone
            p = link[p]

    def covered(self, least_count: int, least_density: float = 0.0, linking: Sequence[bool] | None = None) -> list[bool]:
        """Tokens in a maximal substring that occurs least_count times and makes up least_density of the page.

        With `linking`, the substring must be a keyword: not of linking words alone, and without clause structure itself (less
        than two linking words, or less than LINKED of its tokens); else it is a repeated sentence. Of a sentence the shortest
        of its ends that occurs as often is tried too.
        """
        n = len(self.path)
        link, length, count, end = self.link, self.length, self.count, self.end
        need = max(least_count, least_density * n)
        if not any(count[v] >= least_count and count[v] * length[v] >= need for v in self.by_length):
            return [False] * n
        before = [0, *np.cumsum(linking).tolist()] if linking is not None else None
        # The length of each state's longest suffix that qualifies, shorter states first: linear, however periodic the page is.
        best = [0] * len(link)
        for v in self.by_length:
            c = count[v]
            if c >= least_count:
                k = length[v]
                if before is None:
                    if c * k >= need:
                        best[v] = k
                        continue
                else:
                    till = before[end[v] + 1]
                    for k in (k, length[link[v]] + 1):
                        if c * k < need:
                            break
                        held = till - before[end[v] + 1 - k]
                        if held < k and (held < 2 or held < LINKED * k):
                            best[v] = k
                            break
                    if best[v]:
                        continue
            best[v] = best[link[v]]
        longest = np.array(best)[self.path]
        last = np.flatnonzero(longest)
        begun = np.bincount(last + 1 - longest[last], minlength=n + 1) - np.bincount(last + 1, minlength=n + 1)
        return (np.cumsum(begun)[:n] > 0).tolist()


#: Times that a repeated substring of a list, and a dense keyword among sentences, must occur.
REPEATED, LEAST_COUNT = 2, 4


#: A linking word that a page uses so often, and so many times more often than its language does, is a keyword there.
OVERUSED, TIMES_USUAL = 0.08, 5.0


def spam_share(
    text: str, linking: Mapping[str, float] = SEED, density: float = 0.06, stuffed: float = 0.45, loose: float = 0.3
) -> tuple[int, float, float] | None:
    """(words, share of words in units counted against the page, share of characters that repetition or keywords cover there).

    linking: the linking words with the share of all words that they usually are.
    """
    text = _nines(text)
    units = _units(text)
    words = [*map(str.split, _spaced("\n".join(units).lower()).split("\n"))]
    read = [(u, ws, len(ws), ws) for u, ws in zip(units, words) if ws]  # what is left of it, its words there, number of words, tokens
    if not read:
        return None
    if any(m in text for m in MARKS):
        linkable = any(m in text for m in LINK_MARKS)
        for at, (u, core, n, _) in enumerate(read):
            rest, own = u, TOKEN.findall(u.lower())
            linked = linkable and any(m in u for m in LINK_MARKS)
            tagged = "#" in u
            if linked or tagged:
                rest = LINK.sub(" ", u) if linked else u
                rest = TAG.sub(" ", rest) if tagged else rest
                core = WORD.findall(rest.lower())
                if tagged:
                    own = TOKEN.findall(HUMP.sub(" ", u).lower())
            read[at] = rest, core, n, own
    number = defaultdict(count().__next__)
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable([x[3] for x in read])), np.int64)
    total = sum([x[2] for x in read])
    vocabulary, times = [*number], np.bincount(codes)
    least = max(LEAST_COUNT, OVERUSED * total)
    frequent = [(vocabulary[c], int(times[c])) for c in np.flatnonzero(times >= least).tolist()]
    overused = {w for w, c in frequent if c > TIMES_USUAL * linking.get(w, 1.0) * total}
    links = linking.keys() - overused if overused else linking
    cells = any(m in text for m in CELL_MARKS)
    units = [(n, len(own), len(core) >= 0.5 * n and has_clause(rest, core, links, cells)) for rest, core, n, own in read]
    clauses = {x[2] for x in units}
    all_clauses = False not in clauses
    automaton = PageAutomaton(codes, LEAST_COUNT if all_clauses else REPEATED)
    is_linking = np.fromiter(map(links.__contains__, vocabulary), bool, len(times))
    keyword = automaton.covered(LEAST_COUNT, density, is_linking[codes]) if True in clauses else []
    has_keywords = True in keyword
    if all_clauses and not has_keywords and stuffed > 0:
        return total, 0.0, 0.0
    sizes = np.fromiter(map(len, vocabulary), np.int64, len(times))
    size = sizes[codes]
    sized = [0, *np.cumsum(size).tolist()]
    stuffing = [0, *np.cumsum(size * np.array(keyword) * ((sizes > 1) & ~is_linking)[codes]).tolist()] if has_keywords else None
    repetition = [0, *np.cumsum(size * np.array(automaton.covered(REPEATED))).tolist()] if not all_clauses else None
    against = at = chars = hits = 0
    k = 0
    while k < len(units):
        words, n, clause = units[k]
        end = at + n
        k += 1
        if clause:
            hit = stuffing[end] - stuffing[at] if stuffing else 0
        else:
            while k < len(units) and not units[k][2]:
                words += units[k][0]
                end += units[k][1]
                k += 1
            hit = repetition[end] - repetition[at]
        own = sized[end] - sized[at]
        chars += own
        hits += hit
        at = end
        if hit >= (stuffed if clause else loose) * own:
            against += words
    return total, against / total, hits / max(1, chars)


def spam_pages(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", threshold: float = 0.5, density: float = 0.06,
    stuffed: float = 0.45, seed: Mapping[str, float] = SEED,
) -> DataFrame:
    """(doc_id, n_words, spam_share, covered_share, is_spam) of every document with a word in its text.

    Linking words are `seed` and what the corpus shows, for all pages together, since language tags are often wrong; without
    a lang column all documents are one language. A repeated row is judged as often as it occurs.
    """
    spark = documents.sparkSession
    tagged = documents if lang and lang in documents.columns else documents.select(text).withColumn("lang", F.lit(""))
    learned = linking_words(tagged, text=text, lang=lang if lang and lang in documents.columns else "lang")
    # Bounded: `most` words for each tag of two or three letters.
    rates = {r["word"]: r["rate"] for r in learned.groupBy("word").agg(F.max("rate").alias("rate")).collect()}
    shared = spark.sparkContext.broadcast({**seed, **rates})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        linking = shared.value
        for pdf in batches:
            rows = []
            for doc, t in zip(pdf.iloc[:, 0].to_numpy(), pdf.iloc[:, 1]):
                found = spam_share(t, linking, density, stuffed) if t else None
                if found:
                    rows.append((doc, *found, found[1] > threshold))
            yield pd.DataFrame(rows, columns=[doc_id, "n_words", "spam_share", "covered_share", "is_spam"])

    judged = documents.select(F.col(doc_id).cast("bigint"), text).filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return judged.mapInPandas(run, f"{doc_id} bigint, n_words int, spam_share double, covered_share double, is_spam boolean")
