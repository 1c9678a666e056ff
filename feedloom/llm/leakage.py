"""Evaluation passages inside training text, by a generalised suffix automaton of the evaluation items.

The items are a stated query set: they are taken in blocks of at most `block_words` words (an item longer than that is a
block by itself). The words of up to `blocks_a_scan` blocks are broadcast, which bounds what is sent; each Python worker
builds the automata of these blocks once, and every document streams past all of them in one scan. Documents never shuffle.

For each document the automaton tracks the longest match that ends at each word. A match of at least `min_words` names
all items that hold it. Only stretches in which every two neighbouring words also neighbour in some item are streamed;
a longer match lies wholly inside such a stretch, so nothing is lost.

Null and empty texts, and texts of less than `min_words` words, match nothing. Items of less than `min_words` words never
match. Columns besides those named are ignored. A repeated row gives its pairs once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import WORD, words


class Automaton:
    """Generalised suffix automaton over word numbers; each state knows which items hold its strings."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, ws in items:
            if len(ws) >= min_words:
                coded.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]))
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        n = len(self.vocabulary)
        pairs = {a * n + b for _, ws in coded for a, b in zip(ws, ws[1:])}
        self.bigrams = np.array(sorted(pairs), np.int64)
        self.items: dict[int, set[int]] = {}
        for item, ws in sorted(coded, key=lambda x: x[0]):
            v = 0
            for w in ws:
                v = self.next[v][w]
                u = v
                while self.length[u] >= min_words and item not in self.items.setdefault(u, set()):
                    self.items[u].add(item)
                    u = self.link[u]
        # Neighbouring states of a passage have the same items: one set for all of them, however many items share it.
        same: dict[frozenset, frozenset] = {}
        for u, held in self.items.items():
            one = frozenset(held)
            self.items[u] = same.setdefault(one, one)

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter strings that reach it from p."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[last] + 1 == self.length[q] else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, -1)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._split(p, w, q)
        return new

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the stretches in which every two neighbours also neighbour in an item."""
        if len(codes) < self.min_words or not len(self.bigrams):
            return []
        pair = np.where((codes[:-1] < 0) | (codes[1:] < 0), -1, codes[:-1] * len(self.vocabulary) + codes[1:])
        at = np.searchsorted(self.bigrams, pair)
        good = self.bigrams[np.minimum(at, len(self.bigrams) - 1)] == pair
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        return [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2]) if b + 1 - a >= self.min_words]

    def matches(self, ws: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Longest common run per item, and the [start, end) word spans covered by runs of min_words or more."""
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        longest: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        following, link, length, least, items = self.next, self.link, self.length, self.min_words, self.items
        for a, b in self.stretches(codes):
            v = k = 0
            piece = codes[a:b].tolist()
            for i, w in enumerate(piece, a):
                while v and w not in following[v]:
                    v = link[v]
                    k = length[v]
                if w in following[v]:
                    v = following[v][w]
                    k += 1
                if k >= least:
                    if spans and i + 1 - k <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], i + 1 - k), i + 1)
                    else:
                        spans.append((i + 1 - k, i + 1))
                    if i + 1 < b and length[link[v]] < least:
                        # The same items go on with the next word: what they share is counted there, one longer.
                        after = following[v].get(piece[i + 1 - a])
                        if after is not None and items.get(after) is items[v] and length[link[after]] < least:
                            continue
                    u, m = v, k
                    while m >= least:
                        for item in items[u]:
                            if longest.get(item, 0) < m:
                                longest[item] = m
                        u = link[u]
                        m = length[u]
        return longest, spans


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block: list[tuple[int, list[str]]] = []
    size = 0
    for r in items.select(item_id, text).filter(F.col(text).isNotNull()).toLocalIterator():
        ws = words(r[1])
        if block and size + len(ws) > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], ws))
        size += len(ws)
    if block:
        yield block


_BUILT: dict[tuple, list[Automaton]] = {}


def _automata(shared: Broadcast, min_words: int) -> list[Automaton]:
    """The automata of a broadcast group of blocks, built once in each worker; only the last group is kept."""
    name, blocks = shared.value
    key = (name, min_words)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [Automaton(block, min_words) for block in blocks]
    return _BUILT[key]


def _spans_of(shared: Broadcast, min_words: int):
    @F.pandas_udf("array<int>")
    def spans(texts: pd.Series) -> pd.Series:
        automata = _automata(shared, min_words)
        return pd.Series([[x for a in automata for s in a.matches(ws)[1] for x in s] if len(ws := words(t)) >= min_words else [] for t in texts])

    return spans


def _groups(items: DataFrame, item_id: str, text: str, block_words: int, blocks_a_scan: int) -> Iterator[Broadcast]:
    context = items.sparkSession.sparkContext
    group: list = []
    for block in _blocks(items, item_id, text, block_words):
        group.append(block)
        if len(group) == blocks_a_scan:
            yield context.broadcast((uuid.uuid4().hex, group))
            group = []
    if group:
        yield context.broadcast((uuid.uuid4().hex, group))


def find_leaks(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    min_words: int = 12, block_words: int = 1_000_000, blocks_a_scan: int = 8,
) -> DataFrame:
    """(doc_id, item_id, longest_run): each pair with a common run of at least min_words words."""
    spark = documents.sparkSession
    schema = f"{doc_id} bigint, {item_id} bigint, longest_run int"
    found = None
    for shared in _groups(items, item_id, text, block_words, blocks_a_scan):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automata = _automata(shared, min_words)
            for pdf in batches:
                rows = []
                for doc, t in zip(pdf.iloc[:, 0].to_numpy(), pdf.iloc[:, 1]):
                    if t and len(t) >= 2 * min_words - 1:
                        ws = words(t)
                        for automaton in automata:
                            rows += [(doc, item, n) for item, n in automaton.matches(ws)[0].items()]
                yield pd.DataFrame(rows, columns=[doc_id, item_id, "longest_run"])

        part = documents.select(F.col(doc_id).cast("bigint"), text).filter(F.col(doc_id).isNotNull()).mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.groupBy(doc_id, item_id).agg(F.max("longest_run").alias("longest_run"))


def remove_leaks(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    min_words: int = 12, max_coverage: float = 0.5, block_words: int = 1_000_000, blocks_a_scan: int = 8,
) -> DataFrame:
    """Documents without leaked spans: all columns, the text cleaned, and leaked_words, coverage, dropped.

    A leaked span is cut from its first to its last word; the text around it stays as it is. A document more than
    max_coverage of whose words leaked is marked dropped and keeps no text (null). Null and empty texts stay unchanged.
    Columns of documents that have one of the three names are replaced; all others are kept. Each group of blocks adds its
    spans to the row, so what is broadcast at once stays bounded.
    """
    marked = documents.drop("leaked_words", "coverage", "dropped").withColumn("__spans", F.array().cast("array<int>"))
    for shared in _groups(items, item_id, text, block_words, blocks_a_scan):
        marked = marked.withColumn("__spans", F.concat("__spans", _spans_of(shared, min_words)(F.col(text))))

    @F.pandas_udf("text string, leaked_words int, coverage double, dropped boolean")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, flat in zip(texts, spans):
            if not t or not len(flat):
                rows.append((t, 0, 0.0, False))
                continue
            at = list(WORD.finditer(t))
            merged: list[list[int]] = []
            for a, b in sorted(zip(flat[::2], flat[1::2])):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            n = sum(b - a for a, b in merged)
            kept, last = [], 0
            for a, b in merged:
                kept.append(t[last : at[a].start()])
                last = at[b - 1].end()
            coverage = n / len(at)
            rows.append((None if coverage > max_coverage else "".join(kept) + t[last:], n, coverage, coverage > max_coverage))
        return pd.DataFrame(rows, columns=["text", "leaked_words", "coverage", "dropped"])

    cleaned = marked.withColumn("__clean", clean(F.col(text), F.col("__spans"))).drop("__spans")
    return cleaned.withColumn(text, F.col("__clean.text")).select("*", "__clean.leaked_words", "__clean.coverage", "__clean.dropped").drop("__clean")
