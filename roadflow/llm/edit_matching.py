"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters has an error budget of ``k = floor(rate * m)`` edits
and is split into ``k + 1`` pieces.  If the item occurs in a document with at
most ``k`` edits, some piece occurs unchanged.  All pieces are searched at once
(Aho-Corasick) in every whole text; around each exact hit the whole item is
verified with Myers' bit-parallel distance, free at both ends of the window.

The benchmark is the stated query set.  It is taken in blocks of at most
``BLOCK_CHARS`` characters, and each block is one pass over the documents: what
a task holds is bounded by the block, not by the benchmark.

Texts are compared in lower case with every white-space character as a space;
positions are code points of the original text.

Defined results: null and empty texts and items match nothing; an item shorter
than ``MIN_CHARS`` is searched without errors; repeated items are matched each;
per (document row, item) the best place is returned: smallest distance, then
smallest start.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.shared import explode_texts, map_texts

ERROR_RATE = 0.08
MIN_CHARS = 24
#: Characters of benchmark items searched in one pass.
BLOCK_CHARS = 4_000_000

#: The final sigma, which depends on the next letter, is an ordinary one.
SPACES = str.maketrans("\t\n\v\f\r\xa0\u03c2", " " * 6 + "\u03c3")

FIELDS = [("item_id", "long"), ("start", "long"), ("end", "long"), ("distance", "int")]


def normal(text: str | None) -> str:
    """Lower case and plain spaces, code point for code point."""
    text = text or ""
    lower = text.lower()
    if len(lower) != len(text):  # a letter that grows in lower case stays as it is
        lower = "".join(low if len(low := c.lower()) == 1 else c for c in text)
    return lower.translate(SPACES)


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(rate * length) if length >= MIN_CHARS else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(mask: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring, and the first end of one."""
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(h | plus) & full
        down = plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(x | up) & full
        minus = up & x
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """One block of items, ready to search."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        self.masks: dict[int, tuple] = {}
        places: dict[str, list] = {}
        for n, (_, item, k) in enumerate(self.items):
            for offset, piece in pieces(item, k):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per item the stretches of text that a hit allows it to lie in, joined where they overlap."""
        found: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                _, item, k = self.items[n]
                begin = last + 1 - length - offset
                low, high = max(0, begin - k), min(len(text), begin + len(item) + k)
                stretches = found.setdefault(n, [])
                if stretches and low <= stretches[-1][1] and high >= stretches[-1][0]:
                    stretches[-1] = [min(low, stretches[-1][0]), max(high, stretches[-1][1])]
                else:
                    stretches.append([low, high])
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) of every item within its budget."""
        out = []
        if self.empty or not text:
            return out
        for n, stretches in self.windows(text).items():
            item_id, item, k = self.items[n]
            exact = text.find(item)
            if exact >= 0:
                out.append((item_id, exact, exact + len(item), 0))
                continue
            if n not in self.masks:
                self.masks[n] = masks(item), masks(item[::-1])
            forward, backward = self.masks[n]
            best = None
            for low, high in stretches:
                distance, end = myers(forward, len(item), text[low:high])
                if distance <= k:
                    end += low
                    # the same distance read backwards from the end gives the start
                    back = text[max(0, end - len(item) - distance):end][::-1]
                    _, length = prefix_length(backward, len(item), back)
                    place = (distance, end - length, end)
                    best = min(best, place) if best else place
            if best:
                out.append((item_id, best[1], best[2], best[0]))
        return out


def prefix_length(mask: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a prefix of ``text``, and its shortest length."""
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        x = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(h | plus) & full
        down = plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | 1) & full, down << 1 & full  # the first row grows with the text
        plus = down | ~(x | up) & full
        minus = up & x
        if score < best:
            best, end = score, j
    return best, end


@functools.lru_cache(maxsize=2)
def matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def blocks(items: DataFrame, id_col: str, text: str, chars: int = BLOCK_CHARS) -> Iterator[tuple]:
    """The normalised items in blocks of bounded size; the driver holds one partition of items and one block at a time."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    for row in rows.filter("length(text) > 0").toLocalIterator():
        block.append((row.id, normal(row.text)))
        size += len(row.text)
        if size >= chars:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text",
               item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """One row per (row of ``docs``, item found in it): ``keep``, item_id, start, end, distance."""
    found = None
    for block in blocks(items, item_id, item_text):
        def fn(texts, block=block):
            search = matcher(block, rate).matches
            rows, made = [], []
            for n, t in enumerate(texts):
                for match in search(normal(t)):
                    rows.append(n)
                    made.append(match)
            return rows, [list(c) for c in zip(*made, strict=True)] if made else [[] for _ in FIELDS]

        part = explode_texts(docs, text, fn, FIELDS, keep)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = explode_texts(docs.limit(0), text, lambda texts: ([], [[] for _ in FIELDS]), FIELDS, keep)
    return found


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no item is found; every block filters what the one before left."""
    columns = list(docs.columns)
    for block in blocks(items, item_id, item_text):
        def fn(texts, block=block):
            search = matcher(block, rate).matches
            return [[bool(search(normal(t))) for t in texts]]

        docs = map_texts(docs, text, fn, [("__leaked", "boolean")], columns).filter("not __leaked").drop("__leaked")
    return docs
