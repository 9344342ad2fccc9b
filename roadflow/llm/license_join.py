"""License scans by an exact set-similarity join.

Blocks of a text are its lines and its paragraphs (lines between blank ones).  A
block matches a template if at least ``CONTAINMENT`` of the template's distinct
words are in it.  The join is exact and needs no pair that its filters exclude:

* order: words are ranked by how many documents have them, rarest first, counted
  over the whole corpus;
* prefix: with ``need = ceil(threshold * |T|)``, a match has one of the first
  ``|T| - need + 1`` words of the ordered template in the block; those words are
  the index;
* length: a block with fewer than ``need`` distinct words cannot match;
* position: after a hit on word ``i`` of the template at place ``j`` of the
  ordered block, at most ``min(|T| - i, |B| - j)`` words can still be shared.

What survives is verified by counting the shared words.  Words of no template
cannot be shared, so only template words are ranked and counted; the rest of a
block counts as more frequent than any.  Templates are a stated list of bounded
size that every task holds; documents are read where they lie, none is shuffled.

Defined results: null and empty texts have no words, no places, no labels and a
score of 0; repeated rows give repeated results; a template without words never
matches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from roadflow.llm.shared import explode_texts, map_texts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CONTAINMENT = 0.8
#: Words of all templates together, at most.
MAX_TEMPLATE_WORDS = 200_000
# Base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Notices of public licenses and the labels they get.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work"),
]

FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
          ("base_labels", "string"), ("labels", "string"), ("score", "double")]


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, of lower-cased UTF-8."""
    return WORD.findall(text)


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes: A-Z only


def blocks(text: bytes) -> list[bytes]:
    """Lines, and paragraphs of more than one line."""
    lines = text.split(b"\n")
    found, run = [], []
    for line in [*lines, b""]:
        if line.strip():
            found.append(line)
            run.append(line)
        else:
            if len(run) > 1:
                found.append(b"\n".join(run))
            run = []
    return found


class Index:
    """Ordered templates and the inverted index of their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(words(lowered(t)))) for label, t in templates]
        vocabulary = {w for _, s in sets for w in s}
        self.rank = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.threshold = threshold
        self.templates = [(label, sorted(s, key=self.rank.__getitem__)) for label, s in sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, ordered) in enumerate(self.templates):
            for i, w in enumerate(ordered[:len(ordered) - self.need(len(ordered)) + 1] if ordered else []):
                self.prefix.setdefault(w, []).append((t, i))

    def need(self, size: int) -> int:
        return max(1, math.ceil(self.threshold * size - 1e-9))

    def matches(self, block: set[bytes]) -> dict[int, float]:
        """template -> containment, for every template that meets the threshold."""
        shared = block & self.rank.keys()
        if not shared:
            return {}
        ordered = sorted(shared, key=self.rank.__getitem__)
        tried, found = set(), {}
        for j, w in enumerate(ordered):
            for t, i in self.prefix.get(w, ()):
                size = len(self.templates[t][1])
                need = self.need(size)
                if t in tried:
                    continue
                tried.add(t)  # the first prefix word found is the rarest: nothing is shared before it
                if len(block) < need or min(size - i, len(ordered) - j) < need:
                    continue
                overlap = sum(x in shared for x in self.templates[t][1])
                if overlap >= need:
                    found[t] = overlap / size
        return found


def template_words(templates: Sequence[tuple[str, str]]) -> frozenset[bytes]:
    found = [words(lowered(t)) for _, t in templates]
    if sum(map(len, found)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words: join them in several lists")
    return frozenset(w for ws in found for w in ws)


def word_frequency(docs: DataFrame, text: str, templates: Sequence[tuple[str, str]]) -> dict[bytes, int]:
    """Documents that have each template word; counted per slice of rows, then summed by word."""
    vocabulary = template_words(templates)

    def fn(texts):
        count: dict[bytes, int] = {}
        for t in texts:
            for w in vocabulary.intersection(words(lowered(t))):
                count[w] = count.get(w, 0) + 1
        return [0] * len(count), [[w for w in count], [n for n in count.values()]]

    counts = explode_texts(docs, text, fn, [("word", "binary"), ("n", "long")], [])
    # one row a template word, whatever the corpus
    return {bytes(r[0]): r[1] for r in counts.groupBy("word").sum("n").collect()}


def scan_text(text: str | None, index: Index, phrases: Sequence[tuple[str, str]] = PHRASES) -> tuple:
    low = lowered(text)
    found = words(low)
    line = b" " + b" ".join(found) + b" "
    starts, base = [], set()
    for phrase, label in phrases:
        needle = b" " + phrase.encode() + b" "
        at, before, seen = line.find(needle), 0, 0
        while at >= 0:
            seen += line.count(b" ", before, at)  # words since the last place
            starts.append(seen)
            base.add(label)
            before, at = at, line.find(needle, at + 1)
    labels, score = set(base), 0.0
    for block in blocks(low):
        for t, share in index.matches(set(words(block))).items():
            labels.add(index.templates[t][0])
            score = max(score, share)
    return (len(found), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text",
                  templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = CONTAINMENT,
                  phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per row of ``docs``: ``keep``, word count, phrase places, labels and score.

    ``score`` is the largest containment of a template in a block, 0 below the
    threshold.
    """
    index = Index(templates, word_frequency(docs, text, templates), threshold)

    def fn(texts):
        rows = [scan_text(t, index, phrases) for t in texts]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

    return map_texts(docs, text, fn, FIELDS, keep)
