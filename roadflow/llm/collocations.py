"""Phrase collocations by weighted acyclic automata over words.

A count transducer is a minimal acyclic automaton whose paths are phrases and whose
transitions carry the count of the phrase that ends there.  It is built from sorted
phrases: a state is frozen once the phrases with its prefix have passed, and found
again in a register if one with equal transitions exists already.

1. Every task counts phrases in runs of ``RUN_TOKENS`` words, sorts a run, cuts it at
   the bounds of prefix ranges and builds one transducer per (range, language).
2. The transducers of a range are united and the weights of equal paths summed;
   only phrases of at least ``MIN_COUNT`` stay: all others are neither candidates
   nor parts of one.
3. Each range collects the parts of its candidates in request transducers, one per
   range that the parts lie in; a part's weight is the count of the longest-standing
   claim on it, the most frequent candidate that it lies in.
4. A range composes requests with its counts: paths of both, with the weight of the
   counts.  The answers go back as transducers, together with the claims on the
   range's own phrases, and every candidate is scored with exact integers.

A range's phrases are close in (language, words) order and may have any prefix in
common, so the phrases of one hot word, or one hot language, are spread over many
ranges.  Bounds come from a bounded sample of word windows; they only say where a
phrase is counted.  Nothing else is sampled.

Defined results: null and empty texts have no words; a null language is ``und``;
repeated rows count again; languages without a candidate have no row; ties of the
lowest-scoring cut go to the shorter first part.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadflow.llm.shared import quoted, slices, written

MAX_WORDS, MIN_COUNT = 3, 10
#: A candidate goes if a longer one around it has this percentage of its count.
COVERED = 50
TOP = 2000
#: Words that a task counts before it hands them on, those that it takes in at once, and the
#: bits that number them.
RUN_TOKENS, PIECE_TOKENS, BITS = 1_500_000, 500_000, 21
#: Text bytes for a prefix range, and the most ranges.
RANGE_BYTES, MAX_RANGES = 8 << 20, 1 << 14
#: Sampled windows per task and per range, their bytes, and the text that one stands for.
TASK_SAMPLE, RANGE_SAMPLE, WINDOW, EVERY = 2048, 16, 160, 4096
#: Bytes of a bound.
BOUND = 64
#: Entries that a range holds before equal ones are summed.
PENDING = 2_000_000

#: Upper case to lower, ends of pieces to line feeds, blanks to spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Stands between pieces; no byte of UTF-8.
END = b"\xff"


def tokens(text: str | None) -> list[bytes]:
    """Words of the pieces of a text, with ``END`` between pieces."""
    folded = (text or "").encode().translate(FOLD).replace(b"\n", b" \xff ")
    return [w for w in folded.split(b" ") if w]


def key_of(words) -> bytes:
    """Bytes that sort as the words do, a phrase before those that it begins."""
    return b"\0".join(w.replace(b"\0", b"\0\xff") for w in words)


class Transducer:
    """Acyclic automaton: state ``s`` has the transitions ``start[s]:start[s + 1]``.

    State 0 is final and has none; the last one is the start.  ``moves`` has a row
    (label, weight, target) per transition; labels number ``words`` from 1 in order.
    Weight 0: no phrase ends there.
    """

    def __init__(self, words: list[bytes], start: np.ndarray, moves: np.ndarray):
        self.words, self.start, self.moves = words, start, moves

    @classmethod
    def build(cls, words: list[bytes], keys: np.ndarray, weights: np.ndarray) -> Transducer:
        """Of sorted distinct phrases: rows of labels, 0 after the last word."""
        register, frozen, size = {b"": 0}, [b""], [0]
        depth = (keys > 0).sum(1)
        below, parents = b"", np.zeros(0, np.int64)
        for d in range(keys.shape[1], 0, -1):
            rows = np.nonzero(depth >= d)[0]
            prefix = keys[rows, :d]
            fresh = np.ones(len(rows), bool)
            if len(rows) > 1:
                fresh[1:] = (prefix[1:] != prefix[:-1]).any(1)
            first = rows[fresh]
            if d == keys.shape[1]:
                target = np.zeros(len(first), np.int64)
            else:
                # the transitions below, in phrase order, are cut where their prefix ends
                cuts = np.searchsorted(parents, np.append(first, len(keys)))
                target = cls._freeze(below, cuts, register, frozen, size)
            moves = np.stack([keys[first, d - 1], np.where(depth[first] == d, weights[first], 0), target], 1)
            below, parents = np.ascontiguousarray(moves, np.int64).tobytes(), first
        cls._freeze(below, np.array([0, len(below) // 24]), {}, frozen, size)
        return cls(words, np.cumsum([0, *size]), np.frombuffer(b"".join(frozen), np.int64).reshape(-1, 3))

    @staticmethod
    def _freeze(moves: bytes, cuts: np.ndarray, register: dict, frozen: list, size: list) -> np.ndarray:
        """States of consecutive transitions: one seen before, or a new one."""
        out = []
        cuts = (cuts * 24).tolist()
        for a, b in zip(cuts, cuts[1:]):
            state = moves[a:b]
            found = register.get(state)
            if found is None:
                found = register[state] = len(frozen)
                frozen.append(state)
                size.append((b - a) // 24)
            out.append(found)
        return np.array(out, np.int64)

    @classmethod
    def of(cls, weights: dict[tuple, int]) -> Transducer:
        """Of phrases as tuples of words."""
        words = sorted({w for phrase in weights for w in phrase})
        label = {w: i + 1 for i, w in enumerate(words)}
        width = max(map(len, weights))
        order = sorted(weights)
        keys = np.array([[*(label[w] for w in p), *[0] * (width - len(p))] for p in order], np.int64)
        return cls.build(words, keys, np.array([weights[p] for p in order], np.int64))

    def entries(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(labels, weight) of every phrase with a weight, breadth first."""
        keys, weights = [], []
        path = np.zeros((1, 0), np.int64)
        state = np.array([len(self.start) - 2])
        for _ in range(width):
            many = self.start[state + 1] - self.start[state]
            row = np.repeat(np.arange(len(state)), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.start[state][row]
            moves = self.moves[at]
            path, state = np.concatenate([path[row], moves[:, :1]], 1), moves[:, 2]
            has = moves[:, 1] > 0
            keys.append(np.pad(path[has], ((0, 0), (0, width - path.shape[1]))))
            weights.append(moves[has, 1])
        return np.concatenate(keys), np.concatenate(weights)

    def phrases(self, path: tuple = (), state: int | None = None) -> Iterator[tuple[tuple, int]]:
        """(words, weight), in order."""
        state = len(self.start) - 2 if state is None else state
        for label, weight, target in self.moves[self.start[state]:self.start[state + 1]].tolist():
            phrase = (*path, self.words[label - 1])
            if weight:
                yield phrase, weight
            if target:
                yield from self.phrases(phrase, target)

    def dump(self) -> bytes:
        sizes = np.fromiter(map(len, self.words), np.uint32, len(self.words))
        counts = self.start[1:] - self.start[:-1]
        body = b"".join([sizes.tobytes(), b"".join(self.words), counts.astype(np.uint32).tobytes(),
                         self.moves[:, 0].astype(np.uint32).tobytes(), self.moves[:, 2].astype(np.uint32).tobytes(),
                         np.ascontiguousarray(self.moves[:, 1]).tobytes()])
        head = struct.pack("<IIII", len(self.words), int(sizes.sum()), len(counts), len(self.moves))
        return head + zlib.compress(body, 1)

    @classmethod
    def load(cls, raw: bytes) -> Transducer:
        n_words, n_bytes, n_states, n_moves = struct.unpack_from("<IIII", raw)
        body = zlib.decompress(raw[16:])
        ends = np.cumsum(np.frombuffer(body, np.uint32, n_words).astype(np.int64)) + 4 * n_words
        cuts = [4 * n_words, *ends.tolist()]
        words = [body[a:b] for a, b in zip(cuts, cuts[1:])]
        at = 4 * n_words + n_bytes
        start = np.concatenate([[0], np.cumsum(np.frombuffer(body, np.uint32, n_states, at).astype(np.int64))])
        at += 4 * n_states
        label, target = (np.frombuffer(body, np.uint32, n_moves, at + 4 * n_moves * i).astype(np.int64) for i in (0, 1))
        weight = np.frombuffer(body[at + 8 * n_moves:], np.int64, n_moves)
        return cls(words, start, np.stack([label, weight, target], 1))

    def step(self, state: int, word_label: int) -> int:
        """Number of the transition with this label, -1 if there is none."""
        a, b = self.start[state], self.start[state + 1]
        at = a + np.searchsorted(self.moves[a:b, 0], word_label)
        return int(at) if at < b and self.moves[at, 0] == word_label else -1

    def compose(self, counts: Transducer) -> dict[tuple, int]:
        """Phrases of this one with the weights that ``counts`` gives them."""
        place = {w: i + 1 for i, w in enumerate(counts.words)}
        theirs = [0, *(place.get(w, 0) for w in self.words)]
        out, todo = {}, [((), len(self.start) - 2, len(counts.start) - 2)]
        while todo:
            path, mine, other = todo.pop()
            for label, weight, target in self.moves[self.start[mine]:self.start[mine + 1]].tolist():
                at = counts.step(other, theirs[label]) if theirs[label] else -1
                if at < 0:
                    continue
                phrase = (*path, self.words[label - 1])
                _, found, onward = counts.moves[at].tolist()
                if weight and found:
                    out[phrase] = found
                if target:
                    todo.append((phrase, target, onward))
        return out


class Union:
    """Sums the weights of equal paths of many transducers."""

    def __init__(self, width: int):
        self.width, self.words, self.keys, self.weights, self.held = width, {}, [], [], 0
        self.limit = PENDING

    def add(self, one: Transducer) -> None:
        numbered = np.array([0, *(self.words.setdefault(w, len(self.words) + 1) for w in one.words)])
        keys, weights = one.entries(self.width)
        self.keys.append(numbered[keys].astype(np.int32))
        self.weights.append(weights)
        self.held += len(weights)
        if self.held > self.limit:
            self.settle()
            self.limit = max(PENDING, 2 * self.held)

    def settle(self) -> None:
        keys, weights = np.concatenate(self.keys), np.concatenate(self.weights)
        order = np.lexsort(keys.T[::-1])
        keys, weights = keys[order], weights[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]).any(1))
        self.keys, self.weights = [keys[fresh]], [np.add.reduceat(weights, np.nonzero(fresh)[0])]
        self.held = int(fresh.sum())

    def result(self, least: int) -> Transducer | None:
        """The phrases of at least this weight."""
        self.settle()
        keep = self.weights[0] >= least
        return sorted_transducer(list(self.words), self.keys[0][keep], self.weights[0][keep]) if keep.any() else None


def sorted_transducer(words: list[bytes], keys: np.ndarray, weights: np.ndarray) -> Transducer:
    """Transducer of phrases with labels numbered in any order."""
    used = np.unique(keys)
    used = used[used > 0]
    mine = sorted((words[i - 1], i) for i in used.tolist())
    label = np.zeros(len(words) + 1, np.int64)
    label[[i for _, i in mine]] = np.arange(1, len(mine) + 1)
    keys = label[keys]
    order = np.lexsort(keys.T[::-1])
    return Transducer.build([w for w, _ in mine], keys[order], weights[order])


class Run:
    """Words of many texts of one language, counted as phrases."""

    def __init__(self, lang: bytes):
        self.lang, self.seen, self.ids, self.own = lang, defaultdict(), [], []
        self.seen.default_factory = self.seen.__len__
        self.seen[END]  # number 0

    def add(self, found: list[bytes], own: int) -> None:
        """Counts the phrases that begin in the first ``own`` words."""
        self.ids.append(np.fromiter(map(self.seen.__getitem__, found), np.int64, len(found)))
        self.own.append(np.arange(len(found)) < own)
        self.ids.append(np.zeros(1, np.int64))
        self.own.append(np.zeros(1, bool))

    def blocks(self, bounds: list[bytes], width: int) -> Iterator[tuple[int, int, bytes]]:
        """(range, words, transducer) of the run's phrases."""
        words = sorted(w for w in self.seen if w != END)
        rank = np.zeros(len(self.seen), np.int64)
        rank[[self.seen[w] for w in words]] = np.arange(1, len(words) + 1)
        ids = rank[np.concatenate(self.ids)]
        packed, whole = [], np.concatenate(self.own)
        phrase = np.zeros(len(ids), np.int64)
        for n in range(width):
            whole = whole[:len(ids) - n] & (ids[n:] > 0)
            phrase = phrase[:len(ids) - n] + (ids[n:] << BITS * (width - 1 - n))
            packed.append(phrase[whole])
        keys, counts = np.unique(np.concatenate(packed), return_counts=True)
        if not len(keys):
            return
        keys = np.stack([keys >> BITS * (width - 1 - n) & (1 << BITS) - 1 for n in range(width)], 1)

        def key(at: int) -> bytes:
            return key_of([self.lang, *(words[i - 1] for i in keys[at].tolist() if i)])

        at, end = 0, len(keys)
        number = bisect.bisect_right(bounds, key(0))
        while at < end:
            cut = end
            if number < len(bounds):
                cut = bisect.bisect_left(range(end), bounds[number], at, end, key=key)
            if cut > at:
                part, weights = keys[at:cut], counts[at:cut]
                used, labels = np.unique(part, return_inverse=True)
                shift = 0 if used[0] == 0 else 1
                made = Transducer.build([words[i - 1] for i in used[1 - shift:].tolist()],
                                        labels.reshape(part.shape) + shift, weights)
                yield number, int(weights[part[:, 1] == 0].sum()), made.dump()
                at = cut
            if at < end:
                number = max(number + 1, bisect.bisect_right(bounds, key(at)))


def sampled_windows(docs: DataFrame) -> tuple[list[bytes], int]:
    """A bounded sample of phrase keys over all texts, and the bytes of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, size = [], 0
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                size += len(raw)
                seed = zlib.crc32(raw)
                for n in range(0, len(raw), EVERY):
                    seed = zlib.crc32(struct.pack("<I", n // EVERY), seed)
                    at = n + seed % min(EVERY, len(raw) - n)
                    found = tokens(raw[at:at + WINDOW].decode("utf-8", "ignore"))[1:1 + MAX_WORDS]
                    if found and END not in found:
                        best.append((seed, key_of([lang.encode(), *found])[:BOUND]))
            if len(best) > 2 * TASK_SAMPLE:
                best = sorted(best)[:TASK_SAMPLE]
        best = sorted(best)[:TASK_SAMPLE]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(h for h, _ in best), None], pa.int64()), pa.array([*(k for _, k in best), None], pa.binary()),
             pa.array([*(0 for _ in best), size], pa.int64())], ["h", "key", "size"])

    found = docs.mapInArrow(run, "h long, key binary, size long").persist()
    try:
        size = found.agg(F.sum("size")).first()[0] or 0
        ranges = min(MAX_RANGES, 1 + size // RANGE_BYTES)
        rows = found.filter("h IS NOT NULL").orderBy("h", "key").limit(RANGE_SAMPLE * ranges).collect()
    finally:
        found.unpersist()
    keys = sorted(bytes(r.key) for r in rows)
    bounds = {keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else set()
    return sorted(bounds), size


def phrase_runs(docs: DataFrame, bounds: list[bytes], width: int) -> DataFrame:
    """(range, lang, words, block) of every task's runs."""
    def rows(runs: dict) -> Iterator[pa.RecordBatch]:
        for lang, one in runs.items():
            found = list(one.blocks(bounds, width))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, *_ in found], pa.int32()), pa.array([lang] * len(found), pa.string()),
                     pa.array([n for _, n, _ in found], pa.int64()), pa.array([b for *_, b in found], pa.binary())],
                    ["range", "lang", "words", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, Run] = {}
        held = 0
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = tokens(text)
                # a very long text is cut; phrases over a cut belong to the part that they begin in
                for at in range(0, len(found), PIECE_TOKENS):
                    if lang not in runs:
                        runs[lang] = Run(lang.encode())
                    own = min(PIECE_TOKENS, len(found) - at)
                    runs[lang].add(found[at:at + PIECE_TOKENS + width - 1], own)
                    held += own
                    if held >= RUN_TOKENS:
                        yield from rows(runs)
                        runs, held = {}, 0
        yield from rows(runs)

    return docs.mapInArrow(run, "range int, lang string, words long, block binary")


def ranged(df: DataFrame, by: str, *order: str) -> DataFrame:
    """One task a share of the ranges, each range's rows together and in order."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, by).sortWithinPartitions(by, *order)


def united(runs: DataFrame, width: int, least: int) -> DataFrame:
    """(range, lang, words, block): the runs of each range as one transducer, null if nothing stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, one, words = None, Union(width), 0

        def row() -> pa.RecordBatch:
            made = one.result(least)
            return pa.RecordBatch.from_arrays(
                [pa.array([group[0]], pa.int32()), pa.array([group[1]], pa.string()), pa.array([words], pa.int64()),
                 pa.array([made and made.dump()], pa.binary())], ["range", "lang", "words", "block"])

        for batch in batches:
            for i in range(batch.num_rows):
                at, lang, n, block = (c[i].as_py() for c in batch.columns)
                if (at, lang) != group:
                    if group:
                        yield row()
                    group, one, words = (at, lang), Union(width), 0
                one.add(Transducer.load(block))
                words += n
        if group:
            yield row()

    return runs.mapInArrow(run, "range int, lang string, words long, block binary")


def inside(phrase: tuple) -> Iterator[tuple]:
    """All shorter phrases whose words lie contiguously in this one."""
    for n in range(1, len(phrase)):
        for i in range(len(phrase) - n + 1):
            yield phrase[i:i + n]


def requests(counts: DataFrame, bounds: list[bytes]) -> DataFrame:
    """(range, origin, lang, block): what each range's candidates ask of each range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, lang, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked: dict[int, dict] = defaultdict(dict)
                for phrase, count in Transducer.load(block).phrases():
                    for part in inside(phrase):
                        to = asked[bisect.bisect_right(bounds, key_of([lang.encode(), *part]))]
                        to[part] = max(to.get(part, 0), count) if len(part) > 1 else 1
                rows = [(to, Transducer.of(parts).dump()) for to, parts in asked.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([to for to, _ in rows], pa.int32()), pa.array([origin] * len(rows), pa.int32()),
                     pa.array([lang] * len(rows), pa.string()), pa.array([b for _, b in rows], pa.binary())],
                    ["range", "origin", "lang", "block"])

    return counts.select("range", "lang", "block").mapInArrow(
        run, "range int, origin int, lang string, block binary")


#: Rows of a range: its own counts, answers to its requests, claims of others on its phrases.
OWN, ANSWER, CLAIM = -1, 0, 1


def answers(asked: DataFrame) -> DataFrame:
    """(range, lang, kind, block) from rows (range, origin, lang, block) sorted with a range's own counts first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, counts, claims = None, {}, {}

        def rows(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([m[i] for m in made], t) for i, t in enumerate(
                    (pa.int32(), pa.string(), pa.int32(), pa.binary()))], ["range", "lang", "kind", "block"])

        def claimed() -> pa.RecordBatch:
            return rows([(group, lang, CLAIM, Transducer.of(c).dump()) for lang, c in claims.items() if c])

        for batch in batches:
            for i in range(batch.num_rows):
                at, origin, lang, block = (c[i].as_py() for c in batch.columns)
                if at != group:
                    if group is not None:
                        yield claimed()
                    group, counts, claims = at, {}, defaultdict(dict)
                one = Transducer.load(block)
                if origin == OWN:
                    counts[lang] = one
                    continue
                found = one.compose(counts[lang])
                for phrase, weight in one.phrases():
                    if len(phrase) > 1:
                        claims[lang][phrase] = max(claims[lang].get(phrase, 0), weight)
                yield rows([(origin, lang, ANSWER, Transducer.of(found).dump())])
        if group is not None:
            yield claimed()

    return asked.mapInArrow(run, "range int, lang string, kind int, block binary")


def scored(known: DataFrame, covered: int, top: int) -> DataFrame:
    """(lang, phrase, a, l, r, score): the best ``top`` of each range, from rows (range, lang, kind, block)."""
    def best(counts: Transducer, parts: dict, claims: dict) -> list[tuple]:
        out = []
        for phrase, a in counts.phrases():
            if len(phrase) < 2 or 100 * claims.get(phrase, 0) >= covered * a:
                continue
            cuts = []
            for k in range(1, len(phrase)):
                left, right = parts[phrase[:k]], parts[phrase[k:]]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.append((b" ".join(phrase).decode(), a, left, right, score))
        return sorted(out, key=lambda r: (-r[4], -r[1], r[0].encode()))[:top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, counts, parts, claims = None, None, {}, {}

        def rows() -> pa.RecordBatch:
            made = best(counts, parts, claims)
            return pa.RecordBatch.from_arrays(
                [pa.array([group[1]] * len(made), pa.string()), *(pa.array([m[i] for m in made], t) for i, t in enumerate(
                    (pa.string(), *[pa.int64()] * 4)))], ["lang", "phrase", "a", "l", "r", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                at, lang, kind, block = (c[i].as_py() for c in batch.columns)
                if (at, lang) != group:
                    if group:
                        yield rows()
                    group, parts, claims = (at, lang), {}, {}
                one = Transducer.load(block)
                if kind == OWN:
                    counts = one
                else:
                    (parts if kind == ANSWER else claims).update(one.phrases())
        if group:
            yield rows()

    return known.mapInArrow(run, "lang string, phrase string, a long, l long, r long, score long")


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS,
                      least: int = MIN_COUNT, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The first ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score."""
    if not 2 <= max_words <= 63 // BITS:
        raise ValueError("phrases of two or three words")
    slim = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"),
                       F.col(quoted(text)).cast("string").alias("text"))
    bounds, _ = sampled_windows(slim)
    runs = phrase_runs(slim, bounds, max_words).repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "lang")
    merged = written(united(runs, max_words, least), "phrase-counts")
    counts = merged.filter("block IS NOT NULL")
    own = counts.select("range", F.lit(OWN).alias("origin"), "lang", "block")
    asked = written(requests(counts, bounds), "phrase-requests").unionByName(own)
    told = answers(ranged(asked, "range", "origin", "lang"))
    known = ranged(own.select("range", "lang", F.col("origin").alias("kind"), "block").unionByName(told),
                   "range", "lang", "kind")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored(known, covered, top).withColumn("rank", F.row_number().over(order).cast("long"))
    words = merged.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.filter(F.col("rank") <= top).join(words, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
