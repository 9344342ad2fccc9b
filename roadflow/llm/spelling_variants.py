"""Spelling variants grouped by blocked Gram matrices of letter counts.

Words one inserted, deleted or replaced letter apart have letter-count vectors at
a squared distance of at most two.  Words are blocked by length and by the counts
of eight letter groups.  A replacement or an insertion takes one letter out of the
longer (or either) word, so two near words share a block of "counts less one
letter": every word goes to one block for each group that it has letters of, and
to the block of its own counts as the shorter word of an insertion.  A block thus
holds words of two adjacent lengths.  Per block a NumPy product of the letter
counts gives all squared distances, |x|^2 + |y|^2 - 2xy; pairs at most two apart
are verified letter by letter.  Only near pairs leave a task.

Blocks of more than ``TILE`` words are cut into tiles; each pair of tiles is a
group of its own, so a hot block is spread over tasks and memory stays bounded by
two tiles, whatever the block holds.

Defined results: null and empty texts have no words; a null id is written as the
empty string where ids enter a hash; words are counted over all rows, repeated
rows included; ties go to the smallest word in code-point order; no word gives an
empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.shared import quoted, slices
from roadflow.session import cut_lineage

MIN_CHARS, MIN_TIMES = 7, 2
#: A form must be this many times as frequent as its variant.
FORM_TIMES = 10
#: A run whose hash this divides loses one letter.
DROP_EVERY = 31
#: Words of a block that are multiplied at once.
TILE = 1024
#: Distinct runs that a task counts before it hands them on.
COUNTED = 400_000
GROUPS = 8
RUN = re.compile(rb"[A-Za-z\xc0-\xff]+")
#: Letters of Latin text by falling frequency, dealt over the groups; others by code.
ORDER = b"etaoinshrdlcumwfgypbvkjxqz"
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)])
GROUP = np.array([ORDER.index(c) % GROUPS if c < 128 else c % GROUPS for c in LETTERS.tolist()])


def variants(text: str | None, doc_id: object) -> Counter:
    """Words of one text with their counts, one letter dropped where the hash says so."""
    # every code point becomes one byte; those beyond Latin-1 become '?', no letter
    runs = Counter(r.lower() for r in RUN.findall((text or "").encode("latin-1", "replace")) if len(r) >= MIN_CHARS)
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= MIN_CHARS:
            out[run] += n
    return out


def count_words(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(word, n): counted in each task, summed after the shuffle."""
    def emit(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches):
            for doc, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen.update(variants(whole, doc))
                if len(seen) >= COUNTED:
                    yield emit(seen)
                    seen = Counter()
        yield emit(seen)

    rows = docs.select(F.col(quoted(id_col)), F.col(quoted(text)).cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TIMES)


def counts_of(words: list[bytes]) -> np.ndarray:
    """Letter counts, one row a word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(b"".join(words), np.uint8)
    column = np.searchsorted(LETTERS, codes)
    flat = np.bincount(np.repeat(np.arange(len(words)), sizes) * len(LETTERS) + column,
                       minlength=len(words) * len(LETTERS))
    return flat.reshape(len(words), len(LETTERS)).astype(np.float64)


def blocks(words: DataFrame) -> DataFrame:
    """(size, key, part, word, n): a word's blocks.

    ``size`` is the longer length of the block.  ``part`` is -1 for the shorter word of an
    insertion, else twice the group a letter is taken from, plus one if it is the word's
    first group: words of equal counts meet in several blocks and are compared in that one.
    """
    dealt = (GROUP[:, None] == np.arange(GROUPS)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(7).integers(1, 1 << 62, GROUPS, np.int64)  # one fixed linear hash
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            raw = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            sums = (counts_of(raw) @ dealt).astype(np.int64)
            sizes = sums.sum(1)
            with np.errstate(over="ignore"):
                own = (sums * weights).sum(1)
                less = own[:, None] - weights
            row, group = np.nonzero(sums)
            first = group == np.argmax(sums > 0, axis=1)[row]
            every = np.arange(len(raw))
            rows = pa.array(np.concatenate([every, row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([sizes + 1, sizes[row]])),
                 pa.array(np.concatenate([own, less[row, group]])),
                 pa.array(np.concatenate([np.full(len(raw), -1), 2 * group + first]).astype(np.int32)),
                 batch.column(0).take(rows), batch.column(1).take(rows)], ["size", "key", "part", "word", "n"])

    return words.mapInArrow(run, "size long, key long, part int, word string, n long")


def letters(words: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)


def near_pairs(words: list[bytes], part: np.ndarray, side: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words one edit apart in one block.

    ``side`` 0 and 1 are the two tiles; within one tile all are 0.  Pairs of different
    lengths, and of one length, are taken between the sides.
    """
    short, long = np.nonzero(part < 0)[0], np.nonzero(part >= 0)[0]
    two = side.any()
    found = []

    def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = counts_of([words[i] for i in a]), counts_of([words[i] for i in b])
        gap = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
        i, j = np.nonzero(gap <= 2)
        return a[i], b[j]

    def parts(rows: np.ndarray) -> list[np.ndarray]:
        return [rows[side[rows] == s] for s in ((0, 1) if two else (0,))]

    by_short, by_long = parts(short), parts(long)
    # insertions: short of one side, long of the other (or of the one tile)
    for a, b in [(by_short[0], by_long[1]), (by_short[1], by_long[0])] if two else [(by_short[0], by_long[0])]:
        if len(a) and len(b):
            i, j = close(a, b)
            s, t = letters([words[k] for k in i], size - 1), letters([words[k] for k in j], size)
            head = np.logical_and.accumulate(s == t[:, :-1], axis=1).sum(1)
            tail = np.logical_and.accumulate((s == t[:, 1:])[:, ::-1], axis=1).sum(1)
            keep = head + tail >= size - 1
            found.append((i[keep], j[keep]))
    a, b = (by_long[0], by_long[1]) if two else (by_long[0], by_long[0])
    if len(a) and len(b):
        i, j = close(a, b)
        same = part[i] >> 1 == part[j] >> 1
        keep = ~same | (part[i] & 1 == 1)
        if not two:
            keep &= i < j
        i, j = i[keep], j[keep]
        keep = (letters([words[k] for k in i], size) != letters([words[k] for k in j], size)).sum(1) == 1
        found.append((i[keep], j[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) of sorted (size, key, one, two, tile, part, word, n) rows, both ways."""
    def made(size: int, rows: list[tuple]) -> pa.RecordBatch | None:
        words = [r[2].encode("latin-1") for r in rows]
        i, j = near_pairs(words, np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), size)
        if not len(i):
            return None
        names = pa.array([r[2] for r in rows], pa.string())
        times = pa.array([r[3] for r in rows], pa.int64())
        a, b = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        return pa.RecordBatch.from_arrays([names.take(a), names.take(b), times.take(b)], ["word", "near", "near_n"])

    group, rows = None, []
    for batch in batches:
        for size, key, one, two, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (size, key, one, two) != group:
                if len(rows) > 1 and (out := made(group[0], rows)) is not None:
                    yield out
                group, rows = (size, key, one, two), []
            rows.append(rest)
    if len(rows) > 1 and (out := made(group[0], rows)) is not None:
        yield out


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n) for all pairs of distinct words one edit apart, both ways."""
    keyed = blocks(words)
    sizes = keyed.groupBy("size", "key").agg(F.count(F.lit(1)).alias("rows"))
    tiles = F.ceil(F.col("rows") / tile).cast("int")
    # a block of one word has no pair; tiles of larger blocks meet two by two
    placed = keyed.join(sizes.filter("rows > 1"), ["size", "key"]).withColumn("tiles", tiles)
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    met = placed.select("size", "key", "part", "word", "n", "mine", other)
    met = met.select("size", "key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"),
                     (F.col("mine") > F.col("other")).cast("int").alias("side"), "part", "word", "n")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = ["size", "key", "one", "two"]
    return met.repartition(tasks, *groups).sortWithinPartitions(*groups).mapInArrow(
        compare, "word string, near string, near_n long")


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root): follow ``form`` to the last, halving the way each round.

    A form is more frequent than its variant ``FORM_TIMES`` times over, so ways are acyclic and
    no longer than the logarithm of the largest count.
    """
    now, open_rows = forms.select("word", F.col("form").alias("root")), True
    while open_rows:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut_lineage(now.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        open_rows = not now.filter("moved").isEmpty()
        now = now.select("word", "root")
    return now


def group_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = cut_lineage(count_words(docs, id_col, text))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, tile).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= FORM_TIMES * F.col("n")
    known = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    roots = with_roots(known.filter(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
