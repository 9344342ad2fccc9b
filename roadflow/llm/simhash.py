"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of a text's
word shingles.  Fingerprints link at up to ``MAX_BITS`` differing bits.

Candidate search: 64 bits are cut into ``SEGMENTS`` = 3 segments.  Four
differing bits leave some segment with at most one of them, so each segment is
indexed once per bit with that bit as a wildcard: two fingerprints that differ
in at most one bit of a segment share a key.  That makes 64 keys a fingerprint,
whatever the corpus.  Only distinct fingerprints are indexed; copies share one.

Within a key the smallest fingerprint is the pivot.  Members within reach of the
pivot are compared with it alone, the others with all members of the key: two
members within reach of one pivot are connected through it, so their pair is
never made.  Joins on the key are ordinary equality joins, with the distance in
the join condition, that adaptive execution splits when a key is hot.

Defined results: no word (null, empty or blank text) has fingerprint zero and
links like any other; fewer words than the shingle length make one shingle of
all words; repeated rows share a component; null ids are ignored when the
smallest id is chosen (a component of null ids only has a null id).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadflow.llm.shared import components, map_texts
from roadflow.session import cut_lineage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: First bit and length of each segment, from the lowest bit.
SEGMENTS = [(0, 21), (21, 21), (42, 22)]
#: Hashes voted on at a time, to bound memory on very long texts.
VOTES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)),
                         np.uint64, len(first))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES):
        part = hashes[at:at + VOTES].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str, keep: list[str], name: str = "fp",
                     shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and the fingerprint as a signed long."""
    def fn(texts):
        made = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return [made.view(np.int64)]

    return map_texts(docs, text, fn, [(name, "long")], keep)


def first_key(difference: Column) -> Column:
    """Tag of the first key that two fingerprints with this XOR share, of all the keys they share."""
    tag = None
    for start, size in reversed(SEGMENTS):
        part = F.shiftrightunsigned(difference, start).bitwiseAND((1 << size) - 1)
        # the one differing bit, or the first where there is none
        bit = F.when(part == 0, F.lit(0)).otherwise(F.bit_count(part - 1))
        tag = bit + start if tag is None else F.when(F.bit_count(part) <= 1, bit + start).otherwise(tag)
    return tag


def links(fps: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS) -> DataFrame:
    """Verified edges (a, b) that connect what ``max_bits`` connects.

    ``fps`` holds distinct fingerprints.  Not all pairs are returned: of a pair
    whose first common key has a pivot within reach of both, the edge is left
    out, unless one of them is that pivot.  Both then link to the pivot, which is
    smaller, so by induction on the smaller member they are connected.  Every
    other pair is returned once, from its first common key.
    """
    if max_bits // len(SEGMENTS) > 1:
        raise ValueError("segments differ by more than one bit")
    keys = F.array(*(
        # segment with the wildcard bit cleared, tagged with the bit's number
        F.shiftrightunsigned(F.col(fp), start).bitwiseAND((1 << size) - 1 & ~(1 << bit))
        + (start + bit << 24)
        for start, size in SEGMENTS for bit in range(size)))
    # as many tasks as a shuffle has: every row becomes 64
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark takes the 64 rows of a fingerprint for one: without the hint, which every join on the key has, it would
    # broadcast keys of some 400,000 fingerprints, taken for less than 10 MB, through the driver.
    keyed = fps.repartition(tasks, fp).select(F.col(fp).alias("v"), F.explode(keys).alias("k")).hint("merge")
    pivots = keyed.groupBy("k").agg(F.min("v").alias("p"))

    def linked(x: str, y: str) -> Column:
        difference = F.col(x).bitwiseXOR(F.col(y))
        return (F.col(x) != F.col(y)) & (F.bit_count(difference) <= max_bits) & \
            (F.shiftrightunsigned("k", 24) == first_key(difference))

    tied = keyed.join(pivots, "k").filter(linked("v", "p")).select(F.col("p").alias("a"), F.col("v").alias("b"))
    # Every key has a pivot.  The outer join with its null test keeps this filter out of the join, so that the
    # rows of a key are compared with the pivot only once.
    far = keyed.join(pivots, "k", "left").filter(
        F.col("p").isNull() | (F.bit_count(F.col("v").bitwiseXOR(F.col("p"))) > max_bits)).select(
        "k", F.col("v").alias("w"), F.col("p").alias("p"))
    near = F.bit_count(F.col("v").bitwiseXOR(F.col("p"))) <= max_bits
    rest = far.join(keyed, "k").filter(linked("v", "w") & (near | (F.col("v") < F.col("w")))).select(
        F.col("v").alias("a"), F.col("w").alias("b"))
    return tied.union(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, ``fp`` (signed long), ``component_id``."""
    prints = cut_lineage(with_fingerprint(docs, text, [id_col], shingle=shingle))
    return assign(prints, id_col, max_bits)


def assign(prints: DataFrame, id_col: str, max_bits: int = MAX_BITS) -> DataFrame:
    return prints.join(classes(prints, id_col, max_bits), "fp").select(id_col, "fp", "component_id")


def classes(prints: DataFrame, id_col: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Each distinct fingerprint with its component: (fp, root, component_id)."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(cut_lineage(links(distinct.select("fp"), max_bits=max_bits)))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return cut_lineage(rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, one for each component.

    Fingerprints and ids alone are shuffled to find the components, and to count
    how many rows have the smallest id of each.  The texts move once, in the join
    on the fingerprint.  Only where that id is repeated (or null) are the rows
    with it ranked, and the first of them by content stays.
    """
    columns = list(docs.columns)
    prints = cut_lineage(with_fingerprint(docs, text, [id_col], shingle=shingle).withColumnRenamed(id_col, "__id"))
    found = classes(prints, "__id", max_bits)
    smallest = prints.join(found, "fp").filter(F.col("__id").eqNullSafe(F.col("component_id")))
    times = smallest.groupBy("root").agg(F.count(F.lit(1)).alias("__times"))
    found = cut_lineage(found.join(times, "root").select(
        F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__low"), "__times"))
    marked = with_fingerprint(docs, text, columns, "__fp", shingle)

    def lowest(part: DataFrame) -> DataFrame:
        return marked.join(part, "__fp").filter(F.col(id_col).eqNullSafe(F.col("__low")))

    rank = F.row_number().over(Window.partitionBy("__root").orderBy(F.xxhash64(text), F.col("__fp")))
    once = lowest(found.filter("__times = 1")).select(*columns)
    repeated = lowest(found.filter("__times > 1")).withColumn("__rank", rank).filter("__rank = 1").select(*columns)
    return once.unionByName(repeated)
