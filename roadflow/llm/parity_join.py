"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, each known by its XXH64 value.  A
sketch has ``K`` words of 64 bits; every shingle flips one bit of one word, so equal
shingles of two sets cancel, and the Hamming distance of two sketches is at most the
symmetric difference of the sets.  Sets of sizes a and b that link at T percent
differ by at most D = (100 - T)(a + b) / (100 + T) shingles, so at least K - D
sketch words are equal (pigeonhole).

Sets are banded by size, a factor of two each; ``K`` is fixed for a band.  A set
emits the keys (band, word number, word) of its D + 1 heaviest words by set bits, D
for the largest partner it can have there.  Of the equal words of a linking pair the
heaviest has K - D - 1 lighter ones below it in both sets, so both emit it: no link
is lost, and light words, which frequent shingles would make hot, are left out.  Sets
near a band's lower edge also emit to the band below, for partners there.

Pairs that share a key are candidates.  Within a key the smallest set is the pivot; a
set is first paired with one pivot alone, that of most of its keys.  A second sketch, of
one to two bits a shingle, rejects pairs at a Hamming distance over D, and the whole
sets of the others are intersected, streamed past a pivot's set; pivots with many members
are split over groups.

Keys whose sets are then all connected are done: a group of copies costs one check a
member.  In the others the sets of different components are compared.  Few sets meet in
a join.  More are compared by their sketches inside tasks, tile by tile, and only pairs
that the sketches do not reject leave a task: in one pass each set's closest, which are
verified and connected, in the next all that are then still apart.  A pair leaves in the
first of the keys that both sets have, once.  So each pair with a
common key is rejected by its sketches, verified, or already connected.  Equal sets are
one set.

Defined results: null, empty and blank texts have the empty set and are linked with
nothing; fewer words than the shingle length make one shingle; repeated rows link
(unless empty); null ids are ignored when the smallest id is chosen, a component of
null ids only has a null id.  Shingles, and whole sets, are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadflow.llm.shared import components, map_texts, quoted, slices, written
from roadflow.operators.broadcast import MAX_BROADCAST_ROWS

SHINGLE_WORDS = 4
#: Linked at this share of common shingles, in percent.
PERCENT = 85
SEED = 42
#: Sketch words beyond the least number, as a part of it: the lightest that are left out.
SPARE = 4
#: Members that one group compares with a pivot, or tasks with one another.
MEMBERS = 512
#: Sets of a key that meet in a join.
FEW = 8


def shingle_set(text: str | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    width = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)),
                                 np.uint64, len(first)))


def difference(total: int, percent: int) -> int:
    """Most shingles by which linked sets of this total size differ."""
    return total * (100 - percent) // (100 + percent)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of whole numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def sketch(hashes: np.ndarray, k: int) -> np.ndarray:
    """``k`` words of 64 bits; each shingle flips one bit."""
    h = mixed(hashes)
    out = np.zeros(k, np.uint64)
    np.bitwise_xor.at(out, ((h >> np.uint64(6)) % np.uint64(k)).astype(np.int64),
                      np.uint64(1) << (h & np.uint64(63)))
    return out


def words_in_band(band: int, percent: int) -> int:
    """Sketch words of the band of sizes 2^band to 2^(band+1) - 1 and their partners above."""
    top = (2 << band) - 1
    most = difference(top + top * 100 // percent, percent) + 1
    return most + -(-most // SPARE) if most > 1 else 1


def band_keys(hashes: np.ndarray, band: int, largest: int, percent: int) -> np.ndarray:
    """Keys of one set in one band: its heaviest words, enough for partners up to ``largest``."""
    k = words_in_band(band, percent)
    made = sketch(hashes, k)
    number = np.arange(k)
    heaviest = np.argsort(np.bitwise_count(made).astype(np.int64) * k + number)[-(
        difference(len(hashes) + largest, percent) + 1):]
    tag = np.uint64(band << 40) + heaviest.astype(np.uint64)
    return mixed(made[heaviest] ^ mixed(tag + np.uint64(1)))


def set_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All keys of a set: of its own band, and of the band below where a partner may lie there."""
    n = len(hashes)
    if not n:
        return hashes
    band = n.bit_length() - 1
    keys = [band_keys(hashes, band, n * 100 // percent, percent)]
    below = (1 << band) - 1
    if band and below * 100 >= n * percent:
        keys.append(band_keys(hashes, band - 1, below, percent))
    return np.concatenate(keys)


def folded(hashes: np.ndarray) -> np.ndarray:
    """Sketch of one to two bits a shingle; the halves of one of twice the bits, put together by XOR, are it."""
    words = max(1, (2 << len(hashes).bit_length() - 1) // 64) if len(hashes) else 1
    h = mixed(hashes ^ np.uint64(SEED))
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, ((h >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64),
                      np.uint64(1) << (h & np.uint64(63)))
    return out


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance of two folded sketches, in the bits of the smaller."""
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def set_id(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def small(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and broadcast where its counted rows are few enough."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= MAX_BROADCAST_ROWS else kept


def with_sets(docs: DataFrame, id_col: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(id, tag, sid, n_shingles, keys, fold) of every row; copies met again by a task carry no keys.

    ``tag`` is a hash of the text: with the id it names the row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            sids, sizes, keys, folds = [], [], [], []
            for t in part.column(2).to_pylist():
                made = shingle_set(t, shingle)
                sid = set_id(made)
                sids.append(sid)
                sizes.append(len(made))
                keys.append(None if sid in seen else set_keys(made, percent).view(np.int64))
                folds.append(None if sid in seen else folded(made).tobytes())
                seen.add(sid)
            if len(seen) > 1_000_000:  # only saves work: keys of a set may come twice
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(folds, pa.binary())],
                [id_col, "tag", "sid", "n_shingles", "keys", "fold"])

    kind = docs.schema[id_col].dataType.simpleString()
    return tagged(docs, id_col, text).withColumnRenamed("__id", id_col).mapInArrow(
        run, f"{quoted(id_col)} {kind}, tag long, sid long, n_shingles long, keys array<long>, fold binary")


def tagged(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    whole = F.col(quoted(text)).cast("string")
    return docs.select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(whole).alias("tag"), whole.alias("__t"))


def shared_keys(sets: DataFrame) -> DataFrame:
    """(key, sid, size, pivot, pivot_size) of the keys that several sets have; the pivot is the smallest.

    The neighbours in a key and its running first row tell, so a key of any size streams by.
    """
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_key = Window.partitionBy("key").orderBy("sid")
    running = in_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sets.select("sid", "size", F.explode("keys").alias("key")).repartition(tasks, "key")
    rows = rows.withColumn("p", F.first(F.struct("sid", "size")).over(running)).withColumn(
        "before", F.lag("sid").over(in_key)).withColumn("after", F.lead("sid").over(in_key))
    return rows.filter("before IS NOT NULL OR after IS NOT NULL").select(
        "key", "sid", "size", F.col("p.sid").alias("pivot"), F.col("p.size").alias("pivot_size"))


def first_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(pivot, sid, slack): every set with the pivot of most of its keys."""
    pairs = rows.filter("sid != pivot").filter(
        F.least("size", "pivot_size") * 100 >= F.greatest("size", "pivot_size") * percent).groupBy(
        "pivot", "sid", "size", "pivot_size").agg(F.count(F.lit(1)).alias("common"))
    best = pairs.groupBy("sid").agg(F.min_by(F.struct("pivot", "size", "pivot_size"),
                                             F.struct(-F.col("common"), F.col("pivot"))).alias("p"))
    return best.select("p.pivot", "sid", ((F.col("p.size") + F.col("p.pivot_size")) * (100 - percent)).alias("slack"))


def plausible(pairs: DataFrame, folds: DataFrame, percent: int) -> DataFrame:
    """The rows (pivot, sid, slack) whose sketches are at most slack / (100 + percent) apart."""
    own = folds.select("sid", F.col("fold").alias("__f"))
    of_pivot = folds.select(F.col("sid").alias("pivot"), F.col("fold").alias("__g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slack, mine, theirs = (c.to_pylist() for c in batch.columns[-3:])
            keep = [distance(np.frombuffer(f, np.uint64), np.frombuffer(g, np.uint64)) * (100 + percent) <= d
                    for d, f, g in zip(slack, mine, theirs, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["pivot", "sid"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(own, "sid").join(of_pivot, "pivot").select("pivot", "sid", "slack", "__f", "__g")
    return both.mapInArrow(run, "pivot long, sid long")


def intersect(percent: int):
    """Linked (a, b) of rows (pivot, part, member, sid, hashes) sorted with each pivot's own set first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, base = None, None
        for batch in batches:
            left, right = [], []
            for i in range(batch.num_rows):
                pivot, part, member, sid, raw = (c[i].as_py() for c in batch.columns)
                hashes = np.frombuffer(raw, np.uint64)
                if not member:
                    group, base = (pivot, part), hashes
                elif group == (pivot, part):
                    common = len(np.intersect1d(base, hashes, assume_unique=True))
                    if 100 * common >= percent * (len(base) + len(hashes) - common):
                        left.append(pivot)
                        right.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those distinct ``pairs`` (pivot, sid) whose whole sets link."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    whole = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                         F.lit(0).alias("member"), F.col("pivot").alias("sid"))
    members = pairs.join(parts, "pivot").select(
        "pivot", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"), "sid")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roles = small(whole.union(members), "parity-roles")  # numbers only; sets move to their pivots once
    rows = hashes.join(roles, "sid").select("pivot", "part", "member", "sid", "hashes")
    return rows.repartition(tasks, "pivot", "part").sortWithinPartitions("pivot", "part", "member").mapInArrow(
        intersect(percent), "a long, b long").distinct()


def whole_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame, id_col: str, text: str,
               shingle: int) -> DataFrame:
    """(sid, hashes) of the sets in ``pairs``, made again from their texts.

    Texts move by id and tag, which may both repeat: repeated rows give a set several times.
    """
    wanted = pairs.select("sid").union(pairs.select(F.col("pivot").alias("sid"))).distinct()
    chosen = sets.filter("keys IS NOT NULL").join(wanted, "sid").select(
        F.col(quoted(id_col)).alias("__low"), F.col("tag").alias("__tag"), "sid").dropDuplicates(["sid"])
    chosen = small(chosen, "parity-texts")  # a few numbers a row; texts move where they are too many to send
    same = F.col("__id").eqNullSafe(F.col("__low")) & (F.col("tag") == F.col("__tag"))
    texts = tagged(docs, id_col, text).join(chosen, same).select("sid", "__t")

    def fn(rows):
        made = [shingle_set(t, shingle) for t in rows]
        return [[set_id(m) for m in made], [m.tobytes() for m in made]]

    made = map_texts(texts, "__t", fn, [("own", "long"), ("hashes", "binary")], ["sid"])
    return made.filter("own = sid").drop("own")


def connected(edges: DataFrame) -> DataFrame:
    """(sid, root) of the sets that an edge names."""
    return written(components(edges).select(F.col("node").alias("sid"), "root"), "parity-roots")


def earlier_keys(key: int, lists: list[list[int]]) -> np.ndarray:
    """Rows x words: a bit for every key before ``key`` that several of the sorted ``lists`` have."""
    kept = [np.array(x, np.int64) for x in lists]
    kept = [x[x < key] for x in kept]
    row = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
    _, number, count = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
    shared = count[number] > 1
    place = (np.cumsum(count > 1) - 1)[number[shared]]
    out = np.zeros((len(kept), max(1, -(-int((count > 1).sum()) // 64))), np.uint64)
    np.bitwise_or.at(out, (row[shared], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return out


def tile_pairs(percent: int, closest: bool):
    """Plausible (pivot, sid) of rows (key, one, two, side, sid, root, size, fold, keys), a tile pair's rows together.

    ``closest``: of each set only the pair with least distance.  ``keys``: all keys that the
    set is compared in; a pair is left to the first key that both have, before the closest is
    chosen: a set with a linked partner names one at least.
    """
    def made(key: int, rows: list[tuple], two: bool) -> tuple[np.ndarray, np.ndarray]:
        sides, sids, roots, sizes = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        least = min(len(r[4]) for r in rows) // 8
        folds = np.empty((len(rows), least), np.uint64)
        for i, r in enumerate(rows):
            fold = np.frombuffer(r[4], np.uint64)
            while len(fold) > least:
                fold = fold[:len(fold) // 2] ^ fold[len(fold) // 2:]
            folds[i] = fold
        before = earlier_keys(key, [r[5] for r in rows])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        every = np.arange(len(rows))
        for i in every if closest else every[sides == 0]:
            j = every[sides != sides[i]] if two else every if closest else every[i + 1:]
            total, low = sizes[i] + sizes[j], np.minimum(sizes[i], sizes[j])
            j = j[(roots[j] != roots[i]) & (low * 100 >= (total - low) * percent)]
            gap = np.bitwise_count(folds[j] ^ folds[i]).sum(1, dtype=np.int64)
            near = gap * (100 + percent) <= (sizes[i] + sizes[j]) * (100 - percent)
            near[near] = ~(before[j[near]] & before[i]).any(1)
            j, gap = j[near], gap[near]
            if closest and len(j):
                j = j[np.argmin(gap):][:1]
            left.append(np.minimum(sids[i], sids[j]))
            right.append(np.maximum(sids[i], sids[j]))
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)  # two may name each other
        return pairs[0], pairs[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            pairs = made(group[0], rows, group[1] != group[2])
            if len(pairs[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["pivot", "sid"])

        group, rows = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                *at, side, sid, root, size, fold, keys = (c[i].as_py() for c in batch.columns)
                if at != group:
                    if rows:
                        yield from out()
                    group, rows = at, []
                rows.append((side, sid, root, size, fold, keys))
        if rows:
            yield from out()

    return run


def crossing(rows: DataFrame, some: DataFrame, roots: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Plausible (pivot, sid) pairs of sets with a common key that have different ``roots``."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_key, of_set = Window.partitionBy("key"), Window.partitionBy("sid")
    # short keys, as a set's travel with it; the sets of keys that become equal are compared together
    rooted = rows.select(F.hash("key").alias("key"), "sid", "size").join(roots, "sid", "left").withColumn(
        "root", F.coalesce("root", "sid"))
    rooted = rooted.repartition(tasks, "key").distinct().withColumn("low", F.min("root").over(of_key)).withColumn(
        "high", F.max("root").over(of_key)).withColumn("met", F.count(F.lit(1)).over(of_key)).filter("low != high")
    rooted = written(rooted.select("key", "sid", "root", "size", "met"), "parity-rooted")
    few = rooted.filter(F.col("met") <= FEW)
    other = few.select("key", F.col("sid").alias("pivot"), F.col("root").alias("root2"), F.col("size").alias("size2"))
    pairs = few.join(other, "key").filter("pivot < sid AND root != root2").filter(
        F.least("size", "size2") * 100 >= F.greatest("size", "size2") * percent).select(
        "pivot", "sid", ((F.col("size") + F.col("size2")) * (100 - percent)).alias("slack")).distinct()
    tiles = F.ceil(F.col("met") / MEMBERS).cast("int")
    many = rooted.filter(F.col("met") > FEW).withColumn("keys", F.sort_array(F.collect_list("key").over(of_set))).join(
        some, "sid")
    many = many.withColumn("mine", F.pmod(F.xxhash64("sid"), tiles).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), tiles - 1))).select(
        "key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "sid", "root", "size", "fold", "keys")
    tiled = many.repartition(tasks, "key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(
        tile_pairs(percent, closest), "pivot long, sid long")
    return written(plausible(pairs, some, percent).union(tiled).distinct(), "parity-pairs")


def links(docs: DataFrame, sets: DataFrame, id_col: str, text: str, shingle: int = SHINGLE_WORDS,
          percent: int = PERCENT) -> DataFrame:
    """(sid, root) of all sets that link with another; a link is verified on whole sets."""
    def checked(pairs: DataFrame) -> DataFrame:
        return verified(pairs, whole_sets(docs, sets, pairs, id_col, text, shingle), percent)

    # a set that several tasks met comes several times here
    keyed = sets.filter("keys IS NOT NULL AND n_shingles > 0").select(
        "sid", F.col("n_shingles").cast("int").alias("size"), "keys", "fold")
    rows = written(shared_keys(keyed), "parity-rows")
    some = written(keyed.select("sid", "fold").join(rows.select("sid").distinct(), "sid").dropDuplicates(["sid"]),
                   "parity-folds")
    roots = connected(checked(written(plausible(first_pairs(rows, percent), some, percent), "parity-pairs")))
    for closest in (True, False):
        rest = crossing(rows, some, roots, percent, closest)
        if rest.isEmpty():
            break
        # the links found before stand as their stars
        roots = connected(checked(rest).union(roots.select(F.col("root").alias("a"), F.col("sid").alias("b"))))
        # a set without a plausible partner has none in the next pass either
        left = rest.select("sid").union(rest.select(F.col("pivot").alias("sid"))).distinct()
        rows = rows.join(small(left, "parity-left"), "sid")
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``."""
    sets = written(with_sets(docs, id_col, text, shingle, percent), "parity-keys")
    roots = links(docs, sets, id_col, text, shingle, percent)
    own = F.col(quoted(id_col))
    rows = sets.select(own, "sid", "n_shingles")
    low = rows.filter("n_shingles > 0").groupBy("sid").agg(F.min(own).alias("low"))
    rooted = low.join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "low")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = written(rooted.join(named, "root").select("sid", "component_id"), "parity-classes")
    return rows.join(classes, "sid", "left").select(
        own, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(own).alias("component_id"))
