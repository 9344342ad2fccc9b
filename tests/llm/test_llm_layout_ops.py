"""Packing, WARC round trip, pipeline and entry point."""

import base64
import gzip
import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadflow.llm import fertility, randomness, simhash, vector_packing, warc_revisit
from roadflow.llm.fertility import fertility_rules

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioutrnshl") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_packing_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "one", "😀é", *(prose(rng, rng.randint(1, 900)) for _ in range(120)), prose(rng, 9000), "", "one"]
    docs = spark.createDataFrame([(i if i != 2 else None, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, length string")
    rows = vector_packing.pack_documents(docs).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            want.append((i if i != 2 else None, piece, a, b - a, crc))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
        assert sum(n for _, n in spans) <= 2048
    assert len(used) <= np.ceil(sum(r.length for r in rows) / 2048) * 1.03 + 1


def test_spelled_added_tokens_have_their_ids(spark):
    end = "<|endoftext|>"
    texts = [f"x {end} y", end, end * 3, f"{end}\n{end} a", f"é{end[:-1]} {end[1:]}", f"a<|{end}|>  {end}  b",
             f"{prose(random.Random(9), 3000)} {end} z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in vector_packing.token_pieces(docs, "text", ["doc_id"]).orderBy("doc_id", "piece").collect():
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert [got[i] for i in range(len(texts))] == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 600, 3000))[::-1]
    capacity = (1024, 5, 400_000)
    bins, offsets = vector_packing.best_fit(lengths, capacity, rule=rule)
    tokens, docs, cost = (np.bincount(bins, w) for w in (lengths, np.ones(3000), lengths * lengths))
    assert tokens.max() <= 1024 and docs.max() <= 5 and cost.max() <= 400_000
    # of pieces with more than half the cost no two share a bin; the rest needs its cost
    least = max(lengths.sum() / 1024, 3000 / 5, (lengths * lengths).sum() / 400_000, (lengths > 447).sum())
    assert bins.max() + 1 <= least * 1.2 + 1
    with pytest.raises(ValueError):
        vector_packing.best_fit(np.array([2000]), capacity)


def test_packing_in_groups(spark):
    pieces = spark.range(5000).select(F.col("id"), (F.col("id") % 700 + 1).alias("length"))
    rows = vector_packing.pack(pieces, order=["id"], group_pieces=500).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.sequence_id] += r.length
    assert len(rows) == 5000 and max(total.values()) <= 2048
    assert len(total) <= sum(total.values()) / 2048 * 1.02 + 10
    assert vector_packing.pack(pieces.limit(0), order=["id"]).count() == 0


def test_copies_of_a_piece_are_dealt_to_many_groups(spark):
    pieces = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"),
                                               F.lit(100).alias("length"))
    sizes = [r["count"] for r in vector_packing.dealt(pieces, ["id"], 10).groupBy("__group").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 400  # 300 a group
    alone = [sorted((r.id, r["__group"]) for r in vector_packing.dealt(p, ["id"], 10).filter("id is not null").collect())
             for p in (pieces, pieces.repartition(7))]
    assert alone[0] == alone[1]
    rows = vector_packing.pack(pieces, order=["id"], group_pieces=300).collect()
    assert len(rows) == 3000 and len({r.sequence_id >> 32 for r in rows if r.id is None}) == 10


def brute_warc(pages):
    digest = {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, _, h, *_ in pages}
    firsts = {}
    for i, d in digest.items():
        firsts[d] = min(i, firsts.get(d, i))
    return {i: (len((h or "").encode()), digest[i], "response" if firsts[digest[i]] == i else "revisit",
                None if firsts[digest[i]] == i else firsts[digest[i]]) for i, _, h, *_ in pages}


PAGES = [(5, "http://a/", "<p>same</p>", "x"), (3, "http://b/\r\nX: y", "<p>same</p>", "x"), (9, None, None, "x"),
         (2, "", "", "x"), (7, "http://c/", "é😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "x"),
         (8, "http://c/", "line\nline\r\n\r\n", "x"), (11, "http://d/", "z" * 300_000, "x"), (12, "e", "<p>same</p>", "x")]


def test_warc_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string").repartition(3)
    path = f"file://{tmp_path}/warc"
    rows = warc_revisit.round_trip(frame, path).collect()
    assert {r.page_id: tuple(r)[1:] for r in rows} == brute_warc(PAGES) and len(rows) == len(PAGES)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*"))
    assert whole.count(b"z" * 300_000) == 1 and whole.count(b"<p>same</p>") == 1
    records = warc_revisit.read_archives(spark, path).collect()
    ids = {r.page_id: r.record_id for r in records}
    assert len(set(ids.values())) == len(PAGES)
    assert all(r.refers_to_id == ids[brute_warc(PAGES)[r.page_id][3]] for r in records if r.record_type == "revisit")


def test_warc_edges(spark):
    schema = "page_id long, url string, html string"
    assert warc_revisit.round_trip(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (2, "u", "a"), (None, None, None)], schema)
    rows = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc_revisit.round_trip(twice).collect()), key=str)
    assert rows == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (2, "revisit", 1),
                           (None, "response", None)], key=str)
    small = [(i, "u", "ab") for i in range(4)]
    got = warc_revisit.round_trip(spark.createDataFrame(small, schema), min_bytes=3).collect()
    assert {r.record_type for r in got} == {"response"}


# ---------------------------------------------------------------- pipeline
def corpus(spark, tmp_path):
    rng = random.Random(3)
    clean = [prose(rng, rng.randint(60, 300)) for _ in range(60)]
    bench = [prose(rng, 20) for _ in range(5)]
    texts = [*clean, *clean[:10], clean[3] + " tail", "too short", None, "", "spam ham eggs " * 60]
    texts += [f"{prose(rng, 70)} {b.upper()} {prose(rng, 30)}" for b in bench]
    texts += [f"{prose(rng, 80)} password = abcdefgh{i:04d} {prose(rng, 9)}" for i in range(4)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, bench


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    texts, bench = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id: texts[r.doc_id] for r in fertility_rules(docs).filter("kept").collect()}
    assert {60 + i for i in range(10)} <= set(kept) and not {71, 72, 73, 74} & set(kept)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.filter(F.col("doc_id").isin(list(kept)))).collect()}
    kept = {i: t for i, t in kept.items() if found[i] == i}
    kept = {i: t for i, t in kept.items() if not any(b in t.lower() for b in bench)}
    import re
    kept = {i: re.sub(r"password = abcdefgh\d{4}", "[SECRET]", t) for i, t in kept.items()}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
            for i, t in kept.items()}
    assert {r.doc_id: r.ids_crc32 for r in rows} == want
    assert {i for i in range(60)} <= set(want)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    import corpus_pipeline

    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.dtypes == docs.dtypes and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, long and empty texts, extra columns with names that results use."""
    import corpus_pipeline

    rng = random.Random(4)
    a, b = prose(rng, 80), prose(rng, 90)
    rows = [(None, a, None, None, None), (None, a, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", None),
            (3, b, " ", "s", len(b)), (3, b, " ", "s", len(b)), (4, prose(rng, 20_000), "en", "s", None),
            (5, "token=abcdefgh1234 " + prose(rng, 60), "en", "s", None)]
    docs = spark.createDataFrame([(*r, "x", 1.5, 7, None) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 "kept string, score double, length int, item_id long")
    spark.createDataFrame([(None, "x" * 40), (1, None), (2, "")], "item_id long, text string") \
        .write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def ids(name, frame=docs):
        out = stages[name](spark, frame, str(tmp_path))
        assert out.dtypes == frame.dtypes
        return sorted((r.doc_id for r in out.collect()), key=str)

    assert ids("quality_rules") == [3, 3, 4, 5, None, None]
    # null and empty texts share the zero fingerprint; of repeated rows one stays, with a null id too
    assert ids("simhash_dedup") == [1, 3, 4, 5, None]
    assert ids("decontaminate") == sorted((r[0] for r in rows), key=str)
    cleaned = stages["secret_scan"](spark, docs, str(tmp_path)).filter("doc_id = 5").first()
    assert cleaned.text.startswith("[SECRET] ") and cleaned.n_chars == len(cleaned.text)
    packed = stages["pack"](spark, docs, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)


def test_native_operators_plan_no_python(spark, tmp_path):
    texts, _ = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = randomness.redact(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_entry_without_the_subpackage(tmp_path):
    """The entry point imports when the pipeline and the subpackage are absent."""
    import shutil

    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{REPO}/roadflow", f"{tmp_path}/roadflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(x.startswith('op') for x in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


@pytest.mark.parametrize("run", [" " * 1_200_000, "\t" * 1_000_001, "\n" * 1_000_000, "a" * 300_000, " \t\n" * 400_000])
def test_long_runs_have_the_ids_of_tokenizers(run):
    path = P.path("byte_bpe_50k.json")
    text = f"start{run}end <|endoftext|> x"
    assert fertility.byte_ids(path, text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
