"""Parity-sketch join, spelling variants and collocations against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from roadflow.llm import collocations, parity_join, spelling_variants


def shingles(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(b" ".join(words[i:i + width]) for i in range(len(words) - width + 1))


def link_roots(ids, sets, percent=85):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(ids))]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"w{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"w{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


def expected_components(rows, percent=85):
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    roots = link_roots(ids, sets, percent)
    low = {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            low[r] = min(low.get(r, ids[i]), ids[i])
    return sorted(((ids[i], len(sets[i]), low.get(r) if sets[i] else ids[i]) for i, r in enumerate(roots)), key=str)


def test_parity_join_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE TWO"), (7, "é É"),
            (8, "é É"), (None, "one two three four five"), (None, "x y z"), (9, "one two three four five")]
    for base in range(60):
        words = [f"b{rng.randrange(4000)}" for _ in range(rng.choice([4, 7, 12, 20, 33, 60, 64, 127, 130, 400, 900]))]
        for _ in range(rng.choice([1, 3, 9])):
            edits = rng.randint(0, max(1, len(words) // 30))
            rows.append((len(rows), " ".join(edited(rng, words, edits))))
    # sizes at and around the threshold: n and m consecutive words of one text
    long = [f"s{i}" for i in range(500)]
    for n in (100, 103, 115, 116, 117, 118, 119, 120, 256, 260, 298, 299, 300, 301, 302, 303, 304):
        rows.append((len(rows), " ".join(long[:n])))
    rows += [rows[30], rows[31]]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, sid long, keys string")
    got = parity_join.near_duplicates(docs.repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_components(rows)


@pytest.mark.parametrize("members", [512, 5])
def test_parity_join_other_thresholds_and_hot_keys(spark, members, monkeypatch):
    monkeypatch.setattr(parity_join, "MEMBERS", members)
    rng = random.Random(8)
    base = [f"h{i}" for i in range(80)]
    # a crowd of copies that all share most of a passage, with chains of links between them
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 6)))) for i in range(150)]
    rows += [(1000 + i, " ".join(base[:40] + [f"t{i}.{j}" for j in range(rng.randint(2, 30))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 85, 95):
        got = parity_join.near_duplicates(docs, percent=percent)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected_components(rows, percent)


def test_sketch_distance_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n, cut in ((5, 1), (40, 6), (70, 9), (300, 40), (1030, 20)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)]))
        k = parity_join.words_in_band(len(a).bit_length() - 1, 85)
        distance = np.bitwise_count(parity_join.sketch(a, k) ^ parity_join.sketch(b, k)).sum()
        assert distance <= len(np.setxor1d(a, b))
        assert parity_join.distance(parity_join.folded(a), parity_join.folded(b)) <= len(np.setxor1d(a, b))
        assert distance % 2 == len(np.setxor1d(a, b)) % 2


def test_every_linking_pair_shares_a_key():
    rng = np.random.default_rng(2)
    for n in [*range(1, 70), 127, 128, 129, 255, 256, 300, 511, 512, 600, 1100]:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for m in {n, n * 100 // 85, max(1, n * 9 // 10), (n + n * 100 // 85) // 2}:
            spare = parity_join.difference(n + m, 85) - abs(m - n)
            swap = max(0, spare // 2)
            b = a[swap:] if m >= n else a[swap:m + 0] if swap < m else a[:m]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**63, max(0, m - len(b))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                assert len(np.intersect1d(parity_join.set_keys(a), parity_join.set_keys(b)))


def test_parity_join_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert parity_join.near_duplicates(docs).collect() == []


def brute_words(rows):
    import re
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            seen[low] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    seen = brute_words(rows)
    found = {w: [v for v in seen if v != w and near(w, v)] for w in seen}
    form = {}
    for w, others in found.items():
        if others:
            top = min(others, key=lambda v: (-seen[v], v))
            if seen[top] >= 10 * seen[w]:
                form[w] = top

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(found[w]), seen.get(form.get(w))) for w, n in seen.items())


def variant_rows(seed, n_docs):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdéñ") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    rows = [(None, None), (1, ""), (2, "short words"), (3, "A" * 5000 + " " + "A" * 5000), (4, "A" * 4999 + "b"),
            (None, "Élémentaire Élémentaire élémentaire"), (5, "listen silents enlists listens, tinsels")]
    for i in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[:6] if rng.random() < 0.8 else stems)
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abÿÞé") + w[at:],
                                w[:at] + rng.choice("abcd") + w[at + 1:], w.upper(), w[::-1]])
            words.append(w + rng.choice([" ", "-", "1", "Ā", "😀"]))
        rows.append((100 + i, "".join(words)))
    # a chain of forms, each ten times as frequent
    rows += [(5000 + i, "chainword " * 60 + "chaimword " * (i < 35) + "chaimwort " * (i < 2)) for i in range(40)]
    return rows + rows[-3:]


@pytest.mark.parametrize("tile", [1024, 7])
def test_spelling_variants_equal_all_pairs(spark, tile):
    rows = variant_rows(4, 120)
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n long, word string")
    got = spelling_variants.group_variants(docs.repartition(4), tile=tile)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows)
    assert sum(1 for w in want if w[1]) > 20
    assert any(w[1] != w[2] for w in want if w[1])
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want


def test_spelling_variants_empty(spark):
    for rows in ([], [(1, None), (2, "too short")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert spelling_variants.group_variants(docs).collect() == []


def brute_collocations(rows, least=10, covered=50, top=2000, width=3):
    import re
    seen, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            seen.update((lang, *words[i:i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1))
    candidates = {p: a for p, a in seen.items() if len(p) > 2 and a >= least}
    covers = Counter()
    for (lang, *p), a in candidates.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                key = (lang, *p[i:i + n])
                covers[key] = max(covers[key], a)
    found = []
    for phrase, a in candidates.items():
        lang, *p = phrase
        if 100 * covers[phrase] >= covered * a:
            continue
        cuts = [(10**6 * a * a // (seen[(lang, *p[:k])] * seen[(lang, *p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(p).encode(), seen[(lang, *p[:k])], seen[(lang, *p[k:])]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return out


def collocation_rows(seed):
    rng = random.Random(seed)
    words = ["The", "new", "york", "times", "é", "É", "a\0b", "a", "\x01", "x\x1fy", "ſ", " ", "😀", "of", "city"]
    rows = [("en", None), ("en", ""), (None, "alone"), ("und", "alone, alone"), ("xx", ".,;:!?\n\t  ")]
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", "  ", ", ", ".\n", "!?", "\r", "\x0b"])
                       for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None, "a\0b"]), "new york times " * rng.randint(0, 2) + text))
    return rows + rows[-5:]


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = collocation_rows(5)
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, n long, phrase string")
    want = brute_collocations(rows)
    assert len(want) > 50
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collocations.mine_collocations(docs.repartition(3))
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want)
    short = collocations.mine_collocations(docs, max_words=2, least=3, covered=20, top=5)
    assert sorted(map(tuple, short.collect())) == sorted(brute_collocations(rows, 3, 20, 5, 2))


def test_collocations_in_many_ranges_and_runs(spark, monkeypatch):
    rows = [("en", "one two three four " * 3000 + "five"), *collocation_rows(6)]
    for name, value in {"RANGE_BYTES": 300, "EVERY": 64, "RUN_TOKENS": 700, "PIECE_TOKENS": 101, "PENDING": 50}.items():
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    bounds, _ = collocations.sampled_windows(docs.selectExpr("coalesce(lang, 'und') AS lang", "text"))
    assert len(bounds) > 20
    got = collocations.mine_collocations(docs)
    assert sorted(map(tuple, got.collect())) == sorted(brute_collocations(rows))


def test_transducer_round_trip():
    rng = random.Random(7)
    words = [b"a", b"b", b"bb", b"c\0", "é".encode(), b"z"]
    weights = {tuple(rng.choice(words) for _ in range(rng.randint(1, 3))): rng.choice([1, 1, 2, 2**40])
               for _ in range(150)}
    made = collocations.Transducer.load(collocations.Transducer.of(weights).dump())
    assert dict(made.phrases()) == weights
    assert [p for p, _ in made.phrases()] == sorted(weights)
    keys, found = made.entries(3)
    assert {tuple(made.words[i - 1] for i in k if i): w for k, w in zip(keys.tolist(), found.tolist())} == weights
    # equal right contexts are one state
    shared = collocations.Transducer.of({(a, b): 1 for a in words for b in words})
    assert len(shared.start) - 1 == 3 and len(shared.moves) == 12
    asked = collocations.Transducer.of({p: 1 for p in [*list(weights)[:40], (b"no",), (b"a", b"no"), (b"z",) * 3]})
    assert asked.compose(made) == {p: w for p, w in weights.items() if p in dict(asked.phrases())}


def test_collocations_empty(spark):
    for rows in ([], [(None, None), ("en", "few words")]):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.mine_collocations(docs).collect() == []
