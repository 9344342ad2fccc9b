"""Learned operators: held-out accuracy, gradients, edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from roadflow.llm import attention_mil, toxic_chain, url_boosting
from roadflow.llm.shared import one_text


def words(rng, n):
    return " ".join("".join(rng.choice("aeioutrnshl") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {"E": rng.standard_normal((5, 4)), "e": rng.standard_normal(4), "V": rng.standard_normal((4, 3)),
         "U": rng.standard_normal((4, 3)), "a": rng.standard_normal(3), "c": rng.standard_normal(4),
         "b": rng.standard_normal(1)}
    x, first, label = rng.standard_normal((7, 5)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        y = attention_mil.forward(w, x, first)["y"]
        return float(-(label * np.log(y) + (1 - label) * np.log(1 - y)).mean())

    grad = attention_mil.gradients(w, x, first, label)
    for k, g in grad.items():
        for at in np.ndindex(*w[k].shape):
            old = w[k][at]
            w[k][at] = old + 1e-5
            up = loss()
            w[k][at] = old - 1e-5
            down = loss()
            w[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6, (k, at)


def test_encode_covers_whole_text():
    rng = random.Random(1)
    text = words(rng, 3000)
    bag = attention_mil.encode(text)
    assert len(bag) >= len(text.encode()) // (attention_mil.PASSAGE_BYTES + 20)
    assert attention_mil.encode(text + " ###$$$%%%")[-1].tolist() != bag[-1].tolist()
    assert attention_mil.encode(None).shape == attention_mil.encode("").shape == (1, attention_mil.FEATURES)
    assert attention_mil.encode("x" * 5000).shape[0] == 1  # no white space to cut at


def test_attention_finds_bad_passages_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        bad = i % 3 == 0
        parts = [words(rng, 60) for _ in range(rng.randint(2, 6))]
        if bad:
            parts[rng.randrange(len(parts))] = " | ".join(words(rng, 60).upper().split())
        rows.append((i, "\n".join(parts), "x"))
        labels.append((i, 0 if bad else 1))
    rows += [(None, None, "x"), (501, "", "x"), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int")
    got = attention_mil.classify(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_attention_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in attention_mil.classify(docs, none).collect()] == [0.5, 0.5]
    assert attention_mil.classify(docs.limit(0), none).count() == 0


def toxic_table(spark, n=600):
    rng = random.Random(3)
    terms = [w for c in ("insult", "degradation") for w in toxic_chain.CATEGORIES[c].split()]
    rows, labels = [], []
    for i in range(n):
        text = words(rng, 80).split()
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(terms, 3):
                text.insert(rng.randrange(len(text)), w.title() + "!")
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_chain_finds_toxic_documents(spark):
    rows, labels = toxic_table(spark)
    extra = [(9000, None), (9001, ""), (9002, "You idiot " + "clean words here " * 3000 + "worthless scum"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    marks = spark.createDataFrame(labels[:400], "doc_id long, toxic int")
    got = toxic_chain.detect(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    unseen = [r for r in got if 400 <= r.doc_id < 600]
    assert all(r.toxic == bool(truth[r.doc_id]) for r in unseen)
    by_id = {r.doc_id: r for r in got}
    assert not by_id[9000].toxic and not by_id[9001].toxic and by_id[9002].toxic
    assert all(0 <= r.p_insult <= 1 for r in got)


def test_words_are_chosen_from_all_labelled_documents(spark, monkeypatch):
    rows, labels = toxic_table(spark)
    rare = [i for i in range(0, 600, 4)][::5]
    docs = spark.createDataFrame([(i, t + " zorbish" * (i in rare)) for i, t in rows], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = toxic_chain.fit(docs, marks).vocabulary
    assert "zorbish" in whole
    assert toxic_chain.fit(docs, marks, rows=4).vocabulary == whole  # 4 of a label cannot show it 5 times
    monkeypatch.setattr(toxic_chain, "BLOCK_IDS", 100)
    monkeypatch.setattr(toxic_chain, "COUNTED_WORDS", 500)
    assert toxic_chain.fit(docs, marks, rows=4).vocabulary == whole
    n = {r.word: (r.a, r.b) for r in toxic_chain.word_counts(
        docs.join(marks.withColumnRenamed("toxic", "__label"), "doc_id"), "text").groupBy("word")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    assert n["zorbish"] == (len(rare), 0) and n[None] == (150, 450)


def test_chain_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic for r in toxic_chain.detect(docs, none).collect()] == [False, False]
    assert toxic_chain.detect(docs.limit(0), none).count() == 0


def test_later_links_use_earlier_probabilities():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 3))
    first = x[:, 0] > 0
    labels = np.stack([first, first & (x[:, 1] > 0)], 1)
    chain = toxic_chain.train(toxic_chain.Chain({}, ["a", "b"]), x, labels, np.arange(400) % 5)
    assert [len(link) for link in chain.links] == [4, 5] and chain.links[1][3] > 0


# ---------------------------------------------------------------- URLs
def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    low = str.maketrans(url_boosting.UPPER, url_boosting.UPPER.lower())
    return rest[:n].translate(low), tail[:m]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_boosting.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://ORG/", "https://a.Example.org/en/12?x=1#y", "http://example.org/es/",
        "http://badexample.org/es/x", "http://a.com/fr/x", "http://a.com/de/", "http://a.com?x=://b", "x://y://z/w",
        "http://é.com/fr/\n?q", "http://a.net/" + "p/" * 20_000, "http://u:p@a.com:80/de/"]


def test_urls_match_brute_force(spark):
    rng = random.Random(5)
    made = [f"http://{rng.choice(['www.', 'm.', ''])}h{i}.example.{rng.choice(['com', 'org', 'net'])}"
            f"/{rng.choice(['fr', 'de', 'en', 'es'])}/{i}?a={i}" for i in range(300)]
    urls = URLS + made + URLS
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, verdict string")
    rows = {r.page_id: r for r in url_boosting.judge(pages).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or ("block" if r.block_probability >= 0.5 else "allow"))
    # the method alone agrees with the labels that the rules give
    ruled = [r for r in rows.values() if r.rule]
    agree = sum((r.block_probability >= 0.5) == (r.verdict == "block") for r in ruled)
    assert len({r.verdict for r in ruled}) == 2 and agree >= 0.9 * len(ruled)


def test_urls_without_both_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_boosting.judge(pages).collect()] == ["allow", "allow"]
    assert url_boosting.judge(pages.limit(0)).count() == 0


def labelled_urls(spark, urls):
    frame = spark.createDataFrame([(u,) for u in urls], "__url string")
    seen = url_boosting.lexical(url_boosting.ruled(url_boosting.parts(frame, "__url")), "__url")
    return seen.filter("__rule_verdict is not null").withColumns({
        "__label": F.when(F.col("__rule_verdict") == "block", 1.0).otherwise(0.0),
        "__half": url_boosting.half("__url")})


def test_suffixes_of_all_labelled_urls_and_a_sample_of_distinct_ones(spark):
    urls = [f"http://h{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(60)] + ["http://hot.com/fr/"] * 300
    labelled = labelled_urls(spark, urls)
    tables = url_boosting.suffix_tables(labelled)
    whole = {r["__segment_key"]: r for r in url_boosting.statistics(tables)["segment"].collect()}
    assert abs(whole["fr"]["__segment_count"] - np.log1p(330)) < 1e-9
    assert abs(whole["de"]["__segment_rate"] - 40 / 50) < 1e-9
    parts = [{r["__segment_key"]: r for r in url_boosting.statistics(tables, [h])["segment"].collect()} for h in (0, 1)]
    counts = [np.expm1(p["fr"]["__segment_count"]) / 2 for p in parts]
    assert abs(sum(counts) - 330) < 1e-6 and min(counts) < 31
    sample = url_boosting.sample_urls(labelled, 20).collect()
    assert len({r["__url"] for r in sample}) == len(sample) == 20
    assert sorted(r["__label"] for r in sample) == [0.0] * 10 + [1.0] * 10
    assert all(r["__weight"] > 1 for r in sample)
    assert url_boosting.sample_urls(labelled, 1000).count() == 61
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, "http://x.net/de/1", "http://x.net/fr/1"])],
                                  "page_id long, url string")
    got = {r.page_id: r for r in url_boosting.judge(pages, sample_rows=20).collect() if r.page_id >= len(urls)}
    assert got[len(urls)].verdict == "block" and got[len(urls) + 1].verdict == "allow"


def test_entropy_and_digit_ratio(spark):
    frame = url_boosting.lexical(url_boosting.parts(spark.createDataFrame([("aabb12",), ("",)], "url string"), "url"), "url")
    rows = frame.select(F.round("__entropy", 6).alias("e"), "__digit_ratio").collect()
    assert [tuple(r) for r in rows] == [(1.918296, 2 / 6), (0.0, 0.0)]


def test_the_text_of_a_repeated_id_does_not_depend_on_partitioning(spark):
    rows = [(i % 20, f"text {i}", 1) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, __text string, __label int")
    got = [sorted(one_text(frame.repartition(n), "doc_id").collect()) for n in (1, 3, 8)]
    assert len(got[0]) == 20 and got[0] == got[1] == got[2]


def test_fit_learns_from_every_passage(spark, monkeypatch):
    bags = []
    monkeypatch.setattr(attention_mil, "train", lambda b, y: bags.extend(b))
    text = words(random.Random(3), 20000)
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    attention_mil.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert sorted(map(len, bags)) == [1, len(attention_mil.encode(text))] and max(map(len, bags)) > 100
