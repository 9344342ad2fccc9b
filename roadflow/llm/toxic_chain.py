"""Toxicity with classifier chains.

Categories are predicted in a fixed order by linear models; each model sees the
probabilities of the categories before it.  Those are made out of fold when the
next model is trained (every document's probability comes from a model that did
not see it), so that later models learn from probabilities like those they get
in use.  The last link is the overall verdict.

Labels: the table marks documents toxic or not.  A category's label is weak: the
document is marked toxic and holds a term of the category's list.  The models
are free to use any word; their vocabulary is the words and word stems that tell
toxic documents best by a chi-squared score on counts over all labelled documents.

Words are counted where the texts lie: the labels are sent to the tasks in blocks
of at most ``BLOCK_IDS`` ids, and counts, not texts, are shuffled.  Only the links
are fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled documents of each
label, by a hash.  Scoring reads every text in full.

Defined results: null and empty texts have no words and score like any text
without a known word; a category without labels of both kinds has its labels'
mean as probability (0 without labels); repeated rows give repeated results, and
each labelled row counts in the choice of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.shared import explode_texts, map_texts, one_text, quoted, slices
from roadflow.session import cut_lineage

#: Labelled documents of each label that the chain is fitted on, at most.
SAMPLE_ROWS = 3000
VOCABULARY = 256
#: Labels sent to every task at a time; each block is one more scan of the texts.
BLOCK_IDS = 1_000_000
#: Words that a task counts before it hands them on.
COUNTED_WORDS = 200_000
#: A word must be in so many labelled documents, and score so much, to be chosen.
MIN_DOCUMENTS, MIN_CHI = 5, 15.0
FOLDS = 5
STEPS, PENALTY = 25, 0.2
THRESHOLD = 0.5
OVERALL = "toxic"
# Terms that mark a category.
CATEGORIES = {
    "insult": "idiot moron stupid clown loser fool imbecile dumb jerk",
    "degradation": "trash scum worthless pathetic disgusting garbage filth vermin",
    "threat": "kill murder hurt destroy strangle stab shoot beat",
    "profanity": "damn crap bastard bloody hell bullshit",
}
WORD = re.compile(r"[^\W\d_]+")
#: Longer words also count as their first letters, so that inflected forms share a feature.
STEM = 5


def words(text: str | None) -> list[str]:
    """Lower-case words of a text, and the stems (marked ``~``) of the longer ones."""
    found = WORD.findall((text or "").lower())
    return found + [w[:STEM] + "~" for w in found if len(w) > STEM]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, grad)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    vocabulary: dict[str, int]
    names: list[str]
    links: list[np.ndarray | float] = field(default_factory=list)

    def features(self, texts: list) -> np.ndarray:
        """Per text, log of one plus the count of every vocabulary word."""
        x = np.zeros((len(texts), len(self.vocabulary)))
        for row, text in enumerate(texts):
            for w in words(text):
                if w in self.vocabulary:
                    x[row, self.vocabulary[w]] += 1
        return np.log1p(x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        made = np.empty((len(x), 0))
        for link in self.links:
            made = np.hstack([made, apply_link(link, np.hstack([x, made]))[:, None]])
        return made


def apply_link(link: np.ndarray | float, x: np.ndarray) -> np.ndarray:
    if isinstance(link, float):
        return np.full(len(x), link)
    return sigmoid(x @ link[:-1] + link[-1])


def fit_link(x: np.ndarray, y: np.ndarray) -> np.ndarray | float:
    return logistic(x, y) if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.0


def train(chain: Chain, x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
    """Fit the links in order; later links see out-of-fold probabilities of earlier ones."""
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float64)
        chain.links.append(fit_link(x, y))
        outside = np.empty(len(x))
        for f in range(FOLDS):
            mine = fold == f
            outside[mine] = apply_link(fit_link(x[~mine], y[~mine]), x[mine])
        x = np.hstack([x, outside[:, None]])
    return chain


def word_counts(known: DataFrame, text: str) -> DataFrame:
    """(word, a, b): toxic and other rows of ``known`` that hold the word; a null word stands for all rows.

    Words are counted once a row and summed per task before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str | None, list[int]] = {}

        def made() -> pa.RecordBatch:
            good, bad = zip(*count.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(bad, pa.int64()),
                                               pa.array(good, pa.int64())], ["word", "a", "b"])

        for part in slices(batches):
            for t, mark in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for w in {None, *words(t)}:
                    if w in count:
                        count[w][mark] += 1
                    else:
                        count[w] = [1 - mark, mark]
            if len(count) >= COUNTED_WORDS:
                yield made()
                count.clear()
        if count:
            yield made()

    return known.select(quoted(text), "__label").mapInArrow(run, "word string, a long, b long")


def choose_vocabulary(docs: DataFrame, marks: DataFrame, id_col: str, text: str,
                      size: int = VOCABULARY) -> dict[str, int]:
    """The ``size`` words with the largest chi-squared score among all documents that ``marks`` labels.

    Each block of labels is sent to the texts, which stay in their tasks; counts are
    grouped by word, and only the chosen words reach the driver.
    """
    blocks = max(1, -(-marks.count() // BLOCK_IDS))
    counts = None
    for block in range(blocks):
        mine = marks.filter(F.pmod(F.xxhash64(F.lit("block"), F.col(id_col)), F.lit(blocks)) == block)
        part = word_counts(docs.join(F.broadcast(mine), id_col), text)
        counts = part if counts is None else counts.unionByName(part)
    table = counts.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    table = cut_lineage(table.filter((a + b >= MIN_DOCUMENTS) | F.col("word").isNull()))
    total = table.filter("word is null").first()
    bad, good = (float(total["a"]), float(total["b"])) if total else (0.0, 0.0)
    if not bad or not good:
        return {}
    c, d = bad - a, good - b
    chi = (bad + good) * (a * d - b * c) ** 2 / ((a + b) * (c + d + 1) * bad * good)
    table = table.filter("word is not null").withColumn("chi", chi).filter(F.col("chi") >= MIN_CHI)
    best = table.orderBy(F.desc("chi"), "word").limit(size).select("word").collect()
    return {r[0]: i for i, r in enumerate(best)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
        label: str = OVERALL, rows: int = SAMPLE_ROWS) -> Chain:
    marks = cut_lineage(labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(
        F.max(label).cast("int").alias("__label")))
    slim = docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text)).alias("__text"))
    by_hash = [F.xxhash64(F.lit("sample"), F.col(id_col)), F.col(id_col)]
    sample = None
    for value in (0, 1):
        part = marks.filter(F.col("__label") == value).orderBy(*by_hash).limit(rows)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * rows ids
    chosen = cut_lineage(one_text(slim.join(F.broadcast(sample), id_col), id_col))
    chain = Chain(choose_vocabulary(slim, marks, id_col, "__text"), [*CATEGORIES, OVERALL])
    terms = {w for t in CATEGORIES.values() for w in t.split()}

    def fn(texts):
        rows = [chain.features([t])[0] for t in texts]
        held = [" ".join(sorted(terms.intersection(words(t)))) for t in texts]
        return list(range(len(texts))), [[r.astype("<f4").tobytes() for r in rows], held]

    got = explode_texts(chosen, "__text", fn, [("x", "binary"), ("terms", "string")], [id_col, "__label"])
    table = got.orderBy(id_col).toArrow()  # at most 2 * rows rows of VOCABULARY numbers
    x = np.array([np.frombuffer(b, "<f4") for b in table["x"].to_pylist()], np.float64).reshape(
        table.num_rows, len(chain.vocabulary))
    toxic = np.array(table["__label"].to_pylist(), bool)
    held = [set(t.split()) for t in table["terms"].to_pylist()]
    weak = [[t and bool(h & set(c.split())) for c in CATEGORIES.values()] + [t]
            for t, h in zip(toxic.tolist(), held, strict=True)]
    fold = np.random.default_rng(5).permutation(len(x)) % FOLDS
    return train(chain, x, np.array(weak, bool).reshape(len(x), len(chain.names)), fold)


def score(docs: DataFrame, chain: Chain, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and a probability per link, ``p_<category>``."""
    def fn(texts):
        return list(chain.probabilities(chain.features(texts)).T)

    return map_texts(docs, text, fn, [(f"p_{n}", "double") for n in chain.names], keep)


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, category probabilities, score, predicted, toxic, categories."""
    scored = score(docs, fit(docs, labels, id_col, text), [id_col], text)
    over = [F.when(F.col(f"p_{n}") >= threshold, F.lit(n)) for n in CATEGORIES]
    hit = F.col(f"p_{OVERALL}") >= threshold
    return scored.select(id_col, *(f"p_{n}" for n in [*CATEGORIES, OVERALL]),
                         F.col(f"p_{OVERALL}").alias("score"), hit.cast("int").alias("predicted"),
                         hit.alias("toxic"), F.concat_ws(",", *over).alias("categories"))
