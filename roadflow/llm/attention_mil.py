"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, its label the bag's label.  Every passage of
every whole text is encoded: shares of byte classes, shape figures and hashed
byte trigrams, then a learned layer.  Gated attention weighs the passages
(softmax of ``w . (tanh(V h) * sigmoid(U h))`` within the document), and a
logistic unit scores the weighted passage representation.  Attention, encoder
and score are learned together from document labels.

Fitting uses a bounded sample: at most ``SAMPLE_ROWS`` labelled documents, chosen
by a hash, each with all its passages.  Scoring reads every text in full.

Defined results: an empty or null text is one empty passage and gets a score
like any other; labels that are null are not used, of repeated labels the
smallest holds, and of different texts under one
id the one with the smallest hash is learned from; without labels of both kinds every score is the labels' mean
(0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.shared import explode_texts, map_texts, one_text, quoted

#: Labelled documents that the model is fitted on, at most.
SAMPLE_ROWS = 5000
PASSAGE_BYTES = 640
TRIGRAMS = 128
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.01, 1e-4
FOLDS = 5
THRESHOLD = 0.3

#: Byte classes: lower, upper, digit, blank, newline, symbol, stop, quote, other ASCII, beyond ASCII.
CLASSES = 10
CLASS_OF = np.full(256, 8, np.int64)
CLASS_OF[128:] = 9
for _n, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                             b" \t\v\f\r", b"\n", b"#*$%&|<>", b".,;:!?", b"\"'()[]{}-_/")):
    CLASS_OF[list(_bytes)] = _n
SHAPES = 6
FEATURES = CLASSES + SHAPES + TRIGRAMS


def encode(text: str | None) -> np.ndarray:
    """Passages x features of one whole text, cut at white space."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    kinds = CLASS_OF[data]
    blanks = np.flatnonzero((kinds == 3) | (kinds == 4))
    aims = np.arange(PASSAGE_BYTES, n, PASSAGE_BYTES)
    at = np.searchsorted(blanks, aims)
    cuts = np.unique(blanks[at[at < len(blanks)]])
    passage = np.zeros(n, np.int64)
    passage[cuts] = 1
    passage = np.cumsum(passage)
    count = int(passage[-1]) + 1
    size = np.bincount(passage, minlength=count).astype(np.float64)
    shares = np.bincount(passage * CLASSES + kinds, minlength=count * CLASSES).reshape(count, CLASSES) / size[:, None]
    grams = np.zeros((count, TRIGRAMS))
    if n > 2:
        wide = data.astype(np.int64)
        codes = (wide[:-2] * 961 + wide[1:-1] * 31 + wide[2:]) % 8191 % TRIGRAMS
        grams = np.bincount(passage[:-2] * TRIGRAMS + codes, minlength=count * TRIGRAMS).reshape(count, TRIGRAMS)
        grams = np.sqrt(grams / size[:, None])
    inside = kinds < 3
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    words = np.bincount(passage[starts], minlength=count)
    gaps = (kinds == 3) | (kinds == 4)
    tokens = np.bincount(passage[gaps], minlength=count) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    whole = raw.split()
    distinct = len(set(whole)) / len(whole) if whole else 0.0
    shape = np.stack([words / tokens, np.log1p(size / tokens), shares[:, 4] * 20,
                      np.full(count, repeated), np.full(count, distinct), np.full(count, np.log1p(n) / 12)], 1)
    return np.concatenate([shares, shape, grams], 1).astype(np.float32)


@dataclass
class Model:
    """Weights; ``prior`` alone scores when there was nothing to learn."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.weights is None or not bags:
            return np.full(len(bags), self.prior)
        x = (np.concatenate(bags) - self.mean) / self.scale
        first = np.cumsum([0, *map(len, bags)])[:-1]
        return forward(self.weights, np.clip(x, -6, 6), first)["y"].astype(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """``first``: the row of each bag's first passage."""
    lengths = np.diff([*first, len(x)])
    bag = np.repeat(np.arange(len(first)), lengths)
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    raw = (t * g) @ w["a"]
    raw = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
    share = raw / np.add.reduceat(raw, first)[bag]
    z = np.add.reduceat(share[:, None] * h, first)
    return {"bag": bag, "h": h, "t": t, "g": g, "share": share, "z": z, "y": sigmoid(z @ w["c"] + w["b"])}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(w, x, first)
    bag, h, t, g, share = f["bag"], f["h"], f["t"], f["g"], f["share"]
    d_logit = (f["y"] - label) / len(label)
    d_z = d_logit[:, None] * w["c"]
    d_share = (d_z[bag] * h).sum(1)
    d_raw = share * (d_share - np.add.reduceat(share * d_share, first)[bag])
    d_t, d_g = d_raw[:, None] * w["a"] * g * (1 - t * t), d_raw[:, None] * w["a"] * t * g * (1 - g)
    d_h = d_z[bag] * share[:, None] + d_t @ w["V"].T + d_g @ w["U"].T
    d_pre = d_h * (1 - h * h)
    return {"E": x.T @ d_pre, "e": d_pre.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "a": (t * g).T @ d_raw,
            "c": f["z"].T @ d_logit, "b": d_logit.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Adam on the log loss of the bags."""
    labels = np.asarray(labels, np.float32)
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(prior)
    rows = np.concatenate(bags)
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    bags = [np.clip((b - mean) / scale, -6, 6) for b in bags]
    rng = np.random.default_rng(seed)

    def init(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"E": init(FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION),
         "U": init(HIDDEN, ATTENTION), "a": init(ATTENTION), "c": init(HIDDEN),
         "b": np.array([np.log(prior / (1 - prior))], np.float32)}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            chosen = [bags[i] for i in pick]
            first = np.cumsum([0, *map(len, chosen)])[:-1]
            grad = gradients(w, np.concatenate(chosen), first, labels[pick])
            step += 1
            for k in w:
                d = grad[k] + DECAY * w[k]
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-7)
    return Model(prior, mean, scale, {k: x.astype(np.float32) for k, x in w.items()})


def held_out(id_col: str):
    """Rows whose crc32 of the id as text leaves 0 modulo FOLDS are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample_labels(labels: DataFrame, id_col: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold, by a hash of the id: (id, label)."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))
    one = known.groupBy(id_col).agg(F.min(label).cast("int").alias("__label"))
    return one.orderBy(F.xxhash64(F.lit("sample"), F.col(id_col)), id_col).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = SAMPLE_ROWS) -> Model:
    """Encode the sampled documents where they lie and learn from their passages."""
    sample = sample_labels(labels, id_col, label, rows)  # bounded by ``rows``: small enough to send
    slim = docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text)).alias("__text"))
    chosen = one_text(slim.join(F.broadcast(sample), id_col), id_col)

    def fn(texts):
        return list(range(len(texts))), [[encode(t).astype("<f2").tobytes() for t in texts]]

    got = explode_texts(chosen, "__text", fn, [("bag", "binary")], [id_col, "__label"])
    table = got.orderBy(id_col).toArrow()  # the passages of at most ``rows`` texts
    bags = [np.frombuffer(b, "<f2").astype(np.float32).reshape(-1, FEATURES) for b in table["bag"].to_pylist()]
    return train(bags, np.array(table["__label"].to_pylist(), np.float32))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the score of every whole text."""
    return map_texts(docs, text, lambda texts: [model.score([encode(t) for t in texts])],
                     [("score", "double")], keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
             label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, id_col, text, label), [id_col], text)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
