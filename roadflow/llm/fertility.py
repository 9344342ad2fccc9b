"""Quality rules on tokeniser fertility.

Every word of a text is encoded with two public vocabularies: a byte-level BPE
and a piece BPE with byte fallback.  Per document this gives characters per
token for each, the share of byte-fallback tokens and the entropy of the piece
tokens.  Bands per language (per dominant script where no language is given)
are fitted on all documents; a document outside a band of its key is rejected.
A key with few texts takes the band of its documents' script, and a script with
few texts fixed limits (``FIXED``), never those of another script.

Defined results: a null, empty or blank text has no words, fails the base rule
and has null measures.  Repeated rows give repeated results.  A null or blank
language falls back to ``script:<name>``.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.shared import map_texts, written
from roadflow.session import cut_lineage

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Half width of a band: so many robust standard deviations, at least the floor.
SIGMAS = 4.0
#: Floors: relative to the median for characters per token, absolute for the others.
FLOORS = {"piece_chars": 0.2, "byte_chars": 0.2, "fallback_share": 0.05, "token_entropy": 0.08}
#: A band of n distinct texts weighs n / (n + PRIOR_TEXTS) against its script's, and that against ``FIXED``.
PRIOR_TEXTS = 100
#: Bands that are sent to every task, at most (about 100 bytes each).
MAX_BANDS = 10_000
#: Entropy is divided by log2 of the token count, up to this many bits.
ENTROPY_BITS = 8.0
#: Words whose tokens a worker keeps between slices; beyond it the cache starts anew.
CACHE_WORDS = 300_000

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: First code points of scripts, for documents without a language.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
           (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"),
           (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
           (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"),
           (0x1680, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
           (0x1E00, "latin"), (0x2E80, "cjk"), (0xAC00, "hangul"), (0xD7B0, "other")]
SIDES = [s for m in FLOORS for s in (f"{m}_low", f"{m}_high")]
#: Characters per token, piece and byte, and fallback share of plain sentences (the first article of
#: the declaration of human rights) in one or more languages of a script: lowest, highest.
MEASURED = {"latin": (1.16, 4.15, 0.79, 4.27, 0.02), "greek": (0.86, 0.86, 0.77, 0.77, 0.0),
            "cyrillic": (2.21, 2.21, 0.78, 0.78, 0.0), "armenian": (0.80, 0.80, 0.46, 0.46, 0.13),
            "hebrew": (0.83, 0.83, 0.69, 0.69, 0.0), "arabic": (0.90, 0.90, 0.83, 0.83, 0.0),
            "indic": (0.78, 0.88, 0.33, 0.53, 0.08), "thai": (0.96, 0.96, 0.49, 0.49, 0.02),
            "georgian": (0.85, 0.85, 0.34, 0.34, 0.03), "hangul": (0.76, 0.76, 0.35, 0.35, 0.03),
            "ethiopic": (0.35, 0.35, 0.33, 0.33, 0.83), "cjk": (0.92, 0.98, 0.49, 0.72, 0.10)}
#: Limits that the bands of scripts start from: half and twice what was measured, a quarter more fallback,
#: and an entropy under those of single letters.  Text in no living script above is known by its fallback
#: alone; scripts without an entry start from ``OPEN``, which rejects nothing.
FIXED: dict[str, dict[str, float]] = {
    k: {"piece_chars_low": a / 2, "piece_chars_high": b * 2, "byte_chars_low": c / 2, "byte_chars_high": d * 2,
        "fallback_share_high": e + 0.25, "token_entropy_low": 0.35}
    for k, (a, b, c, d, e) in MEASURED.items()} | {"other": {"fallback_share_high": 0.5}}
#: Limits beyond which no text lies, or next to none (characters per token).
OPEN = {"piece_chars_low": 0.0, "piece_chars_high": 16.0, "byte_chars_low": 0.0, "byte_chars_high": 16.0,
        "fallback_share_low": 0.0, "fallback_share_high": 1.0, "token_entropy_low": 0.0, "token_entropy_high": 1.0}

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
          ("n_repeat_words", "long"), ("n_piece_tokens", "long"), ("n_byte_tokens", "long"),
          ("n_fallback_tokens", "long"), ("token_entropy", "double"), ("script", "string")]


def byte_level_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to id of a byte-level BPE file, and its added tokens to id.

    Printable Latin-1 stands for itself, the rest for 256 and up.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()
            if token not in special}, special


@functools.cache
def byte_encoder(path: str):
    """The byte-level vocabulary of a tokenizers file, run by tiktoken: the same ids, several times as fast.

    ``encode`` with all special tokens allowed gives the ids of the added tokens that
    a text spells, as tokenizers does; ``encode_ordinary`` takes them for plain text.
    """
    import tiktoken

    ranks, special = byte_level_ranks(path)
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks, special_tokens=special)


@functools.cache
def byte_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_ids(path: str, text: str) -> list[int]:
    """Ids of a whole text, those of added tokens that it spells included.

    A white-space run of about a million characters is beyond the pattern engine of
    the fast encoder; such a text goes to the tokenizers library.
    """
    try:
        return byte_encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return byte_tokenizer(path).encode(text, add_special_tokens=False).ids


@functools.cache
def piece_encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def fallback_ids(path: str) -> np.ndarray:
    model = piece_encoder(path)
    return np.array([model.is_byte(i) for i in range(model.get_piece_size())])


class WordTokens(dict):
    """Number of every word seen by a worker, and the tokens of numbered words in flat arrays."""

    def __init__(self, byte_path: str, piece_path: str):
        super().__init__()
        self.byte, self.piece = byte_encoder(byte_path), piece_encoder(piece_path)
        self.new: list[bytes] = []
        self.tokens, self.starts, self.bytes = array("q"), array("q", [0]), array("q")

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number

    def encode_new(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode what was numbered since; piece tokens of all words, where each word's start, byte-level counts."""
        if self.new:
            texts = [w.decode() for w in self.new]
            self.new = []
            for pieces in self.piece.encode(texts, num_threads=1):
                self.tokens.extend(pieces)
                self.starts.append(len(self.tokens))
            encode = self.byte.encode_ordinary
            self.bytes.extend([len(encode(" " + t)) for t in texts])
        # copies: an array that is exported cannot grow
        return tuple(np.array(x, np.int64) for x in (self.tokens, self.starts, self.bytes))


@functools.cache
def worker_words(byte_path: str, piece_path: str) -> list[WordTokens]:
    return [WordTokens(byte_path, piece_path)]


def repeat_words(ids: np.ndarray) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    size = int(ids.max()) + 1
    _, pair = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)
    _, window, count = np.unique(pair * size + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] >= 2
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= twice
    return int(covered.sum())


def script_of(text: str) -> str:
    """The script of most letters; ``latin`` for ASCII."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = points[(points > 0x7F) | ((points | 32) - 97 < 26)]
    starts = np.array([s for s, _ in SCRIPTS])
    if not len(letters):
        return "latin"
    count = np.bincount(np.searchsorted(starts, letters, "right") - 1, minlength=len(starts))
    total: dict[str, int] = {}
    for n, (_, name) in zip(count.tolist(), SCRIPTS, strict=True):
        total[name] = total.get(name, 0) + n
    return max(total, key=lambda k: total[k])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start .. start + length of every run, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)


def measure(texts: list, byte_path: str, piece_path: str) -> list[list]:
    held = worker_words(byte_path, piece_path)
    if len(held[0]) > CACHE_WORDS:
        held[0] = WordTokens(byte_path, piece_path)
    known = held[0]
    # bytes split at ASCII white space only
    numbered = [np.array([known[w] for w in (t or "").encode().split()], np.int64) for t in texts]
    tokens, starts, byte_tokens = known.encode_new()
    is_fallback = fallback_ids(piece_path)
    rows = []
    for text, ids in zip(texts, numbered, strict=True):
        text = text or ""
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        n_piece = n_byte = n_fallback = 0
        entropy = None
        if len(ids):
            seen, times = np.unique(ids, return_counts=True)
            lengths = starts[seen + 1] - starts[seen]
            made, weight = tokens[spread(starts[seen], lengths)], np.repeat(times, lengths)
            n_byte = int(times @ byte_tokens[seen])
            n_piece = int(weight.sum())
            n_fallback = int(weight[is_fallback[made]].sum())
            if len(made) < len(is_fallback) // 8:
                _, made = np.unique(made, return_inverse=True)
            share = np.bincount(made, weight)
            share = share[share > 0] / n_piece
            bits = float(-(share * np.log2(share)).sum())
            entropy = bits / min(max(np.log2(n_piece), 1.0), ENTROPY_BITS)
        rows.append((len(ids), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
                     len(lines) - len(set(lines)), repeat_words(ids), n_piece, n_byte, n_fallback,
                     entropy, script_of(text)))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]


def with_measures(docs: DataFrame, text: str, keep: list[str], prefix: str = "",
                  byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """``keep`` columns of every row with its base counts and token measures."""
    byte_path = byte_path or public_tokenizers.path(BYTE_VOCABULARY)
    piece_path = piece_path or public_tokenizers.path(PIECE_VOCABULARY)
    made = map_texts(docs, text, lambda texts: measure(texts, byte_path, piece_path),
                     [(prefix + n, t) for n, t in FIELDS], keep)

    def c(name: str):
        return F.col(prefix + name)

    chars = c("word_chars").cast("double")
    return made.withColumns({
        prefix + "piece_chars": F.when(c("n_piece_tokens") > 0, chars / c("n_piece_tokens")),
        prefix + "byte_chars": F.when(c("n_byte_tokens") > 0, chars / c("n_byte_tokens")),
        prefix + "fallback_share": F.when(c("n_piece_tokens") > 0,
                                          c("n_fallback_tokens") / c("n_piece_tokens")),
        prefix + "base_failed": (c("n_words") < MIN_WORDS) |
                                (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")),
    })


def band_key(lang, script):
    """The language in lower case, or the script where there is none."""
    code = F.lower(F.trim(lang))
    return F.when(F.length(code) > 0, code).otherwise(F.concat(F.lit("script:"), script))


def fit_bands(measured: DataFrame, key: str, content: str, prefix: str = "") -> DataFrame:
    """Band limits per key and per script, from every distinct text that passes the base rule.

    Copies count once, so a hot text does not move a band.  Quartiles are exact
    over values rounded to three places, of which there are few, so that the
    percentile states stay small and combine before the shuffle.  A row with a
    null key is the band of all texts of its ``script``.
    """
    c = {m: F.round(F.col(prefix + m), 3).alias(m) for m in FLOORS}
    sound = (measured.filter(~F.col(prefix + "base_failed"))
             .select(F.col(key).alias("band_key"), F.col(prefix + "script").alias("script"),
                     F.col(content).alias("content"), *c.values())
             .dropDuplicates(["band_key", "content"]))
    stats = [F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(m) for m in FLOORS]
    count = F.count(F.lit(1)).alias("n_texts")
    none = F.lit(None).cast("string")
    fitted = sound.groupBy("band_key").agg(count, *stats).withColumn("script", none)
    pooled = sound.dropDuplicates(["script", "content"]).groupBy("script").agg(count, *stats)
    bands = fitted.unionByName(pooled.withColumn("band_key", none))
    limits = []
    for m, floor in FLOORS.items():
        q1, mid, q3 = (F.col(m)[i] for i in range(3))
        half = F.greatest(SIGMAS * (q3 - q1) / 1.349, floor * mid if m.endswith("chars") else F.lit(floor))
        limits += [(mid - half).alias(f"{m}_low"), (mid + half).alias(f"{m}_high")]
    return bands.select("band_key", "script", "n_texts", *limits)


def verdict(measured: DataFrame, bands: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Adds ``reasons`` and ``kept`` to measured rows.

    Limits are shrunk, so that no count of texts switches a rule: a script's are the
    mean of its own band and ``FIXED``, a key's the mean of its own band and its
    script's, each weighed by n / (n + ``PRIOR_TEXTS``) for a band of n texts.

    Bands are one row per language.  Up to ``MAX_BANDS`` of them are sent to every
    task, so that the rows of a common language are not gathered in one; a larger
    band table, which a column of free text would give, is joined by a shuffle.  The
    limits of scripts, of which there are few, stand in the plan.
    """
    bands = cut_lineage(bands)
    scripts = {name: OPEN | FIXED.get(name, {}) for name in {s for _, s in SCRIPTS}}
    for r in bands.filter("band_key is null and script is not null").collect():
        weight = r["n_texts"] / (r["n_texts"] + PRIOR_TEXTS)
        scripts[r["script"]] = {s: weight * r[s] + (1 - weight) * scripts[r["script"]][s] for s in SIDES}
    own = bands.filter("band_key is not null").select(
        F.col("band_key").alias("__band_key"), (F.col("n_texts") / (F.col("n_texts") + PRIOR_TEXTS)).alias("__weight"),
        *(F.col(s).alias(f"__{s}") for s in SIDES))
    own = F.broadcast(own) if own.count() <= MAX_BANDS else own
    joined = measured.join(own, F.col(key) == F.col("__band_key"), "left")

    def limit(side: str):
        known = F.create_map(*(x for k, v in scripts.items() for x in (F.lit(k), F.lit(float(v[side])))))
        script = F.element_at(known, F.col(prefix + "script"))
        return F.when(F.col("__band_key").isNull(), script).otherwise(
            F.col("__weight") * F.col(f"__{side}") + (1 - F.col("__weight")) * script)

    def outside(m: str):
        value = F.col(prefix + m)
        low, high = value < limit(f"{m}_low"), value > limit(f"{m}_high")
        # a low fallback share or a high entropy is no fault
        return {"fallback_share": high, "token_entropy": low}.get(m, low | high)

    reasons = F.concat_ws(",", F.when(F.col(prefix + "base_failed"), F.lit("base")),
                          *(F.when(F.coalesce(outside(m), F.lit(False)), F.lit(m)) for m in FLOORS))
    return (joined.withColumn(prefix + "reasons", reasons)
            .withColumn(prefix + "kept", F.col(prefix + "reasons") == "")
            .drop("__band_key", "__weight", *(f"__{s}" for s in SIDES)))


def fertility_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    lang: str | None = "lang", **paths: str) -> DataFrame:
    """One row per document: id, base counts, measures, ``base_failed``, ``reasons``, ``kept``.

    The texts are read and encoded once; the measures, a few numbers a row, are
    checkpointed, and bands and verdicts are made from those.
    """
    lang_col = F.col(lang) if lang and lang in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("__text"),
                       lang_col.cast("string").alias("__lang"),
                       F.xxhash64(F.col(text)).alias("__content"))
    measured = with_measures(slim, "__text", [id_col, "__lang", "__content"], **paths)
    measured = cut_lineage(measured.withColumn("band_key", band_key(F.col("__lang"), F.col("script"))))
    judged = verdict(measured, fit_bands(measured, "band_key", "__content"), "band_key")
    return judged.drop("__lang", "__content")


def keep_sound(docs: DataFrame, text: str = "text", lang: str = "lang", **paths: str) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    Rows go through Python once; the measured rows are written to the shared
    folder so that bands come from all of them before any is judged.
    """
    columns = list(docs.columns)
    lang_col = F.col(lang) if lang in columns else F.lit(None)
    measured = written(with_measures(docs, text, columns, "__", **paths)
                       .withColumn("__key", band_key(lang_col.cast("string"), F.col("__script")))
                       .withColumn("__content", F.xxhash64(F.col(text))), "fertility")
    judged = verdict(measured, fit_bands(measured, "__key", "__content", "__"), "__key", "__")
    return judged.filter("__kept").select(*columns)
