"""Secret scans with a randomness test battery, in DataFrame functions only.

Base kinds are fixed patterns.  Besides them every long run of code characters
is a candidate, and so is every long segment of a run with ``/``, ``-`` or ``_``:
its encoding is inferred (hex, base32, base36, base58, base62, base64, base64url)
and three tests ask whether it looks drawn uniformly from that
alphabet: chi-squared on the alphabet, with as many cells as the length bears;
runs above and below the alphabet's middle; lag-one serial correlation.  Their
p-values are combined by Fisher's method.

A key or token is random, so its p-value is uniform; an ordinary word, path or
identifier rejects.  Which tokens count as secrets is decided by false-discovery
control per encoding and length band: the share of random tokens is estimated
from the p-values above one half, and the cut is the smallest p at which the
expected share of non-random tokens above it is at most ``MAX_FALSE``.  Copies of
a token count once, so a hot token does not move a cut.  A stratum's counts are shrunk
to its encoding's, those to all tokens', and those to a fixed prior, so that no count
switches a rule.  Where no cut below one half meets the bound, the cut of the
encoding holds, then that of all tokens, then the prior's, ``DEFAULT_CUT``.

Defined results: null and empty texts have no spans.  Positions are code points,
ends exclusive.  Base spans stay whatever the method finds; a candidate that
overlaps a base span adds nothing, nor does a segment of a run that is a span.  Runs
of digits alone are numbers and no candidates.  Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.llm.shared import quoted, written
from roadflow.session import cut_lineage

# Fixed patterns of the base kinds, in their order.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"(?<![0-9a-f])([0-9a-f]{32,})"  # shorter runs fail anyway
BASE = [("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32)]

#: Shortest candidate; below it the tests have no power.
MIN_CHARS = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{%d,}={0,2})" % MIN_CHARS
#: Parts a path or identifier is made of.
SEGMENT = r"([^/_=-]{%d,})" % MIN_CHARS
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Encoding, pattern of its tokens, alphabet; the first that fits is inferred.  Random
#: tokens of a wide alphabet that fit a narrower one are as random in that.
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36lower", r"^(?=.*[0-9])[0-9a-z]+$", DIGITS + LOWER),
    ("base36upper", r"^(?=.*[0-9])[0-9A-Z]+$", DIGITS + UPPER),
    ("base58", r"^(?=.*[1-9])[1-9A-HJ-NP-Za-km-z]+$",
     DIGITS[1:] + UPPER.replace("I", "").replace("O", "") + LOWER.replace("l", "")),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[0-9A-Za-z+/]+=*$", DIGITS + UPPER + LOWER + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+=*$", DIGITS + UPPER + LOWER + "-_"),
]
LENGTH_BANDS = (20, 28, 40, 64)
CUTS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
MAX_FALSE = 0.05
#: Counts are shrunk to those of the wider pool with the weight of so many tokens.
PRIOR_TOKENS = 50
#: The prior: half of the tokens are random, and of the others one in 2,000 t passes a cut t (all, at
#: most).  ``DEFAULT_CUT`` is the smallest cut that meets ``MAX_FALSE`` there.
PRIOR_SHARES = [0.5 * (1 - t) + 0.5 * min(1.0, 0.0005 / t) for t in CUTS]
DEFAULT_CUT = 0.01

SPAN = "array<struct<start:int,end:int,token:string>>"
#: Matches whose places are summed before those of the next are added.
BLOCK = 256


def bound(value: Column, make) -> Column:
    """The array ``make(value)``, with ``value`` evaluated once however often ``make`` names it in lambdas."""
    return F.flatten(F.transform(F.array(value), make))


def located(text: Column, pattern: str) -> Column:
    """(start, end, token) of every match: what lies between the matches gives their places.

    Each pattern passes over the text once.  Places are summed within blocks of
    ``BLOCK`` matches, then over blocks, so that no long array is copied at every match.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                    F.split(text, pattern, -1).alias("between"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["token"].alias("token"))

    def places(x: Column) -> Column:
        found, between = x["found"], x["between"]

        def place(state: Column, i: Column) -> Column:
            begin = state["at"] + F.length(F.get(between, i))
            end = begin + F.length(F.get(found, i))
            one = F.struct(begin.alias("start"), end.alias("end"), F.get(found, i).alias("token"))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

        def block(first: Column) -> Column:
            last = F.least(first + BLOCK, F.size(found)) - 1
            return F.aggregate(F.sequence(first, last), none, place)

        def joined_blocks(blocks: Column) -> Column:
            ends = F.aggregate(blocks, F.array(F.lit(0)), lambda to, one: F.concat(
                to, F.array(F.element_at(to, -1) + one["at"])))
            return bound(ends, lambda at: F.flatten(F.transform(
                blocks, lambda one, i: F.transform(one["spans"], lambda s: moved(s, F.get(at, i))))))

        firsts = F.sequence(F.lit(0), F.size(found) - 1, F.lit(BLOCK))
        return F.when(F.size(found) > 0, bound(F.transform(firsts, block), joined_blocks)).otherwise(
            F.array().cast(SPAN))

    return bound(both, places)


def base_spans(text: Column) -> Column:
    """Sorted (start, order, kind, end) of all base kinds."""
    def of_kind(order: int, kind: str, pattern: str, least: int) -> Column:
        spans = F.coalesce(located(text, pattern), F.array().cast(SPAN))
        sound = F.filter(spans, lambda s: F.length(F.regexp_extract(s["token"], pattern, 1)) >= least)
        return F.transform(sound, lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*(of_kind(i, *x) for i, x in enumerate(BASE))))


def upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def extended(items: Column, make) -> Column:
    """Array of structs with the fields that ``make`` (struct -> columns) returns; evaluated once a step."""
    return F.transform(items, lambda x: F.struct(*make(x)))


def tested(df: DataFrame, spans: str, out: str) -> DataFrame:
    """Adds ``out``: candidates of the span array as (start, end, token, enc, band, p); ``token`` is a hash."""
    tmp = "__tokens"

    def place(s: Column):
        return [s[c].alias(c) for c in ("start", "end", "token")]

    def encoding(s: Column):
        bare = F.rtrim(s["token"], F.lit("="))
        enc = k = alphabet = F.lit(None)
        for name, pattern, letters in reversed(ENCODINGS):
            fits = s["token"].rlike(pattern)
            enc = F.when(fits, F.lit(name)).otherwise(enc)
            k = F.when(fits, F.lit(float(len(letters)))).otherwise(k)
            alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        decimal = s["token"].rlike("^[0-9]+$")
        text = F.when(enc == "hex", F.lower(bare)).otherwise(bare)
        return [s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["token"]).alias("token"),
                F.when(~decimal, enc).alias("enc"), k.alias("k"), alphabet.alias("alphabet"), text.alias("text")]

    def values(s: Column):
        v = F.transform(F.split(s["text"], ""), lambda c: (F.instr(s["alphabet"], c) - 1).cast("double"))
        n = F.length(s["text"]).cast("double")
        cells = F.greatest(F.lit(2.0), F.least(s["k"], F.floor(n / 5).cast("double")))
        return [*place(s), s["enc"].alias("enc"), s["k"].alias("k"), n.alias("n"),
                cells.alias("cells"), v.alias("v")]

    def statistics(s: Column):
        v, k, n, cells = s["v"], s["k"], s["n"], s["cells"]
        middle = (k - 1) / 2

        def cell(j: Column) -> Column:
            width = F.ceil((j + 1) * k / cells) - F.ceil(j * k / cells)
            seen = F.size(F.filter(v, lambda x: F.floor(x * cells / k) == j))
            expected = n * width / k
            return (seen - expected) * (seen - expected) / expected

        chi = F.aggregate(F.transform(F.sequence(F.lit(0), cells.cast("int") - 1), cell), F.lit(0.0),
                          lambda a, x: a + x)
        zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("lag"))
        walk = F.aggregate(v, zero, lambda a, x: F.struct(
            (x - middle).alias("last"),
            (a["turns"] + F.when((x - middle) * a["last"] < 0, 1.0).otherwise(0.0)).alias("turns"),
            (a["lag"] + (x - middle) * a["last"]).alias("lag")))
        df = cells - 1
        cube = F.pow(chi / df, F.lit(1 / 3))
        return [*place(s), s["enc"].alias("enc"), n.alias("n"),
                ((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))).alias("z_chi"),
                walk.alias("walk"), k.alias("k")]

    def scores(s: Column):
        pairs = s["n"] - 1
        return [*place(s), s["enc"].alias("enc"), s["n"].alias("n"),
                s["z_chi"].alias("z_chi"),
                ((s["walk"]["turns"] - pairs / 2) / F.sqrt(pairs / 4)).alias("z_runs"),
                (s["walk"]["lag"] / ((s["k"] * s["k"] - 1) / 12) / F.sqrt(pairs)).alias("z_lag")]

    def tails(s: Column):
        floor = F.lit(1e-300)
        return [*place(s), s["enc"].alias("enc"), s["n"].alias("n"),
                (-2 * (F.log(F.greatest(upper_tail(s["z_chi"]), floor))
                       + F.log(F.greatest(2 * upper_tail(F.abs(s["z_runs"])), floor))
                       + F.log(F.greatest(2 * upper_tail(F.abs(s["z_lag"])), floor)))).alias("x")]

    def combined(s: Column):
        x = F.greatest(s["x"], F.lit(0.0))
        band = F.lit(len(LENGTH_BANDS) - 1)
        for i in range(len(LENGTH_BANDS) - 2, -1, -1):
            band = F.when(s["n"] < LENGTH_BANDS[i + 1], F.lit(i)).otherwise(band)
        return [*place(s), s["enc"].alias("enc"), band.alias("band"),
                (F.exp(-x / 2) * (1 + x / 2 + x * x / 8)).alias("p")]

    known = df.withColumn(tmp, extended(spans_or_empty(spans), encoding))
    known = known.withColumn(tmp, F.filter(tmp, lambda s: s["enc"].isNotNull()))
    for make in (values, statistics, scores, tails, combined):
        known = known.withColumn(tmp, extended(F.col(tmp), make))
    return known.withColumnRenamed(tmp, out)


def spans_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(SPAN))


def with_candidates(docs: DataFrame, text: str, out: str = "__cand") -> DataFrame:
    """Adds the tested candidates of every text."""
    whole = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    found = docs.withColumn("__runs", F.coalesce(located(whole, CANDIDATE), F.array().cast(SPAN)))
    return tested(found.withColumn("__runs", with_segments(F.col("__runs"))), "__runs", out).drop("__runs")


def with_segments(runs: Column) -> Column:
    """The runs and the long segments of those that have separators."""
    def segments(s: Column) -> Column:
        parts = F.coalesce(located(s["token"], SEGMENT), F.array().cast(SPAN))
        return F.transform(F.filter(parts, lambda x: F.length(x["token"]) < F.length(F.rtrim(s["token"], F.lit("=")))),
                           lambda x: F.struct((s["start"] + x["start"]).alias("start"),
                                              (s["start"] + x["end"]).alias("end"), x["token"].alias("token")))

    split = F.filter(runs, lambda s: s["token"].rlike("[/_-]"))
    return F.concat(runs, F.flatten(F.transform(split, segments)))


def with_base(docs: DataFrame, text: str, out: str = "__base") -> DataFrame:
    """Adds the sorted base spans of every text."""
    return docs.withColumn(out, base_spans(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))))


def fit_cuts(candidates: DataFrame, cand: str = "__cand") -> dict[tuple[str, int], float]:
    """The cut of every (encoding, length band).

    One grouped count over all distinct candidates, copies being dropped before the
    shuffle; the result has at most ``len(ENCODINGS) * len(LENGTH_BANDS)`` rows,
    however large the corpus.
    """
    each = candidates.select(F.explode(cand).alias("c")).select("c.token", "c.enc", "c.band", "c.p")
    each = each.dropDuplicates(["token", "enc", "band"])
    above = [F.count_if(F.col("p") > t).alias(f"t{i}") for i, t in enumerate(CUTS)]
    rows = each.groupBy("enc", "band").agg(F.count(F.lit(1)).alias("n"), *above).collect()
    seen = {(r.enc, r.band): [r.n, *(r[f"t{i}"] for i in range(len(CUTS)))] for r in rows}

    def total(keep) -> list[int]:
        return [sum(c) for c in zip(*([0] * (len(CUTS) + 1), *(v for k, v in seen.items() if keep(k))),
                                    strict=True)]

    def shrunk(counts: list[float], pool: list[float]) -> list[float]:
        return [c + PRIOR_TOKENS * p / pool[0] for c, p in zip(counts, pool, strict=True)]

    def cut(counts: list[float]) -> float | None:
        n, over = counts[0], counts[1:]
        random = min(n, over[CUTS.index(0.5)] / 0.5)
        # at one half the estimate meets any bound: it is no cut
        for t, kept in zip(CUTS, over, strict=True):
            if t < 0.5 and kept and max(0.0, kept - random * (1 - t)) / kept <= MAX_FALSE:
                return t
        return None

    cuts = {}
    every = shrunk(total(lambda k: True), [1.0, *PRIOR_SHARES])
    for name, *_ in ENCODINGS:
        alike = shrunk(total(lambda k, e=name: k[0] == e), every)
        for band in range(len(LENGTH_BANDS)):
            own = shrunk(total(lambda k, s=(name, band): k == s), alike)
            found = (cut(c) for c in (own, alike, every))
            cuts[name, band] = next((t for t in found if t is not None), DEFAULT_CUT)
    return cuts


def found_spans(cuts: dict[tuple[str, int], float], base: str = "__base", cand: str = "__cand") -> Column:
    """Base spans and the candidates over their cut that overlap none, sorted."""
    limits = F.create_map(*(x for (enc, band), t in cuts.items() for x in (F.lit(f"{enc}{band}"), F.lit(t))))

    def random(c: Column) -> Column:
        limit = F.element_at(limits, F.concat(c["enc"], c["band"].cast("string")))
        free = ~F.exists(F.col(base), lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
        return (c["p"] > limit) & free

    def of_span(c: Column, spans: Column) -> Column:
        return F.exists(spans, lambda s: (s["start"] <= c["start"]) & (s["end"] >= c["end"])
                        & (s["end"] - s["start"] > c["end"] - c["start"]))

    added = bound(F.filter(cand, random), lambda hits: F.transform(
        F.filter(hits, lambda c: ~of_span(c, hits)), lambda c: F.struct(
            c["start"].alias("start"), F.lit(len(BASE)).alias("ord"),
            F.concat(F.lit("random_"), c["enc"]).alias("kind"), c["end"].alias("end"))))
    return F.array_sort(F.concat(F.col(base), added))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``base`` and ``spans`` as arrays of (start, ord, kind, end).

    The texts are scanned once; spans and p-values, not texts, are checkpointed,
    and the cuts fitted on all of them.
    """
    slim = docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text)).alias("__text"))
    scanned = cut_lineage(with_candidates(with_base(slim, "__text"), "__text").drop("__text"))
    return scanned.select(id_col, F.col("__base").alias("base"),
                          found_spans(fit_cuts(scanned)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars",
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``length`` brought up to date.

    Texts without a secret, null ones included, stay as they are.  The battery runs
    once: rows, base spans and candidates are written to the shared folder, the cuts
    fitted on the candidates there, and the rows read back with them.
    """
    columns = list(docs.columns)
    scanned = written(with_candidates(with_base(docs, text), text), "secrets")
    marked = scanned.withColumn("__spans", found_spans(fit_cuts(scanned)))
    whole = F.col(quoted(text))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def replace(state: Column, s: Column) -> Column:
        gap = F.substring(whole, state["at"] + 1, s["start"] - state["at"])
        apart = F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(s["end"], state["at"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], apart).otherwise(longer)

    cleaned = F.aggregate("__spans", start, replace, lambda a: F.concat(
        a["out"], F.substring(whole, a["at"] + 1, F.length(whole))))
    hit = F.size("__spans") > 0
    out = marked.withColumn("__clean", F.when(hit, cleaned).otherwise(whole))
    new = {text: F.col("__clean")}
    if length and length in columns:
        kind = docs.schema[length].dataType
        new[length] = F.when(hit, F.length("__clean").cast(kind)).otherwise(F.col(quoted(length)))
    return out.select(*(new.get(c, F.col(quoted(c))).alias(c) for c in columns))
