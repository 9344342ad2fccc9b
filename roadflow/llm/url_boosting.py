"""URL verdicts: host and path rules, then gradient-boosted trees on lexical features.

Rules label the URLs they fit; trees learned from those labels judge the rest.
Everything runs on DataFrame functions and the DataFrame-based MLlib.

Suffix statistics are smoothed block rates and counts of the host's top label,
its last two labels and the first path segment, counted over all labelled URLs.
The trees are fitted on a bounded sample of distinct URLs, each weighted with its
rows and its verdict's share of the sample.  In training a URL sees the statistics
of the half (by a hash) that it is not in, so that no row's own label reaches its
features; counts of a half stand for twice as many.

Defined results: a null URL or one without ``://`` has an empty host and path
and is judged by the method; without labels of both verdicts the method answers
the only one there is, or ``allow``; the probability 0.5 blocks.  Repeated rows
give repeated results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.llm.shared import quoted
from roadflow.session import cut_lineage

#: Verdict, host, path prefix.  A stated list, kept in the plan; at most MAX_RULES.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MAX_RULES = 1000
#: Distinct labelled URLs the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, STEP = 15, 4, 0.3
#: Labels a suffix's block rate is smoothed with.
SMOOTHING = 20.0
SUFFIXES = ("top", "domain", "segment")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEXICAL = ("url_chars", "host_chars", "path_chars", "query_chars", "depth", "labels", "digit_ratio", "entropy",
           "params", "hyphens", "symbols", "dotted_path", "trailing_slash", "has_fragment")


def parts(urls: DataFrame, url: str) -> DataFrame:
    """Adds ``host``, ``path`` and ``__query``."""
    whole = F.coalesce(F.col(quoted(url)), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
    return urls.withColumns({
        "host": F.translate(F.regexp_extract(whole, pattern, 1), UPPER, UPPER.lower()),
        "path": F.regexp_extract(whole, pattern, 2), "__query": F.regexp_extract(whole, pattern, 3)})


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` and ``__rule_verdict`` of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "__rule_verdict": verdict})


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """Adds the lexical features and the suffixes; needs ``host``, ``path`` and ``__query``."""
    whole = F.coalesce(F.col(quoted(url)), F.lit(""))
    n = F.length(whole)

    def times(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    chars = F.split(whole, "")
    share = F.transform(F.array_distinct(chars),
                        lambda c: (n - F.length(F.replace(whole, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    host, path, query = F.col("host"), F.col("path"), F.col("__query")
    made = {
        "url_chars": n, "host_chars": F.length(host), "path_chars": F.length(path), "query_chars": F.length(query),
        "depth": times(path, "/"), "labels": times(host, r"\.") + 1,
        "digit_ratio": F.when(n > 0, times(whole, "[0-9]") / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0), "params": times(query, "[?&][^&]+"),
        "hyphens": times(whole, "-"), "symbols": times(whole, "[%_~@=+]"), "dotted_path": times(path, r"\."),
        "trailing_slash": path.endswith("/"), "has_fragment": whole.contains("#")}
    suffixes = {"top": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2),
                "segment": F.regexp_extract(path, "^/([^/]*)", 1)}
    return urls.withColumns({f"__{k}": v.cast("double") for k, v in made.items()} |
                            {f"__{k}": v for k, v in suffixes.items()})


def half(url: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), F.col(url)), F.lit(2))


def suffix_tables(labelled: DataFrame) -> dict[str, DataFrame]:
    """Per suffix kind: value, labels and block labels of either half.  All labelled URLs given are counted."""
    mine = [F.col("__half") == h for h in (0, 1)]
    return {kind: labelled.groupBy(F.col(f"__{kind}").alias(f"__{kind}_key")).agg(
        *(F.count_if(mine[h]).alias(f"__n{h}") for h in (0, 1)),
        *(F.sum(F.when(mine[h], F.col("__label")).otherwise(0.0)).alias(f"__b{h}") for h in (0, 1)))
        for kind in SUFFIXES}


def statistics(tables: dict[str, DataFrame], halves: Sequence[int] = (0, 1)) -> dict[str, DataFrame]:
    """Per suffix kind: value, smoothed block rate, log count, from the labels of the halves given."""
    made = {}
    for kind, counts in tables.items():
        n = sum((F.col(f"__n{h}") for h in halves), F.lit(0))
        blocked = sum((F.col(f"__b{h}") for h in halves), F.lit(0.0))
        made[kind] = counts.filter(n > 0).select(
            f"__{kind}_key", ((blocked + SMOOTHING / 2) / (n + SMOOTHING)).alias(f"__{kind}_rate"),
            F.log1p(n * (2 // len(halves))).alias(f"__{kind}_count"))
    return made


def sample_urls(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` distinct labelled URLs by a hash: (__url, __label, __weight).

    Either verdict has half of the sample, or all its URLs if they are fewer and
    the other verdict the rest; the weights make up for it.
    """
    urls = cut_lineage(labelled.groupBy("__url", "__label").agg(F.count(F.lit(1)).alias("__n")))
    found = {r[0]: r[1] for r in urls.groupBy("__label").count().collect()}
    order = [F.xxhash64(F.lit("sample"), "__url"), F.col("__url")]
    sample = urls.limit(0).withColumn("__weight", F.lit(0.0))
    for label, n in found.items():
        others = sum(m for k, m in found.items() if k != label)
        take = min(n, rows - min(others, rows // 2))
        part = urls.filter(F.col("__label") == label).orderBy(*order).limit(take)
        sample = sample.unionByName(part.withColumn("__weight", F.col("__n") * F.lit(n / max(take, 1))))
    return sample.drop("__n")


def with_suffixes(urls: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    for kind, stats in tables.items():
        urls = urls.join(stats, F.col(f"__{kind}") == F.col(f"__{kind}_key"), "left").drop(f"__{kind}_key")
        urls = urls.withColumns({f"__{kind}_rate": F.coalesce(f"__{kind}_rate", F.lit(0.5)),
                                 f"__{kind}_count": F.coalesce(f"__{kind}_count", F.lit(0.0))})
    return urls


FEATURES = [*(f"__{x}" for x in LEXICAL), *(f"__{k}_{s}" for k in SUFFIXES for s in ("rate", "count"))]


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url",
          rules: Sequence[tuple[str, str, str]] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_probability."""
    slim = pages.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(url)).alias("__url"))
    seen = cut_lineage(lexical(ruled(parts(slim, "__url"), rules), "__url"))
    labelled = seen.filter("__rule_verdict is not null").withColumns({
        "__label": F.when(F.col("__rule_verdict") == "block", 1.0).otherwise(0.0), "__half": half("__url")})
    tables = {k: cut_lineage(t) for k, t in suffix_tables(labelled).items()}
    sample = cut_lineage(lexical(parts(sample_urls(labelled, sample_rows), "__url"), "__url"))
    crossed = [with_suffixes(sample.filter(half("__url") == h), statistics(tables, [1 - h])) for h in (0, 1)]
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="__features")
    train = cut_lineage(assembler.transform(crossed[0].unionByName(crossed[1]))
                        .select("__features", "__label", "__weight").coalesce(4))
    labels = sorted(r[0] for r in train.select("__label").distinct().collect())
    out = with_suffixes(seen, statistics(tables))
    if len(labels) == 2:
        trees = GBTClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight",
                              predictionCol="__prediction", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7)
        model = trees.setProbabilityCol("__probability").setRawPredictionCol("__raw").fit(train)
        scored = model.transform(assembler.transform(out))
        probability = vector_to_array("__probability")[1]
    else:
        scored, probability = out, F.lit(labels[0] if labels else 0.0)
    scored = scored.withColumn("block_probability", probability)
    method = F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(id_col, "host", "path", "rule",
                         F.coalesce("__rule_verdict", method).alias("verdict"), "block_probability")
