"""Registered queries of the operators: thin columns over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm import (
    attention_mil, collocations, edit_matching, fertility, license_join, parity_join, randomness, simhash,
    spelling_variants, toxic_chain, url_boosting, vector_packing, warc_revisit,
)
from roadflow.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_fertility_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(table(spark, sf_dir, "documents"))


@register("op2_randomness_battery")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = randomness.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in randomness.BASE]
    return found.select("doc_id", *counts, F.sha2(randomness.joined(F.col("base")), 256).alias("base_sha256"),
                        randomness.joined(F.col("spans")).alias("spans"))


@register("op3_simhash_variants")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op4_attention_mil")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_toxic_chain")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_chain.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_vector_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"))


@register("op7_url_boosting")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_boosting.judge(table(spark, sf_dir, "pages"))


@register("op8_edit_matching")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_matching.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body,
         sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
           list_sum(list_transform(range(0, 5), lambda b:
             ((instr('0123456789abcdef', substr(hex, CAST((i * 5 + b) // 4 + 1 AS INT), 1)) - 1)
              >> CAST(3 - (i * 5 + b) % 4 AS INT)) % 2 * CAST(pow(2, 4 - b) AS INT)))) AS INT), 1)), '') AS payload_digest
  FROM p
), m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM m
"""


@register("op9_warc_revisit", WARC_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.round_trip(table(spark, sf_dir, "pages"))


def license_sql() -> str:
    """The same blocks, words and containments as set operations over all (block, template) pairs."""
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    templates = ", ".join(f"({quote(label)}, {quote(t)})" for label, t in license_join.TEMPLATES)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    places = " UNION ALL ".join(
        f"SELECT rid, {quote(label)} AS label, i - 1 AS pos FROM d, unnest(range(1, len(w) - {n} + 2)) AS u(i) "
        f"WHERE len(w) >= {n} AND array_to_string(w[i:i + {n - 1}], ' ') = {quote(phrase)} "
        f"AND array_to_string(w, ' ') LIKE {quote('%' + phrase + '%')}"
        for phrase, label in license_join.PHRASES for n in [len(phrase.split())])
    return f"""
WITH s AS (SELECT row_number() OVER () AS rid, doc_id, {low.format("coalesce(text, '')")} AS t FROM documents),
d AS (SELECT rid, doc_id, t, regexp_extract_all(t, {word}) AS w FROM s),
hits AS ({places}),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
                list(DISTINCT label) AS labels FROM hits GROUP BY rid),
blocks AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS b FROM s
  UNION ALL
  SELECT rid, unnest(regexp_split_to_array(t, '\\n[\\x20\\x09\\x0B-\\x0D]*\\n')) AS b FROM s
), bw AS (SELECT rid, list_distinct(regexp_extract_all(b, {word})) AS w FROM blocks),
tw AS (SELECT label, list_distinct(regexp_extract_all({low.format('x')}, {word})) AS w
       FROM (VALUES {templates}) AS v(label, x)),
sim AS (SELECT rid, label, len(list_intersect(bw.w, tw.w)) / len(tw.w) AS share
        FROM bw, tw WHERE len(list_intersect(bw.w, tw.w)) >= greatest(1, ceil({license_join.CONTAINMENT} * len(tw.w) - 1e-9))),
found AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS score FROM sim GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []),
                coalesce(found.labels, [])))), ','), '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)
"""


@register("op10_license_join", license_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])


#: Counted phrases joined with their parts; HUGEINT holds the products.
COLLOCATION_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM w),
t AS (SELECT lang, w1, lead(w1, 1) OVER q AS w2, lead(w1, 2) OVER q AS w3 FROM o WINDOW q AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM t GROUP BY ALL
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM t WHERE w2 IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM t WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang || chr(9) || phrase AS key, f FROM g WHERE k < 3 AND f >= 10),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k > 1 AND f >= 10),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS top FROM inside GROUP BY ALL),
parts AS (SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
          FROM c, unnest(range(1, k)) AS u(cut)),
cuts AS (SELECT parts.lang, parts.phrase, a, h.f AS l, t.f AS r, cut,
                (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
         FROM parts JOIN f h ON h.key = parts.lang || chr(9) || head JOIN f t ON t.key = parts.lang || chr(9) || tail),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM low LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * top >= 50 * a, false) = false)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@register("op11_collocation_automata", COLLOCATION_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


@register("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(table(spark, sf_dir, "documents"))


@register("op13_parity_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))
