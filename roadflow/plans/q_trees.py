"""Trees and boosted models against SQL: small trees on features whose values are all edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.operators import histboost as H
from roadflow.operators import models as M
from roadflow.plans import sql as Q
from roadflow.plans.catalog import register
from roadflow.plans.common import events_feat

SMALL = ["hour", "dow"]


def _split(out: str, rows: str, groups: str, reg: float) -> str:
    """CTEs: the best split of every group of ``rows`` (obs_id, hour, dow, g, group columns)."""
    by = f"{groups}, " if groups else ""
    part = f"PARTITION BY {by}f"
    score = (f"gl * gl / (nl + {reg}) + (gt - gl) * (gt - gl) / (nt - nl + {reg}) - gt * gt / (nt + {reg})")
    return f"""
{out}_h AS (SELECT {by}f, v, sum(g) AS g, count(*) AS n
            FROM (SELECT *, 'hour' AS f, CAST(hour AS INT) AS v FROM {rows}
                  UNION ALL SELECT *, 'dow', CAST(dow AS INT) FROM {rows}) GROUP BY {by}f, v),
{out}_c AS (SELECT {by}f, v, sum(g) OVER ({part} ORDER BY v) AS gl, sum(n) OVER ({part} ORDER BY v) AS nl,
                   sum(g) OVER ({part}) AS gt, sum(n) OVER ({part}) AS nt FROM {out}_h),
{out} AS (SELECT * FROM (SELECT {by}f, v, {score} AS gain FROM {out}_c WHERE nl < nt)
          QUALIFY row_number() OVER ({f'PARTITION BY {groups}' if groups else ''}
                                     ORDER BY round(gain, 3) DESC, f = 'dow', v) = 1)"""


def _side(split: str) -> str:
    return f"CASE WHEN {split}.f = 'hour' THEN hour ELSE dow END <= {split}.v"


def _text(split: str, low: str) -> str:
    return f"{split}.f || CASE WHEN {low} THEN '<=' ELSE '>' END || {split}.v"


_GRADIENT = ("t AS (SELECT obs_id, hour, dow, (SELECT avg(CAST(traffic_volume AS DOUBLE)) FROM feat) - traffic_volume "
             "AS g FROM feat)")


def _two_levels(reg: float, least_first: bool) -> str:
    """Leaves of a depth-two tree, or, ``least_first``, of the best-first tree of three leaves."""
    kept = "QUALIFY row_number() OVER (ORDER BY gain DESC) = 1" if least_first else ""
    return Q.with_events(
        _GRADIENT, _split("root", "t", "", reg),
        f"s AS (SELECT t.*, {_side('root')} AS low, {_text('root', _side('root'))} AS p FROM t, root)",
        _split("every", "s", "low, p", reg), f"child AS (SELECT * FROM every {kept})",
        f"""leaf AS (SELECT s.g, CASE WHEN child.f IS NULL THEN s.p
                       ELSE s.p || ',' || {_text('child', _side('child'))} END AS path
                 FROM s LEFT JOIN child ON child.low = s.low)""") + f"""
SELECT path, count(*) AS n, round_even(-sum(g) / (count(*) + {reg}) * 0.05, 6) AS value FROM leaf GROUP BY path"""


def _leaves(model: H.BoostedModel, spark):
    """Leaves as (path, n, value)."""
    rows, todo = [], [(0, "")]
    nodes = model.trees.rows()
    while todo:
        at, path = todo.pop()
        _, feature, cut, left, right, value, _, weight = nodes[at]
        if feature < 0:
            rows.append((path, int(weight), value))
            continue
        step = f"{model.cols[feature]}{{}}{int(model.threshold(feature, cut))}"
        todo += [(left, ",".join(filter(None, [path, step.format("<=")]))),
                 (right, ",".join(filter(None, [path, step.format(">")])))]
    return spark.createDataFrame(rows, "path string, n long, value double").withColumn("value", F.bround("value", 6))


@register("leafwise_tree", _two_levels(0.0, True))
def q_leafwise_tree(spark, sf):
    """The first best-first tree of three leaves."""
    params = H.Params(rounds=1, depth=None, leaves=3)
    return _leaves(H.fit_boosted(events_feat(spark, sf), params, SMALL), spark)


@register("newton_leaves", _two_levels(1.0, False))
def q_newton_leaves(spark, sf):
    """M9: the first tree of depth two, Newton gains and leaf values with a penalty of one."""
    return _leaves(H.fit_boosted(events_feat(spark, sf), H.Params(rounds=1, depth=2, reg=1.0), SMALL), spark)


_P, _A, _B = H.PRIME, H.FIRST, H.SECOND


def _drawn(row: str) -> str:
    return f"({row} % {_P} + 1) * ((tree + 1) * {_A} % {_P}) % {_P} * {_B} % {_P}"


@register("boost_draws", Q.with_events(
    "trees AS (SELECT CAST(i AS BIGINT) AS tree FROM range(20) AS r(i))",
    f"""taken AS (SELECT tree, count(*) AS n_rows, CAST(sum(obs_id) AS BIGINT) AS row_sum FROM trees, feat
                  WHERE {_drawn('CAST(obs_id AS BIGINT)')} < 0.8 * {_P} GROUP BY tree)""",
    f"""cols AS (SELECT tree, c FROM trees, range(18) AS r(c)
                 QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {_drawn(f'({_P} - 2 - c)')}, c) <= 14)""") + """
SELECT taken.tree, n_rows, row_sum, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS columns
FROM taken JOIN cols USING (tree) GROUP BY taken.tree, n_rows, row_sum""")
def q_boost_draws(spark, sf):
    """Rows and columns that each of twenty trees draws."""
    p = M.SPECS["XGBoost (subsampled)"].build
    trees = spark.createDataFrame([(t, ",".join(map(str, H.drawn_columns(t, 18, p.columns)))) for t in range(20)],
                                  "tree long, columns string")
    rows = events_feat(spark, sf).select(F.col("obs_id").cast("long").alias("obs_id"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("tree"))
    taken = rows.filter(H.draw(F.col("tree"), F.col("obs_id")) < p.rows * H.PRIME).groupBy("tree").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("obs_id").alias("row_sum"))
    return taken.join(F.broadcast(trees), "tree").select("tree", "n_rows", "row_sum", "columns")
