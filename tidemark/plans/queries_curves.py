"""Queries of boundary curves and of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves as C
from ..operators import evaluate as E
from ..operators import scoring as S
from .tables import SCORED, SEG, rounded, scored, segments, table

KEY = ["user_id"]


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each user's days in order: a curve of at most 30 points, scaled to about 0..1."""
    from pyspark.sql.window import Window

    s = segments(spark, sf_dir)
    day = s.withColumn("day", F.floor(F.col("start") / 86400).cast("int")).groupBy("user_id", "day").agg(F.round(F.avg("prob"), 6).alias("p"))
    return day.withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1).withColumn("start", F.col("day") * 86400.0)


def _curves(spark, sf_dir):
    return C.gathered(_days(spark, sf_dir), KEY)


def curve_average(spark, sf_dir):
    s = scored(spark, sf_dir).select("user_id", F.col("rule").alias("run"), F.floor(F.col("start") / 86400).cast("int").alias("idx"), "prob")
    runs = s.groupBy("user_id", "run", "idx").agg(F.max("prob").alias("p"))
    return rounded(C.average(runs, KEY), "p")


def curve_changepoint(spark, sf_dir):
    return _curves(spark, sf_dir).select("user_id", C.changepoint(F.col("ys")).alias("at"))


def curve_step(spark, sf_dir):
    at = _curves(spark, sf_dir).withColumn("at", C.changepoint(F.col("ys")))
    return rounded(at.select("user_id", "at", C.step_height(F.col("ys"), F.col("at")).alias("height")), "height")


def curve_fit_start(spark, sf_dir):
    return _curves(spark, sf_dir).select("user_id", C.fit_start(F.col("ys")).alias("at"))


def curve_start_edge(spark, sf_dir):
    days = _days(spark, sf_dir)
    anchors = days.groupBy("user_id").agg((F.min("start") + 10 * 86400.0).alias("anchor_start"), (F.min("start") + 20 * 86400.0).alias("anchor_end"))
    return C.start_edge(days.select("user_id", "idx", "start", "p"), anchors, KEY, 6 * 86400.0, 0.25).drop("step")


def curve_fit_end(spark, sf_dir):
    return C.fit_end(_curves(spark, sf_dir), KEY, 5, 0.12, 0.3)


def curve_end_walk(spark, sf_dir):
    c = _curves(spark, sf_dir)
    return c.select("user_id", C.end_walk(F.col("ys"), F.lit(3), 0.15).alias("end_idx"))


def curve_trim_outro(spark, sf_dir):
    s = segments(spark, sf_dir)
    regions = s.groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return rounded(C.trim_outro(regions, s.select("user_id", "start", F.col("prob").alias("p")), KEY, 0.6), "start", "end")


WEIGHTS = {f"f{i:02d}": round(0.9 - 0.15 * i, 2) for i in range(12)} | {"f99": 5.0}


def _features(spark, sf_dir):
    pairs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(F.format_string("f%02d", i).alias("key"), F.get("embedding", i).cast("double").alias("value")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.map_from_entries(pairs).alias("values"))


def score_logistic(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("vec_id", S.logistic(F.col("values"), WEIGHTS, -0.2).alias("score")), "score")


def score_missing(spark, sf_dir):
    return _features(spark, sf_dir).select("vec_id", F.array_join(S.missing(F.col("values"), WEIGHTS | {"a0": 1.0}), ",").alias("missing"))


def score_feature_pivot(spark, sf_dir):
    long = segments(spark, sf_dir).select("user_id", F.col("rule").alias("feature"), F.col("prob").alias("value"))
    maps = S.feature_maps(long, KEY)
    return rounded(maps.select("user_id", S.logistic(F.col("values"), {"view": 1.5, "click": -0.5, "purchase": 0.7}, 0.1).alias("score"), F.size("values").alias("n")), "score")


def _probs(spark, sf_dir):
    long = segments(spark, sf_dir).groupBy("user_id", "rule").agg(F.round(F.avg("prob"), 6).alias("value"))
    return S.feature_maps(long.withColumnRenamed("rule", "feature"), KEY)


def score_scan_rule(spark, sf_dir):
    rule, total = S.scan_rule(F.col("values"), ["error", "purchase", "signup"])
    return rounded(_probs(spark, sf_dir).select("user_id", rule.alias("rule"), total.alias("prob")), "prob")


def score_answer_problem(spark, sf_dir):
    return _probs(spark, sf_dir).select("user_id", S.answer_problem(F.col("values"), ["click", "error", "purchase", "signup", "view"], 0.2).alias("problem"))


def eval_edge_summary(spark, sf_dir):
    offsets = scored(spark, sf_dir).select("rule", F.round(F.col("start") % 120 - 60, 6).alias("off"))
    return rounded(E.edge_summary(offsets, ["rule"], near=20.0), "median", "early_seconds", "late_seconds", digits=3)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("curve_", "score_", "eval_")) and callable(f)}

_DAYS = SEG + """, days AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "day") - 1 AS idx, "day" * 86400e0 AS "start" FROM (
  SELECT user_id, CAST(floor("start" / 86400) AS INTEGER) AS "day", round(avg(prob), 6) AS p FROM seg GROUP BY ALL) t)"""


def _change(source: str, name: str, key: str = "user_id") -> str:
    """(key, n, cp, height, before) of each curve of source(key, idx, p), idx from 0."""
    return f"""{name}_s AS (SELECT *, sum(p) OVER w AS s, sum(p * p) OVER w AS q, count(*) OVER (PARTITION BY {key}) AS n, sum(p) OVER (PARTITION BY {key}) AS ts, sum(p * p) OVER (PARTITION BY {key}) AS tq
  FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_e AS (SELECT {key}, n, idx + 1 AS i, round(tq - s * s / (idx + 1) - (ts - s) * (ts - s) / (n - idx - 1), 12) AS e, (ts - s) / (n - idx - 1) - s / (idx + 1) AS height, s / (idx + 1) AS before FROM {name}_s WHERE idx + 1 < n),
{name} AS (SELECT {key}, n, i AS cp, height, before FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY e, i) AS rn FROM {name}_e) t WHERE rn = 1)"""


_U = "(SELECT DISTINCT user_id FROM events)"
_Z = " + ".join(f"{w} * coalesce(CAST(embedding[{int(k[1:]) + 1}] AS DOUBLE), 0)" for k, w in sorted(WEIGHTS.items()) if k != "f99")
ORACLES = {
    "curve_average": f"""WITH {SCORED}, r AS (SELECT user_id, rule, CAST(floor("start" / 86400) AS INTEGER) AS idx, max(prob) AS p FROM scored GROUP BY ALL), n AS (SELECT user_id, count(DISTINCT rule) AS n FROM r GROUP BY user_id)
SELECT user_id, idx, round(sum(p) / any_value(n), 6) AS p FROM r JOIN n USING (user_id) GROUP BY user_id, idx""",
    "curve_changepoint": f'''WITH {_DAYS}, {_change('days', 'c')} SELECT u.user_id, CAST(coalesce(cp, 0) AS INTEGER) AS "at" FROM {_U} u LEFT JOIN c USING (user_id)''',
    "curve_step": f'''WITH {_DAYS}, {_change('days', 'c')} SELECT u.user_id, CAST(coalesce(cp, 0) AS INTEGER) AS "at", round(coalesce(height, 0), 6) AS height FROM {_U} u LEFT JOIN c USING (user_id)''',
    "curve_fit_start": f'''WITH {_DAYS}, {_change('days', 'c')} SELECT u.user_id, CAST(CASE WHEN height > 0 AND before < 0.5 THEN cp ELSE 0 END AS INTEGER) AS "at" FROM {_U} u LEFT JOIN c USING (user_id)''',
    "curve_start_edge": f"""WITH {_DAYS}, a AS (SELECT user_id, min("start") + 864000e0 AS a0, min("start") + 1728000e0 AS a1 FROM days GROUP BY user_id),
near AS (SELECT d.user_id, d."start", d.p, d.idx AS o, row_number() OVER (PARTITION BY d.user_id ORDER BY d.idx) - 1 AS idx, a0, a1 FROM days d JOIN a USING (user_id) WHERE d."start" >= a0 - 518400),
{_change('(SELECT user_id, idx, p FROM near)', 'c')},
f AS (SELECT c.user_id, n."start" AS s FROM c JOIN near n ON n.user_id = c.user_id AND n.idx = c.cp WHERE height > 0 AND before < 0.5),
i AS (SELECT user_id, arg_min("start", idx) AS s FROM near WHERE "start" >= a0 AND "start" < a1 AND p >= 0.25 GROUP BY user_id)
SELECT a.user_id, coalesce(f.s, i.s, a0) AS new_start, CASE WHEN f.s IS NOT NULL THEN 'fitted' WHEN i.s IS NOT NULL THEN 'inside' ELSE 'kept' END AS pick FROM a LEFT JOIN f USING (user_id) LEFT JOIN i USING (user_id)""",
    "curve_fit_end": f"""WITH {_DAYS}, len AS (SELECT user_id, count(*) AS n, max(p) AS m FROM days GROUP BY user_id),
w AS (SELECT user_id, unnest(range(least(5, n), n + 1)) AS w FROM len WHERE n >= 2),
pre AS (SELECT d.user_id * 1000 + w.w AS k, d.idx, d.p FROM days d JOIN w ON w.user_id = d.user_id AND d.idx < w.w), {_change('pre', 'c', 'k')},
hit AS (SELECT k // 1000 AS user_id, arg_min(cp, k) AS cp FROM c WHERE round(height, 12) >= 0.12 GROUP BY k // 1000)
SELECT l.user_id, CAST(CASE WHEN n < 2 THEN 0 ELSE cp END AS INTEGER) AS end_idx, CASE WHEN n < 2 THEN 'short' WHEN cp IS NOT NULL THEN 'fitted' WHEN m < 0.3 THEN 'never' ELSE 'ambiguous' END AS state FROM len l LEFT JOIN hit USING (user_id)""",
    "curve_end_walk": f"""WITH {_DAYS} SELECT user_id, CAST(coalesce(min(idx) FILTER (WHERE idx >= 3 AND p < 0.15), count(*)) AS INTEGER) AS end_idx FROM days GROUP BY user_id""",
    "curve_trim_outro": f"""WITH {SEG} SELECT user_id, round(greatest(min("start"), coalesce(min("start") FILTER (WHERE prob >= 0.6), min("start"))), 6) AS "start", round(max("end"), 6) AS "end" FROM seg GROUP BY user_id""",
    "score_logistic": f"SELECT vec_id, round(1 / (1 + exp(-greatest(-30.0, least(30.0, -0.2 + {_Z})))), 6) AS score FROM embeddings",
    "score_missing": "SELECT vec_id, 'a0,f99' AS missing FROM embeddings",
    "score_feature_pivot": f"""WITH {SEG}, m AS (SELECT user_id, max(prob) FILTER (WHERE rule = 'view') AS v, max(prob) FILTER (WHERE rule = 'click') AS c, max(prob) FILTER (WHERE rule = 'purchase') AS p, CAST(count(DISTINCT rule) AS INTEGER) AS n FROM seg GROUP BY user_id)
SELECT user_id, round(1 / (1 + exp(-(0.1 + coalesce(c, 0) * -0.5 + coalesce(p, 0) * 0.7 + coalesce(v, 0) * 1.5))), 6) AS score, n FROM m""",
    "score_scan_rule": f"""WITH {SEG}, r AS (SELECT user_id, rule, round(avg(prob), 6) AS p FROM seg GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, rule) AS k FROM r WHERE rule IN ('error', 'purchase', 'signup') AND p > 0)
SELECT u.user_id, coalesce(max(rule) FILTER (WHERE k = 1), 'content') AS rule, round(coalesce(sum(p), 0), 6) AS prob FROM {_U} u LEFT JOIN o USING (user_id) GROUP BY u.user_id""",
    "score_answer_problem": f"""WITH {SEG}, r AS (SELECT user_id, rule, round(avg(prob), 6) AS p FROM seg GROUP BY ALL)
SELECT user_id, CASE WHEN count(*) < 5 THEN 'keys' WHEN bool_or(p < 0 OR p > 1) THEN 'range' WHEN abs(sum(p) - 1) > 0.2 THEN 'sum' END AS problem FROM r GROUP BY user_id""",
    "eval_edge_summary": f"""WITH {SCORED}, o AS (SELECT rule, round("start" % 120 - 60, 6) AS x FROM scored), l AS (SELECT rule, list_sort(list(abs(x))) AS a FROM o GROUP BY rule)
SELECT o.rule, count(*) AS n, round(any_value(l.a[len(l.a) // 2 + 1]), 3) AS median, count(*) FILTER (WHERE abs(x) <= 20) AS "within", count(*) FILTER (WHERE x < -20) AS early, round(coalesce(sum(-x) FILTER (WHERE x < -20), 0), 3) AS early_seconds,
count(*) FILTER (WHERE x > 20) AS late, round(coalesce(sum(x) FILTER (WHERE x > 20), 0), 3) AS late_seconds FROM o JOIN l USING (rule) GROUP BY o.rule""",
}
