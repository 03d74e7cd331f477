"""Queries of feature rows, group fits and edge rules against labelled blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from . import edges, features, fitting
from .queries_curves import _DAYS, _change, _days
from .queries_intervals import _LABELS, _blocks, _labels
from .tables import CUES, GAP, cues, rounded, table

KEY = ["user_id"]
DAY = 86400.0
FLOORS = [0.1, 0.15, 0.2, 0.3, 0.5]
ENDS = [(0.05, 0.1, 0.8), (0.1, 0.2, 0.85), (0.2, 0.3, 0.9), (0.9, 0.05, 0.95), (0.9, 0.99, 0.5)]


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second third of each user's days as an anchor, with the label block that it overlaps most."""
    days = _days(spark, sf_dir)
    anchors = days.groupBy("user_id").agg((F.min("start") + 10 * DAY).alias("anchor_start"), (F.min("start") + 20 * DAY).alias("anchor_end")).withColumn("anchor", F.lit(0))
    return edges.region_blocks(anchors, _labels(spark, sf_dir), KEY, GAP)


def _start_grid(spark, sf_dir):
    points = _days(spark, sf_dir).select("user_id", F.lit(0).alias("anchor"), "idx", "start", "p")
    return edges.start_grid(_regions(spark, sf_dir), points, KEY, FLOORS, 6 * DAY)


def eval_start_grid(spark, sf_dir):
    return rounded(_start_grid(spark, sf_dir).select("user_id", "floor", "edge", "off"), "edge", "off", digits=3)


def eval_start_grid_summary(spark, sf_dir):
    """Errors of each start rule, in days."""
    offsets = _start_grid(spark, sf_dir).withColumn("off", F.round(F.col("off") / DAY, 6))
    return rounded(edges.summaries(offsets, ["floor"], 2.0), "median", "early_seconds", "late_seconds", digits=3)


def eval_end_grid(spark, sf_dir):
    r = _regions(spark, sf_dir)
    days = _days(spark, sf_dir).join(r.select("user_id", "anchor", "anchor_start"), "user_id").where(F.col("start") >= F.col("anchor_start"))
    points = days.select("user_id", "anchor", "idx", F.col("start").alias("p_start"), (F.col("start") + DAY).alias("p_end"), "p", F.round(1 - F.col("p"), 6).alias("ad"))
    return rounded(edges.end_grid(r, points, KEY, ENDS, 5).select("user_id", "step", "never", "extend", "edge", "off"), "edge", "off", digits=3)


def _answers(spark, sf_dir, names):
    """An answer of each feature about each turn, of its length and the feature's number."""
    each = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("number", "feature")
    value = (F.length("text") * (F.col("number") + 2)) % 101 / 100.0
    return cues(spark, sf_dir).select("conv_id", F.col("seq").alias("idx"), "text", each).select("conv_id", "idx", "feature", value.alias("value"))


def _sentences(spark, sf_dir):
    return cues(spark, sf_dir).select("conv_id", F.col("seq").alias("idx"), "start", "end", "text")


def _shown(rows: DataFrame, edge: str) -> DataFrame:
    return rounded(rows.select("conv_id", "idx", F.md5("previous").alias("previous"), "place", *features.feature_names(edge)), "place")


def feat_start_rows(spark, sf_dir):
    return _shown(features.feature_rows(_sentences(spark, sf_dir), _answers(spark, sf_dir, features.START_FEATURES), ["conv_id"]), "start")


def _end_rows(spark, sf_dir):
    said = cues(spark, sf_dir).select("conv_id", F.col("seq").alias("idx"), (F.length("text") % 11 / 10.0).alias("value"))
    return features.feature_rows(_sentences(spark, sf_dir), _answers(spark, sf_dir, features.END_FEATURES), ["conv_id"], "end", said)


def feat_end_rows(spark, sf_dir):
    return _shown(_end_rows(spark, sf_dir), "end")


def _segments(spark, sf_dir):
    """Turns of the user's that mention a price or an offer as label segments; long ones are borderline."""
    c = cues(spark, sf_dir).where(F.length("text") % 5 < 2)
    return c.select("conv_id", "seq", "start", (F.col("end") + 4).alias("end"), (F.length("text") > 120).alias("borderline"))


def feat_labels(spark, sf_dir):
    rows = features.labelled(_end_rows(spark, sf_dir), _segments(spark, sf_dir), ["conv_id"])
    return rows.select("conv_id", "idx", "label")


def feat_training_counts(spark, sf_dir):
    return features.training_counts(features.labelled(_end_rows(spark, sf_dir), _segments(spark, sf_dir), ["conv_id"]), ["conv_id"])


def fit_group_out(spark, sf_dir):
    """Toxic labels by models that have not seen the document's source."""
    d = table(spark, sf_dir, "documents")
    f = d.select("doc_id", "source", (F.length("text") / 10000).alias("f_len"), (F.size(F.split("text", r"\s+")) / 1000).alias("f_words"), F.contains(F.lower("text"), F.lit("idiot")).cast("double").alias("f_a"), F.contains(F.lower("text"), F.lit("trash")).cast("double").alias("f_b"))
    rows = f.dropna().join(table(spark, sf_dir, "labels").select("doc_id", "toxic").dropna(), "doc_id")
    out = fitting.leave_group_out(rows, ["f_a", "f_b", "f_len", "f_words"], "toxic", "source", 1.0, 3.0)
    return rounded(out.select("doc_id", "toxic", "source", "p"), "p", digits=6)


def eval_medians(spark, sf_dir):
    """Median of the prices of each priority, and of all lines: groups beyond what is listed at once."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    return E.upper_medians(lines.unionByName(lines.withColumn("flag", F.lit(None).cast("string"))), ["flag"], "price")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("eval_", "feat_", "fit_")) and callable(f)}

_REGIONS = f"""{_DAYS}, {_LABELS}, {_blocks("lab", GAP)},
a AS (SELECT user_id, min("start") + {10 * DAY} AS a0, min("start") + {20 * DAY} AS a1 FROM days GROUP BY user_id),
region AS (SELECT * FROM (
  SELECT a.user_id, a0, a1, required, b."start" AS start_lo, start_hi, end_lo, b."end" AS end_hi,
         row_number() OVER (PARTITION BY a.user_id ORDER BY least(a1, b."end") - greatest(a0, b."start") DESC, b."start", b."end") AS place
  FROM a JOIN blk b ON b.user_id = a.user_id AND least(a1, b."end") - greatest(a0, b."start") > 0) t WHERE place = 1 AND required)"""
_FLOOR = ", ".join(f"({f}e0)" for f in FLOORS)
_START = f"""{_REGIONS},
near AS (SELECT d.user_id, d."start", d.p, row_number() OVER (PARTITION BY d.user_id ORDER BY d.idx) - 1 AS idx FROM days d JOIN region USING (user_id) WHERE d."start" >= a0 - {6 * DAY}),
{_change('(SELECT user_id, idx, p FROM near)', 'c')},
f AS (SELECT c.user_id, n."start" AS s FROM c JOIN near n ON n.user_id = c.user_id AND n.idx = c.cp WHERE height > 0 AND before < 0.5),
edge AS (SELECT r.user_id, "floor", any_value(r.start_lo) AS lo, any_value(r.start_hi) AS hi,
  coalesce(any_value(f.s), min(d."start") FILTER (WHERE d."start" >= a0 AND d.p >= "floor"), any_value(a0)) AS edge
  FROM region r CROSS JOIN (VALUES {_FLOOR}) g("floor") JOIN days d ON d.user_id = r.user_id LEFT JOIN f ON f.user_id = r.user_id GROUP BY r.user_id, "floor"),
offs AS (SELECT user_id, "floor", edge, CASE WHEN edge < lo THEN edge - lo WHEN edge > hi THEN edge - hi ELSE 0.0 END AS off FROM edge)"""
_GRID = ", ".join(f"({i}, {s}e0, {n}e0, {x}e0)" for i, (s, n, x) in enumerate(ENDS))
_END = f"""{_REGIONS},
pts AS (SELECT d.user_id, d."start", d.p, round(1 - d.p, 6) AS ad, row_number() OVER (PARTITION BY d.user_id ORDER BY d.idx) - 1 AS idx FROM days d JOIN region USING (user_id) WHERE d."start" >= a0),
len AS (SELECT user_id, count(*) AS n, max(p) AS m, max("start") + {DAY} AS e FROM pts GROUP BY user_id),
w AS (SELECT user_id, unnest(range(least(5, n), n + 1)) AS w FROM len WHERE n >= 2),
pre AS (SELECT d.user_id * 1000 + w.w AS k, d.idx, d.p FROM pts d JOIN w ON w.user_id = d.user_id AND d.idx < w.w), {_change('pre', 'c', 'k')},
g AS (SELECT * FROM (VALUES {_GRID}) g(i, step, "never", extend)),
fit AS (SELECT k // 1000 AS user_id, i, arg_min(cp, k) AS cp FROM c, g WHERE round(height, 12) >= step GROUP BY k // 1000, i),
base AS (SELECT r.*, l.n, l.e, g.*, CASE WHEN n < 2 THEN 0 WHEN cp IS NOT NULL THEN cp WHEN m < "never" THEN n ELSE
    coalesce((SELECT min(idx) FROM pts p WHERE p.user_id = r.user_id AND p."start" < a1 AND p.ad >= extend), (SELECT min(idx) FROM pts p WHERE p.user_id = r.user_id AND p."start" >= a1), n) END AS b
  FROM region r JOIN len l USING (user_id) CROSS JOIN g LEFT JOIN fit ON fit.user_id = r.user_id AND fit.i = g.i),
walk AS (SELECT *, coalesce((SELECT min(idx) FROM pts p WHERE p.user_id = base.user_id AND p.idx >= b AND p.ad < extend), n) AS z FROM base),
edge AS (SELECT w.*, CASE WHEN z >= n THEN greatest(e, a1) ELSE (SELECT any_value(p."start") FROM pts p WHERE p.user_id = w.user_id AND p.idx = z) END AS edge FROM walk w)"""
_NEEDLE = {name: "CAST(" + " OR ".join(f"contains(lower(text), '{n}')" for n in needles) + f" AS DOUBLE) AS {name}" for name, needles in features.LEXICAL.items()}


def _feature_sql(edge: str) -> str:
    names = features.START_FEATURES if edge == "start" else features.END_FEATURES
    columns = [f"(length(text) * {i + 2}) % 101 / 100e0 AS {n}" for i, n in enumerate(names)]
    columns += list(_NEEDLE.values()) + ([f"length(text) % 11 / 10e0 AS {features.PREDICATE}"] if edge == "end" else [])
    return f"""WITH {CUES} SELECT conv_id, seq AS idx, md5(coalesce(lag(text) OVER w, '')) AS previous,
round(CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN (row_number() OVER w - 1) / CAST(count(*) OVER (PARTITION BY conv_id) - 1 AS DOUBLE) ELSE 0 END, 6) AS place, {", ".join(columns)}
FROM cues WINDOW w AS (PARTITION BY conv_id ORDER BY seq)"""


_LABELLED = f"""{CUES}, s AS (SELECT conv_id, seq, "start", "end" + 4 AS "end", length(text) > 120 AS borderline FROM cues WHERE length(text) % 5 < 2),
l AS (SELECT c.conv_id, c.seq AS idx, arg_min(s.borderline, s.seq) AS b FROM cues c LEFT JOIN s ON s.conv_id = c.conv_id AND s."start" <= (c."start" + c."end") / 2 AND (c."start" + c."end") / 2 < s."end" GROUP BY c.conv_id, c.seq),
lab AS (SELECT conv_id, idx, CASE WHEN b IS NULL THEN 0 WHEN NOT b THEN 1 END AS label FROM l)"""
ORACLES = {
    "eval_start_grid": f"""WITH {_START} SELECT user_id, "floor", round(edge, 3) AS edge, round(off, 3) AS off FROM offs""",
    "eval_start_grid_summary": f"""WITH {_START}, o AS (SELECT "floor", round(off / {DAY}, 6) AS x FROM offs), l AS (SELECT "floor", list_sort(list(abs(x))) AS a FROM o GROUP BY "floor")
SELECT o."floor", count(*) AS n, round(any_value(l.a[len(l.a) // 2 + 1]), 3) AS median, count(*) FILTER (WHERE abs(x) <= 2) AS "within", count(*) FILTER (WHERE x < -2) AS early, round(coalesce(sum(-x) FILTER (WHERE x < -2), 0), 3) AS early_seconds,
count(*) FILTER (WHERE x > 2) AS late, round(coalesce(sum(x) FILTER (WHERE x > 2), 0), 3) AS late_seconds FROM o JOIN l USING ("floor") GROUP BY o."floor\"""",
    "eval_end_grid": f"""WITH {_END} SELECT user_id, step, "never", extend, round(edge, 3) AS edge, round(CASE WHEN edge < end_lo THEN edge - end_lo WHEN edge > end_hi THEN edge - end_hi ELSE 0.0 END, 3) AS off FROM edge""",
    "eval_medians": """WITH l AS (SELECT l_returnflag AS flag, l_extendedprice AS price FROM lineitem UNION ALL SELECT NULL, l_extendedprice FROM lineitem),
o AS (SELECT flag, price, row_number() OVER (PARTITION BY flag ORDER BY price) - 1 AS k, count(*) OVER (PARTITION BY flag) AS n FROM l WHERE price IS NOT NULL)
SELECT flag, CAST(price AS DOUBLE) AS median FROM o WHERE k = n // 2""",
    "feat_start_rows": _feature_sql("start"),
    "feat_end_rows": _feature_sql("end"),
    "feat_labels": f"WITH {_LABELLED} SELECT conv_id, idx, CAST(label AS INTEGER) AS label FROM lab",
    "feat_training_counts": f"WITH {_LABELLED} SELECT count(*) AS \"rows\", count(label) AS labelled, count(*) FILTER (WHERE label = 1) AS ads, count(*) FILTER (WHERE label = 0) AS content, count(DISTINCT conv_id) AS episodes FROM lab",
}
