"""Queries of the interval algebra and of runs of scored windows, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import intervals as I
from ..operators import ranked as RK
from ..operators import runs as R
from .tables import DURATION, GAP, SCORED, SEG, THRESHOLD, episodes, merged_sql, rounded, scored, segments

KEY = ["user_id"]


def _kept(df: DataFrame) -> DataFrame:
    return rounded(df.select("user_id", "start", "end"), "start", "end")


def _of(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("rule").isin(*types))


def iv_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = R.bridge(R.clusters(scored(spark, sf_dir), KEY, THRESHOLD), KEY)
    cuts = I.merge(I.clamp(runs.select("user_id", "start", "end"), DURATION), KEY, GAP)
    eps = episodes(spark, sf_dir)
    kept = I.keep_ranges(cuts, eps, KEY, 1.0)
    by_cut = cuts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_cuts"), F.sum(F.col("end") - F.col("start")).alias("cut_seconds"))
    out = eps.join(by_cut, KEY, "left").join(I.total(kept, KEY, "kept_seconds"), KEY, "left")
    cut = F.coalesce("cut_seconds", F.lit(0.0))
    return rounded(
        out.select("user_id", F.coalesce("n_cuts", F.lit(0)).alias("n_cuts"), cut.alias("cut_seconds"), F.coalesce("kept_seconds", F.lit(0.0)).alias("kept_seconds"), (cut / DURATION).alias("share")),
        "cut_seconds", "kept_seconds", "share", digits=3,
    )


def iv_clamp(spark, sf_dir):
    shifted = segments(spark, sf_dir).withColumns({"start": F.col("start") - 43200, "end": F.col("end") - 43200})
    return rounded(I.clamp(shifted, DURATION - 86400).select("event_id", "start", "end"), "start", "end")


def iv_pad(spark, sf_dir):
    return rounded(I.pad(segments(spark, sf_dir), 600.0, 1200.0, DURATION).select("event_id", "start", "end"), "start", "end")


def iv_merge_gap(spark, sf_dir):
    return _kept(I.merge(segments(spark, sf_dir).select("user_id", "start", "end"), KEY, GAP))


def iv_merge_mixed(spark, sf_dir):
    return rounded(I.merge(segments(spark, sf_dir), KEY, GAP).select("user_id", "start", "end", "rule", "source", "confidence"), "start", "end", "confidence")


def iv_keep_ranges(spark, sf_dir):
    return _kept(I.keep_ranges(segments(spark, sf_dir), episodes(spark, sf_dir), KEY, 60.0))


def iv_prepare(spark, sf_dir):
    cuts, kept = I.prepare(segments(spark, sf_dir), episodes(spark, sf_dir), KEY, 300.0, 300.0, GAP, 60.0)
    return rounded(cuts.select("user_id", F.lit("cut").alias("kind"), "start", "end").unionByName(kept.select("user_id", F.lit("keep").alias("kind"), "start", "end")), "start", "end")


def iv_total_covered(spark, sf_dir):
    s = segments(spark, sf_dir)
    return rounded(I.total(s, KEY).join(I.covered(s, KEY), KEY), "total", "covered", digits=3)


def iv_union(spark, sf_dir):
    return _kept(I.union(segments(spark, sf_dir), KEY, DURATION - 86400))


def _sides(spark, sf_dir):
    s = segments(spark, sf_dir)
    return _of(s, "view"), _of(s, "click", "error")


def iv_difference(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return _kept(I.difference(left, right, KEY))


def iv_intersection(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return _kept(I.intersection(left, right, KEY))


def _labels(spark, sf_dir):
    return _of(segments(spark, sf_dir), "purchase", "signup").withColumn("borderline", F.col("rule") == "signup")


def iv_blocks(spark, sf_dir):
    cols = ["start", "end", "start_lo", "start_hi", "end_lo", "end_hi"]
    return rounded(I.blocks(_labels(spark, sf_dir), KEY, GAP).select("user_id", "required", "parts", *cols), *cols)


def iv_off(spark, sf_dir):
    s = segments(spark, sf_dir)
    x = I.off(F.col("start") % 3600, F.lit(900.0), F.lit(2700.0))
    return rounded(s.select("event_id", x.alias("off")), "off")


def iv_score_views(spark, sf_dir):
    """All views at once: the view is part of the key."""
    views = F.explode(F.array(F.lit("wide"), F.lit("narrow")))
    error = F.col("rule") == "error"
    taken = F.array_compact(F.array(F.when(error | (F.col("rule") == "click"), "wide"), F.when(error & (F.col("prob") >= 0.2), "narrow")))
    cuts = segments(spark, sf_dir).select("user_id", "start", "end", F.explode(taken).alias("view"))
    out = E.score(_labels(spark, sf_dir).withColumn("view", views), cuts, episodes(spark, sf_dir).withColumn("view", views), ["view", *KEY])
    return rounded(out, "content_lost", "worst", "required_left", digits=3)


def iv_score_rollup(spark, sf_dir):
    scores = E.score(_labels(spark, sf_dir), _of(segments(spark, sf_dir), "error", "click").select("user_id", "start", "end"), episodes(spark, sf_dir), KEY)
    return rounded(E.rollup(scores, 3600.0), "content_lost", "worst", "required_left", digits=2)


def iv_interior_left(spark, sf_dir):
    b = I.blocks(_labels(spark, sf_dir), KEY, GAP).where("required")
    left = I.interior_left(b, _of(segments(spark, sf_dir), "view", "click", "error"), KEY)
    return rounded(left, "b_start", "b_end", "left", digits=3)


def iv_overlap_semi(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return I.overlapping(left, right.select("user_id", "start", "end"), KEY, "left_semi").select("event_id")


def iv_overlap_anti(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return I.overlapping(left, right.select("user_id", "start", "end"), KEY, "left_anti").select("event_id")


def _twice(spark, sf_dir):
    """Left rows without their ids, so that some are equal, each twice, and rows of nulls; and right rows."""
    left, right = _sides(spark, sf_dir)
    day = left.select("user_id", (F.floor(F.col("start") / 86400) * 86400.0).alias("start"), (F.floor(F.col("start") / 86400) * 86400.0 + 3600.0).alias("end"), F.when(F.col("event_id") % 2 == 0, F.col("rule")).alias("rule"))
    nulls = day.select("user_id", F.lit(None).cast("double").alias("start"), F.col("end"), "rule")
    return day.unionByName(day).unionByName(nulls), right.select("user_id", "start", "end")


def iv_overlap_semi_bucketed(spark, sf_dir):
    return I.overlapping(*_twice(spark, sf_dir), KEY, "left_semi", bucket=7200.0)


def iv_overlap_anti_bucketed(spark, sf_dir):
    return I.overlapping(*_twice(spark, sf_dir), KEY, "left_anti", bucket=7200.0)


def iv_overlap_bucketed(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    pairs = I.overlapping(left.select("user_id", "event_id", "start", "end"), right.select("user_id", "start", "end", F.col("event_id").alias("other_id")), KEY, bucket=7200.0)
    return pairs.select("event_id", "other_id")


def iv_overlap_argmax(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    best = I.greatest_overlap(left.select("user_id", "event_id", "start", "end"), right.select("user_id", "start", "end", F.col("event_id").alias("other_id")), KEY, ["event_id"], ["other_id"])
    return rounded(best.select("event_id", "other_id", "overlap"), "overlap")


def iv_overlap_argmax_bucketed(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    best = I.greatest_overlap(left.select("user_id", "event_id", "start", "end"), right.select("user_id", "start", "end", F.col("event_id").alias("other_id")), KEY, ["event_id"], ["other_id"], bucket=7200.0)
    return rounded(best.select("event_id", "other_id", "overlap"), "overlap")


def iv_overlap_ranked(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    pairs = RK.overlapping(left.select("user_id", "event_id", "start", "end"), right.select("user_id", "start", "end", F.col("event_id").alias("other_id")), KEY)
    return pairs.select("event_id", "other_id")


def iv_overlap_semi_ranked(spark, sf_dir):
    return RK.meeting(*_twice(spark, sf_dir), KEY, "left_semi")


def iv_overlap_anti_ranked(spark, sf_dir):
    return RK.meeting(*_twice(spark, sf_dir), KEY, "left_anti")


def iv_overlap_argmax_ranked(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    best = RK.greatest_overlap(left.select("user_id", "event_id", "start", "end"), right.select("user_id", "start", "end", F.col("event_id").alias("other_id")), KEY, ["other_id"])
    return rounded(best.select("event_id", "other_id", "overlap"), "overlap")


def iv_nearest_ranked(spark, sf_dir):
    s = segments(spark, sf_dir)
    clicks = _of(s, "click").select("user_id", ((F.col("start") + F.col("end")) / 2).alias("middle"))
    out = RK.nearest(_of(s, "view").select("user_id", "event_id", "start"), clicks, KEY, "start", "middle", 7200.0)
    return rounded(out.select("event_id", F.coalesce("nearest", "start").alias("snapped")), "snapped")


def iv_same_start(spark, sf_dir):
    """Views against all other events, with starts to the hour so that some are equal."""
    left, _ = _sides(spark, sf_dir)
    hour = lambda df: df.withColumn("start", F.floor(F.col("start") / 3600) * 3600.0)
    right = hour(_of(segments(spark, sf_dir), "click", "error", "signup")).select("user_id", "start", "end", F.col("event_id").alias("other_id"))
    best = I.same_start_or_greatest_overlap(hour(left).select("user_id", "event_id", "start", "end"), right, KEY, ["event_id"], ["other_id"])
    return best.select("event_id", "other_id", "by")


def iv_point_in_bucketed(spark, sf_dir):
    s = segments(spark, sf_dir)
    points = _of(s, "view").select("user_id", "event_id", ((F.col("start") + F.col("end")) / 2).alias("middle"))
    held = _of(s, "click", "error", "signup").withColumnRenamed("event_id", "seq")
    return I.containing(points, held, KEY, "middle", ["event_id"], "seq", "rule", bucket=7200.0).select("event_id", "rule")


def iv_nearest_bucketed(spark, sf_dir):
    s = segments(spark, sf_dir)
    out = I.snapped(_of(s, "view").select("user_id", "event_id", "start"), _of(s, "click").select("user_id", "start", "end"), KEY, "start", ["event_id"], 7200.0, bucket=3600.0)
    return rounded(out.select("event_id", "snapped"), "snapped")


def iv_interior_left_bucketed(spark, sf_dir):
    b = I.blocks(_labels(spark, sf_dir), KEY, GAP).where("required")
    left = I.interior_left(b, _of(segments(spark, sf_dir), "view", "click", "error"), KEY, bucket=43200.0)
    return rounded(left, "b_start", "b_end", "left", digits=3)


def iv_point_in(spark, sf_dir):
    s = segments(spark, sf_dir)
    points = _of(s, "view").select("user_id", "event_id", ((F.col("start") + F.col("end")) / 2).alias("middle"))
    held = _of(s, "click", "error", "signup").withColumnRenamed("event_id", "seq")
    return I.containing(points, held, KEY, "middle", ["event_id"], "seq", "rule").select("event_id", "rule")


def iv_nearest(spark, sf_dir):
    s = segments(spark, sf_dir)
    out = I.snapped(_of(s, "view").select("user_id", "event_id", "start"), _of(s, "click").select("user_id", "start", "end"), KEY, "start", ["event_id"], 7200.0)
    return rounded(out.select("event_id", "snapped"), "snapped")


def iv_tail_trim(spark, sf_dir):
    s = segments(spark, sf_dir)
    last = s.groupBy("user_id").agg(F.max("end").alias("speech_end")).withColumns({"duration": F.lit(DURATION), "keep_tail": F.col("user_id") % 7 == 0})
    return _kept(I.tail_trim(_of(s, "error").select("user_id", "start", "end"), last, KEY))


def iv_cut_pattern(spark, sf_dir):
    return _kept(I.cut_pattern(episodes(spark, sf_dir), KEY, 86400.0, 900.0))


def run_clusters(spark, sf_dir):
    return rounded(R.clusters(scored(spark, sf_dir), KEY, THRESHOLD), "start", "end", "prob")


def run_bridge(spark, sf_dir):
    return rounded(R.bridge(R.clusters(scored(spark, sf_dir), KEY, 0.2), KEY, GAP), "start", "end", "prob")


def run_weak_leads(spark, sf_dir):
    return rounded(R.weak_leads(scored(spark, sf_dir), KEY, 0.15, THRESHOLD), "start", "end", "prob")


def run_rule_vote(spark, sf_dir):
    day = scored(spark, sf_dir).withColumn("day", F.floor(F.col("start") / 86400).cast("int"))
    return rounded(R.votes(day, KEY, "day"), "votes")


def run_batches(spark, sf_dir):
    return R.batches(scored(spark, sf_dir).select("user_id", "event_id", "idx"), KEY, 24).select("event_id", "batch", "context")


def run_region_filter(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("localized", F.col("rule") == "view")
    return R.region_filter(s, 1800.0, 600.0).groupBy("user_id", "kept").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith(("iv_", "run_")) and callable(f)}

_R2 = 'round("start", 6) AS "start", round("end", 6) AS "end"'
_CLUSTERS = """q AS (SELECT *, rule <> 'content' AND prob >= {t} AS ok FROM scored),
qi AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM q),
qs AS (SELECT user_id, g, min("start") AS "start", max("end") AS "end", max(prob) AS prob, count(*) AS windows FROM qi WHERE ok GROUP BY ALL),
qv AS (SELECT user_id, g, rule, row_number() OVER (PARTITION BY user_id, g ORDER BY sum(prob) DESC, rule) AS n FROM qi WHERE ok GROUP BY user_id, g, rule),
runs AS (SELECT user_id, rule, "start", "end", prob, windows FROM qs JOIN qv USING (user_id, g) WHERE n = 1)"""
_BRIDGE = """b1 AS (SELECT *, CASE WHEN rule = lag(rule) OVER w AND "start" - lag("end") OVER w <= {gap} THEN 0 ELSE 1 END AS fresh FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end")),
b2 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g2 FROM b1),
bridged AS (SELECT user_id, min(rule) AS rule, min("start") AS "start", arg_max("end", "start") AS "end", max(prob) AS prob, CAST(sum(windows) AS BIGINT) AS windows FROM b2 GROUP BY user_id, g2)"""


def _clamped(source: str, name: str, d: float = DURATION, more: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT user_id{more}, greatest(0.0, least("start", {d})) AS "start", greatest(0.0, least("end", {d})) AS "end" FROM {source}) t WHERE "end" - "start" > 0.05)"""


def _keeps(cuts: str, min_keep: float, name: str = "kept") -> str:
    return f"""{name}_k AS (SELECT user_id, "start", "end" FROM {cuts} UNION ALL SELECT DISTINCT user_id, {DURATION}, {DURATION} FROM events),
{name} AS (SELECT user_id, f AS "start", s AS "end" FROM (SELECT user_id, "start" AS s, lag("end", 1, 0.0) OVER (PARTITION BY user_id ORDER BY "start", "end") AS f FROM {name}_k) t WHERE s - f >= {min_keep} AND s > f)"""


def _sweep(left: str, right: str, want: str, name: str, key: str = "user_id") -> str:
    ev = " UNION ALL ".join(
        f'SELECT {key}, "{c}" AS t, {a} AS d0, {b} AS d1 FROM {src} WHERE "end" > "start"'
        for src, side in ((left, 0), (right, 1)) for c, step in (("start", 1), ("end", -1)) for a, b in (((step, 0) if side == 0 else (0, step)),)
    )
    return f"""{name}_e AS ({ev}),
{name}_t AS (SELECT {key}, t, sum(d0) AS d0, sum(d1) AS d1 FROM {name}_e GROUP BY {key}, t),
{name}_r AS (SELECT {key}, t AS "start", lead(t) OVER (PARTITION BY {key} ORDER BY t) AS "end", sum(d0) OVER (PARTITION BY {key} ORDER BY t) AS c0, sum(d1) OVER (PARTITION BY {key} ORDER BY t) AS c1 FROM {name}_t),
{name}_p AS (SELECT {key}, "start", "end" FROM {name}_r WHERE "end" IS NOT NULL AND {want}),
{name}_q AS (SELECT *, CASE WHEN "start" <= lag("end") OVER (PARTITION BY {key} ORDER BY "start") THEN 0 ELSE 1 END AS f FROM {name}_p),
{name}_u AS (SELECT *, sum(f) OVER (PARTITION BY {key} ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}_q),
{name} AS (SELECT {key}, min("start") AS "start", max("end") AS "end" FROM {name}_u GROUP BY {key}, g)"""


_SIDES = """l AS (SELECT * FROM seg WHERE rule = 'view'), r AS (SELECT * FROM seg WHERE rule IN ('click', 'error'))"""
_MEET = 'l.user_id = r.user_id AND l."end" > r."start" AND l."start" < r."end"'
_LABELS = """lab AS (SELECT *, rule = 'signup' AS borderline FROM seg WHERE rule IN ('purchase', 'signup'))"""


def _blocks(source: str, gap: float, name: str = "blk") -> str:
    return f"""{name}_m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}_m),
{name} AS (SELECT user_id, min("start") AS "start", max("end") AS "end", bool_or(NOT borderline) AS required, count(*) AS parts,
  coalesce(min(CASE WHEN NOT borderline THEN "start" END), max("end")) AS start_hi, coalesce(max(CASE WHEN NOT borderline THEN "end" END), min("start")) AS end_lo FROM {name}_g GROUP BY user_id, g)"""


def _score(cut_where: str, name: str) -> str:
    """CTEs of one view's scores by user; lab and seg are there."""
    n = name
    return ",\n".join([
        _clamped("lab", f"{n}_lc0", DURATION, ", borderline").replace("> 0.05", "> 0"),
        f'{n}_cc0 AS (SELECT user_id, greatest(0.0, least("start", {DURATION})) AS "start", greatest(0.0, least("end", {DURATION})) AS "end" FROM seg WHERE {cut_where})',
        f'{n}_cc AS (SELECT * FROM {n}_cc0 WHERE "end" > "start")',
        merged_sql(f"{n}_cc", 0.0, f"{n}_cut"),
        f"{n}_must AS (SELECT * FROM {n}_lc0 WHERE NOT borderline)",
        _sweep(f"{n}_cut", f"{n}_lc0", "c0 > 0 AND c1 = 0", f"{n}_lost"),
        _sweep(f"{n}_must", f"{n}_cut", "c0 > 0 AND c1 = 0", f"{n}_left"),
        _blocks(f"{n}_lc0", 3.0, f"{n}_blk"),
        f'{n}_hit AS (SELECT b.user_id, b."start", b."end", coalesce(sum(CASE WHEN c.user_id IS NULL THEN 0.0 ELSE least(b."end", c."end") - greatest(b."start", c."start") END), 0.0) AS c FROM {n}_blk b LEFT JOIN {n}_cut c ON c.user_id = b.user_id AND c."end" > b."start" AND c."start" < b."end" WHERE b.required GROUP BY b.user_id, b."start", b."end")',
        f"""{n} AS (SELECT e.user_id, coalesce(l.s, 0.0) AS content_lost, coalesce(l.w, 0.0) AS worst, coalesce(k.s, 0.0) AS required_left,
  coalesce(h.missed, 0) AS missed, coalesce(h.partly, 0) AS partly, coalesce(h.fully, 0) AS fully
  FROM (SELECT DISTINCT user_id FROM events) e
  LEFT JOIN (SELECT user_id, sum("end" - "start") AS s, max("end" - "start") AS w FROM {n}_lost GROUP BY user_id) l USING (user_id)
  LEFT JOIN (SELECT user_id, sum("end" - "start") AS s FROM {n}_left GROUP BY user_id) k USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) FILTER (c <= 0) AS missed, count(*) FILTER (c > 0 AND "end" - "start" - c > 1e-9) AS partly, count(*) FILTER (c > 0 AND "end" - "start" - c <= 1e-9) AS fully FROM {n}_hit GROUP BY user_id) h USING (user_id))""",
    ])


_SCORE_COLS = "round(content_lost, 3) AS content_lost, round(worst, 3) AS worst, round(required_left, 3) AS required_left, missed, partly, fully"

ORACLES = {
    "iv_flagship": f"""WITH {SCORED}, {_CLUSTERS.format(t=THRESHOLD)}, {_BRIDGE.format(gap=90.0)}, {_clamped("bridged", "c")}, {merged_sql("c", GAP, "cuts")}, {_keeps("cuts", 1.0)}
SELECT e.user_id, coalesce(n, 0) AS n_cuts, round(coalesce(c, 0.0), 3) AS cut_seconds, round(coalesce(k, 0.0), 3) AS kept_seconds, round(coalesce(c, 0.0) / {DURATION}, 3) AS share
FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (SELECT user_id, count(*) AS n, sum("end" - "start") AS c FROM cuts GROUP BY user_id) a USING (user_id)
LEFT JOIN (SELECT user_id, sum("end" - "start") AS k FROM kept GROUP BY user_id) b USING (user_id)""",
    "iv_clamp": f"""WITH {SEG}, s AS (SELECT event_id, greatest(0.0, least("start" - 43200, {DURATION - 86400})) AS "start", greatest(0.0, least("end" - 43200, {DURATION - 86400})) AS "end" FROM seg)
SELECT event_id, {_R2} FROM s WHERE "end" - "start" > 0.05""",
    "iv_pad": f"""WITH {SEG}, s AS (SELECT event_id, greatest(0.0, least("start" - 600, {DURATION})) AS "start", greatest(0.0, least("end" + 1200, {DURATION})) AS "end" FROM seg)
SELECT event_id, {_R2} FROM s WHERE "end" - "start" > 0.05""",
    "iv_merge_gap": f"""WITH {SEG}, {merged_sql("seg", GAP, "m")} SELECT user_id, {_R2} FROM m""",
    "iv_merge_mixed": f"""WITH {SEG}, {merged_sql("seg", GAP, "m", ", CASE WHEN count(DISTINCT rule) = 1 THEN min(rule) ELSE 'mixed' END AS rule, 'events' AS source, min(confidence) AS confidence")}
SELECT user_id, {_R2}, rule, source, round(confidence, 6) AS confidence FROM m""",
    "iv_keep_ranges": f"""WITH {SEG}, {_clamped("seg", "c")}, {merged_sql("c", 0.0, "cuts")}, {_keeps("cuts", 60.0)} SELECT user_id, {_R2} FROM kept""",
    "iv_prepare": f"""WITH {SEG}, {_clamped("seg", "c")}, p0 AS (SELECT user_id, "start" - 300 AS "start", "end" + 300 AS "end" FROM c), {_clamped("p0", "p")}, {merged_sql("p", GAP, "cuts")}, {_keeps("cuts", 60.0)}
SELECT user_id, 'cut' AS kind, {_R2} FROM cuts UNION ALL SELECT user_id, 'keep', round("start", 6), round("end", 6) FROM kept""",
    "iv_total_covered": f"""WITH {SEG}, {merged_sql("seg", 0.0, "m")}
SELECT user_id, round(total, 3) AS total, round(covered, 3) AS covered FROM (SELECT user_id, sum("end" - "start") AS total FROM seg GROUP BY user_id) a JOIN (SELECT user_id, sum("end" - "start") AS covered FROM m GROUP BY user_id) b USING (user_id)""",
    "iv_union": f"""WITH {SEG}, {_clamped("seg", "c", DURATION - 86400).replace("> 0.05", "> 0")}, {merged_sql("c", 0.0, "m")} SELECT user_id, {_R2} FROM m""",
    "iv_difference": f"""WITH {SEG}, {_SIDES}, {_sweep("l", "r", "c0 > 0 AND c1 = 0", "d")} SELECT user_id, {_R2} FROM d""",
    "iv_intersection": f"""WITH {SEG}, {_SIDES}, {_sweep("l", "r", "c0 > 0 AND c1 > 0", "d")} SELECT user_id, {_R2} FROM d""",
    "iv_blocks": f"""WITH {SEG}, {_LABELS}, {_blocks("lab", GAP)}
SELECT user_id, required, parts, {_R2}, round("start", 6) AS start_lo, round(start_hi, 6) AS start_hi, round(end_lo, 6) AS end_lo, round("end", 6) AS end_hi FROM blk""",
    "iv_off": f"""WITH {SEG}, m AS (SELECT event_id, "start" % 3600 AS x FROM seg)
SELECT event_id, round(CASE WHEN x < 900 THEN x - 900 WHEN x > 2700 THEN x - 2700 ELSE 0.0 END, 6) AS off FROM m""",
    "iv_score_views": f"""WITH {SEG}, {_LABELS}, {_score("rule IN ('error', 'click')", "wide")}, {_score("rule = 'error' AND prob >= 0.2", "narrow")}
SELECT user_id, {_SCORE_COLS}, 'wide' AS "view" FROM wide UNION ALL SELECT user_id, {_SCORE_COLS}, 'narrow' FROM narrow""",
    "iv_score_rollup": f"""WITH {SEG}, {_LABELS}, {_score("rule IN ('error', 'click')", "wide")}
SELECT count(*) AS episodes, round(sum(content_lost), 2) AS content_lost, round(max(worst), 2) AS worst, count(*) FILTER (worst > 3600) AS "over", round(sum(required_left), 2) AS required_left,
CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(partly) AS BIGINT) AS partly, CAST(sum(fully) AS BIGINT) AS fully FROM wide""",
    "iv_interior_left": f"""WITH {SEG}, {_LABELS}, {_blocks("lab", GAP)}, hit AS (SELECT * FROM seg WHERE rule IN ('view', 'click', 'error')),
b AS (SELECT user_id, "start" AS b_start, "end" AS b_end FROM blk WHERE required),
i AS (SELECT b.*, greatest(h."start", b_start) AS "start", least(h."end", b_end) AS "end" FROM b JOIN hit h ON h.user_id = b.user_id AND h."end" > b_start AND h."start" < b_end),
m AS (SELECT *, max("end") OVER (PARTITION BY user_id, b_start, b_end ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
s AS (SELECT user_id, b_start, b_end, max("end") - min("start") - sum(greatest(0.0, "end" - greatest("start", coalesce(reach, "start")))) AS "left" FROM m GROUP BY ALL)
SELECT b.user_id, round(b.b_start, 3) AS b_start, round(b.b_end, 3) AS b_end, round(coalesce(s."left", 0.0), 3) AS "left" FROM b LEFT JOIN s ON s.user_id = b.user_id AND s.b_start = b.b_start AND s.b_end = b.b_end""",
    "iv_overlap_semi": f"WITH {SEG}, {_SIDES} SELECT event_id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE {_MEET})",
    "iv_overlap_anti": f"WITH {SEG}, {_SIDES} SELECT event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_MEET})",
    "iv_overlap_bucketed": f"WITH {SEG}, {_SIDES} SELECT l.event_id, r.event_id AS other_id FROM l JOIN r ON {_MEET}",
    "iv_overlap_argmax": f"""WITH {SEG}, {_SIDES}, p AS (SELECT l.event_id, r.event_id AS other_id, least(l."end", r."end") - greatest(l."start", r."start") AS o, r."start" AS s, r."end" AS e FROM l JOIN r ON {_MEET}),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o DESC, s, e) AS n FROM p)
SELECT l.event_id, n.other_id, round(n.o, 6) AS "overlap" FROM l LEFT JOIN n ON n.event_id = l.event_id AND n.n = 1""",
    "iv_point_in": f"""WITH {SEG}, p AS (SELECT user_id, event_id, ("start" + "end") / 2 AS m FROM seg WHERE rule = 'view'), s AS (SELECT * FROM seg WHERE rule IN ('click', 'error', 'signup'))
SELECT p.event_id, arg_min(s.rule, s.event_id) AS rule FROM p LEFT JOIN s ON s.user_id = p.user_id AND s."start" <= m AND m < s."end" GROUP BY p.event_id""",
    "iv_nearest": f"""WITH {SEG}, p AS (SELECT * FROM seg WHERE rule = 'view'), s AS (SELECT user_id, ("start" + "end") / 2 AS m FROM seg WHERE rule = 'click'),
n AS (SELECT p.event_id, m, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(m - p."start"), m) AS n FROM p JOIN s ON s.user_id = p.user_id AND abs(m - p."start") <= 7200)
SELECT p.event_id, round(coalesce(n.m, p."start"), 6) AS snapped FROM p LEFT JOIN n ON n.event_id = p.event_id AND n.n = 1""",
    "iv_tail_trim": f"""WITH {SEG}, t AS (SELECT user_id, max("end") AS s FROM seg GROUP BY user_id)
SELECT user_id, {_R2} FROM seg WHERE rule = 'error' UNION ALL SELECT user_id, round(s, 6), round({DURATION}, 6) FROM t WHERE {DURATION} - s >= 5 AND s > 0 AND user_id % 7 <> 0""",
    "iv_cut_pattern": f"""SELECT user_id, round(i * 86400e0 + 42750e0, 6) AS "start", round(i * 86400e0 + 43650e0, 6) AS "end" FROM (SELECT DISTINCT user_id FROM events) e, range(30) t(i)""",
    "run_clusters": f"WITH {SCORED}, {_CLUSTERS.format(t=THRESHOLD)} SELECT user_id, rule, {_R2}, round(prob, 6) AS prob, windows FROM runs",
    "run_bridge": f"WITH {SCORED}, {_CLUSTERS.format(t=0.2)}, {_BRIDGE.format(gap=GAP)} SELECT user_id, rule, {_R2}, round(prob, 6) AS prob, windows FROM bridged",
    "run_weak_leads": f"""WITH {SCORED}, f AS (SELECT *, rule <> 'content' AND prob >= 0.15 AND prob < {THRESHOLD} AND coalesce(lag(prob) OVER w, 0) < {THRESHOLD} AND coalesce(lead(prob) OVER w, 0) < {THRESHOLD} AS ok FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM f)
SELECT user_id, arg_min(rule, idx) AS rule, round(min("start"), 6) AS "start", round(max("end"), 6) AS "end", round(max(prob), 6) AS prob, count(*) AS windows FROM g WHERE ok GROUP BY user_id, g""",
    "run_rule_vote": f"""WITH {SCORED}, v AS (SELECT user_id, CAST(floor("start" / 86400) AS INTEGER) AS "day", rule, sum(prob) AS votes FROM scored GROUP BY ALL)
SELECT user_id, "day", rule, round(votes, 6) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id, "day" ORDER BY votes DESC, rule) AS n FROM v) t WHERE n = 1""",
    "run_batches": f"""WITH {SCORED}, l AS (SELECT *, max(idx) OVER (PARTITION BY user_id) AS m FROM scored)
SELECT event_id, CAST(idx // 24 AS INTEGER) AS batch, FALSE AS context FROM l
UNION ALL SELECT event_id, CAST(idx // 24 AS INTEGER) + 1, TRUE FROM l WHERE idx % 24 = 23 AND idx < m
UNION ALL SELECT event_id, CAST(idx // 24 AS INTEGER) - 1, TRUE FROM l WHERE idx % 24 = 0 AND idx > 0""",
    "run_region_filter": f"""WITH {SEG} SELECT user_id, "end" - "start" >= CASE WHEN rule = 'view' THEN 600.0 ELSE 1800.0 END AS kept, count(*) AS n FROM seg GROUP BY ALL""",
}
_TWICE = """d0 AS (SELECT user_id, floor("start" / 86400) * 86400e0 AS "start", floor("start" / 86400) * 86400e0 + 3600e0 AS "end", CASE WHEN event_id % 2 = 0 THEN rule END AS rule FROM l),
tw AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 UNION ALL SELECT user_id, NULL, "end", rule FROM d0)"""
_TWICE_MEET = 'tw.user_id = r.user_id AND tw."end" > r."start" AND tw."start" < r."end"'
ORACLES |= {
    "iv_overlap_semi_bucketed": f"WITH {SEG}, {_SIDES}, {_TWICE} SELECT * FROM tw WHERE EXISTS (SELECT 1 FROM r WHERE {_TWICE_MEET})",
    "iv_overlap_anti_bucketed": f"WITH {SEG}, {_SIDES}, {_TWICE} SELECT * FROM tw WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_TWICE_MEET})",
    "iv_same_start": f"""WITH {SEG}, l AS (SELECT user_id, event_id, floor("start" / 3600) * 3600e0 AS "start", "end" FROM seg WHERE rule = 'view'), r AS (SELECT user_id, event_id, floor("start" / 3600) * 3600e0 AS "start", "end" FROM seg WHERE rule IN ('click', 'error', 'signup')),
p AS (SELECT l.event_id, r.event_id AS other_id, CASE WHEN l."start" = r."start" THEN 0 ELSE 1 END AS k, r."start" AS s, r."end" AS e, least(l."end", r."end") - greatest(l."start", r."start") AS o FROM l JOIN r ON l.user_id = r.user_id AND (l."start" = r."start" OR (l."end" > r."start" AND l."start" < r."end"))),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k, CASE WHEN k = 0 THEN e END, CASE WHEN k = 1 THEN -o END, s, e, other_id) AS n FROM p)
SELECT l.event_id, n.other_id, CASE n.k WHEN 0 THEN 'start' WHEN 1 THEN 'overlap' END AS "by" FROM l LEFT JOIN n ON n.event_id = l.event_id AND n.n = 1""",
}
ORACLES |= {f"{name}_ranked": ORACLES[name] for name in ("iv_overlap_argmax", "iv_nearest")}
ORACLES |= {f"{name}_ranked": ORACLES[f"{name}_bucketed"] for name in ("iv_overlap", "iv_overlap_semi", "iv_overlap_anti")}
ORACLES |= {f"{name}_bucketed": ORACLES[name] for name in ("iv_overlap_argmax", "iv_point_in", "iv_nearest", "iv_interior_left")}
