"""Interval algebra, runs and curves: restated golden cases, and brute force on random sets."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import curves, evaluate, runs
from tidemark.operators import intervals as iv

KEY = ["k"]


def frame(spark, rows, extra=""):
    return spark.createDataFrame([("a", float(s), float(e), *rest) for s, e, *rest in rows], "k string, start double, end double" + extra)


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_clamp_and_pad(spark):
    assert spans(iv.clamp(frame(spark, [(-10, 5), (590, 700), (100, 100.01), (800, 900)]), 600)) == [(0, 5), (590, 600)]
    assert spans(iv.pad(frame(spark, [(1, 10)]), 5, 5, 12)) == [(0, 12)]


def test_merge_chains_and_mixes(spark):
    assert spans(iv.merge(frame(spark, [(0, 10), (11, 20), (21, 30)]), KEY, 2)) == [(0, 30)]
    assert spans(iv.merge(frame(spark, [(0, 10), (11, 20), (40, 50)]), KEY, 2)) == [(0, 20), (40, 50)]
    assert spans(iv.merge(frame(spark, [(0, 10), (12, 20)]), KEY, 2)) == [(0, 20)]  # a gap of just the limit joins
    r = iv.merge(frame(spark, [(0, 10, "x", "s", 1.0), (5, 12, "y", "t", 0.82)], ", rule string, source string, confidence double"), KEY, 2).collect()
    assert [(x.rule, x.source, x.confidence) for x in r] == [("mixed", "mixed", 0.82)]


def test_keep_ranges_and_prepare(spark):
    eps = spark.createDataFrame([("a", 600.0), ("b", 50.0), ("c", 0.0)], "k string, duration double")
    kept = iv.keep_ranges(frame(spark, [(100, 200), (200.5, 300)]), eps, KEY, 1)
    assert sorted((r.k, r.start, r.end) for r in kept.collect()) == [("a", 0, 100), ("a", 300, 600), ("b", 0, 50)]
    cuts, kept = iv.prepare(frame(spark, [(120, 180), (181, 210)]), eps.where("k = 'a'"), KEY, 0.25, 0.25, 2, 1)
    assert spans(cuts) == [(119.75, 210.25)] and spans(kept) == [(0, 119.75), (210.25, 600)]


def test_covered(spark):
    df = frame(spark, [(0, 100), (50, 150)])
    assert iv.total(df, KEY).first().total == 200 and iv.covered(df, KEY).first().covered == 150


def test_random_sets_against_points(spark):
    rng = random.Random(1)
    for _ in range(3):
        a = [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(12))]
        b = [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(8))]
        inside = lambda sets, t: any(s <= t < e for s, e in sets)
        da, db = frame(spark, a), frame(spark, b)
        points = lambda df: {t + 0.5 for s, e in spans(df) for t in range(int(s), int(e))}
        cells = [t + 0.5 for t in range(80)]
        assert points(iv.union(da, KEY)) == {t for t in cells if inside(a, t)}
        assert points(iv.difference(da, db, KEY)) == {t for t in cells if inside(a, t) and not inside(b, t)}
        assert points(iv.intersection(da, db, KEY)) == {t for t in cells if inside(a, t) and inside(b, t)}
        eps = spark.createDataFrame([("a", 80.0)], "k string, duration double")
        kept = iv.keep_ranges(da, eps, KEY, 0.0)
        assert points(kept) == {t for t in cells if not inside(a, t)}
        pairs = {((s, e), (x, y)) for s, e in a for x, y in b if e > x and s < y}
        for bucket in (None, 7.0):
            got = {((r.start, r.end), (r.r_start, r.r_end)) for r in iv.overlapping(da.distinct(), db.distinct(), KEY, bucket=bucket).collect()}
            assert got == pairs
            semi = {(r.start, r.end) for r in iv.overlapping(da.distinct(), db.distinct(), KEY, "left_semi", bucket).collect()}
            anti = {(r.start, r.end) for r in iv.overlapping(da.distinct(), db.distinct(), KEY, "left_anti", bucket).collect()}
            assert semi == {p for p, _ in pairs} and anti == set(a) - semi


def test_blocks(spark):
    r = iv.blocks(frame(spark, [(0, 10, True), (12, 20, False), (23, 30, True), (50, 60, True)], ", borderline boolean"), KEY, 3).orderBy("start").collect()
    assert [(x.start, x.end, x.required, x.start_lo, x.start_hi, x.end_lo, x.end_hi) for x in r] == [(0, 30, True, 0, 12, 20, 30), (50, 60, False, 50, 60, 50, 60)]


def test_score(spark):
    labels = frame(spark, [(10, 20, False), (40, 60, False), (70, 80, True)], ", borderline boolean")
    cuts = frame(spark, [(5, 15), (40, 60), (72, 90)])
    eps = spark.createDataFrame([("a", 100.0), ("b", 10.0)], "k string, duration double")
    r = {x.k: x for x in evaluate.score(labels, cuts, eps, KEY).collect()}
    assert (r["a"].content_lost, r["a"].worst, r["a"].required_left, r["a"].missed, r["a"].partly, r["a"].fully) == (15, 10, 5, 0, 1, 1)
    assert tuple(r["b"])[1:] == (0, 0, 0, 0, 0, 0)
    clipped = evaluate.score(labels.limit(0), frame(spark, [(-2, 5), (95, 105)]), eps.where("k = 'a'"), KEY).first()
    assert clipped.content_lost == 10


def test_snap_and_tail(spark):
    points = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 50.0)], "k string, i int, t double")
    out = iv.snapped(points, frame(spark, [(9, 9.5), (10.5, 11.5)]), KEY, "t", ["i"]).orderBy("i").collect()
    assert [r.snapped for r in out] == [9.25, 50.0]
    eps = spark.createDataFrame([("a", 100.0, 90.0, False), ("b", 100.0, 98.0, False), ("c", 100.0, 10.0, True)], "k string, duration double, speech_end double, keep_tail boolean")
    assert spans(iv.tail_trim(frame(spark, [(1, 2)]), eps, KEY)) == [(1, 2), (90, 100)]
    assert len(spans(iv.cut_pattern(eps, KEY, 30.0, 10.0))) == 9


def scored(spark, probs, rules=None):
    return spark.createDataFrame([("a", i, i * 10.0, i * 10.0 + 10, (rules or ["r"] * len(probs))[i], p) for i, p in enumerate(probs)], "k string, idx int, start double, end double, rule string, prob double")


def test_runs(spark):
    df = scored(spark, [0.9, 0.9, 0.1, 0.95, 0.2, 0.9], ["x", "y", "x", "x", "x", "content"])
    assert [(r.rule, r.start, r.end, r.windows) for r in runs.clusters(df, KEY, 0.85).orderBy("start").collect()] == [("x", 0, 20, 2), ("x", 30, 40, 1)]
    joined = runs.bridge(runs.clusters(df, KEY, 0.85), KEY, 10).collect()
    assert [(r.start, r.end, r.windows) for r in joined] == [(0, 40, 3)]
    between = spark.createDataFrame([("a", "x", 0.0, 10.0, 0.9, 1), ("a", "y", 11.0, 12.0, 0.9, 1), ("a", "x", 13.0, 20.0, 0.9, 1)], "k string, rule string, start double, end double, prob double, windows int")
    assert runs.bridge(between, KEY, 90).count() == 3
    weak = runs.weak_leads(scored(spark, [0.6, 0.9, 0.1, 0.6, 0.7, 0.1, 0.5]), KEY, 0.5, 0.85).orderBy("start").collect()
    assert [(r.start, r.end) for r in weak] == [(30, 50), (60, 70)]


def curve(spark, ys):
    return spark.createDataFrame([("a", [float(y) for y in ys])], "k string, ys array<double>")


def brute_change(ys):
    def error(part):
        m = sum(part) / len(part)
        return sum((y - m) ** 2 for y in part)

    return min((round(error(ys[:i]) + error(ys[i:]), 9), i) for i in range(1, len(ys)))[1] if len(ys) > 1 else 0


def test_changepoint(spark):
    rng = random.Random(4)
    cases = [[0] * 4 + [0.9] * 4, [0.1, 0.1, 0.9, 0.1, 0.1, 0.9, 0.9, 0.9], [], [0.4]] + [[round(rng.random(), 3) for _ in range(rng.randint(2, 20))] for _ in range(40)]
    df = spark.createDataFrame([(i, [float(y) for y in ys]) for i, ys in enumerate(cases)], "i int, ys array<double>")
    got = [r.at for r in df.select("i", curves.changepoint(F.col("ys")).alias("at")).orderBy("i").collect()]
    assert got == [brute_change(ys) for ys in cases]


@pytest.mark.parametrize("ys, want", [([0, 0, 0, 0, 0.9, 0.9, 0.9], (4, "fitted")), ([0.1] * 20, (None, "never")), ([0.5] * 20, (None, "ambiguous")), ([0.5], (0, "short"))])
def test_fit_end(spark, ys, want):
    r = curves.fit_end(curve(spark, ys), KEY).first()
    assert (r.end_idx, r.state) == want


def test_walk_and_average(spark):
    assert curve(spark, [0.9, 0.7, 0.6, 0.5, 0.9]).select(curves.end_walk(F.col("ys"), F.lit(1)).alias("i")).first().i == 3
    assert curve(spark, [0.9, 0.9]).select(curves.end_walk(F.col("ys"), F.lit(0)).alias("i")).first().i == 2
    three = spark.createDataFrame([("a", r, i, p) for r, ps in enumerate([[0.0, 0.5, 1.0], [0.1, 0.5, 0.8], [0.2, 0.5, 0.9]]) for i, p in enumerate(ps)], "k string, run int, idx int, p double")
    assert [round(r.p, 9) for r in curves.average(three, KEY).orderBy("idx").collect()] == [0.1, 0.5, 0.9]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (-1, 2, -3, 4)], "k string, off double")
    r = evaluate.edge_summary(df, KEY, near=2).first()
    assert (r.n, r.median, r.within, r.early, r.late) == (4, 3.0, 2, 1, 1)
