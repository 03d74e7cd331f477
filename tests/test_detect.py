"""The detection plan, boundaries from curves, and settings."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import curves
from tidemark.plans import detect

KEY = ["k"]


def change(ys):
    def error(part):
        m = sum(part) / len(part)
        return sum((y - m) ** 2 for y in part)

    return min((round(error(ys[:i]) + error(ys[i:]), 12), i) for i in range(1, len(ys)))[1]


def end_by_hand(start, end, points, conservative):
    """The end of one anchor, step by step."""
    ps = [p for *_, p, _ in points]
    n = len(points)
    at, state = None, None
    for width in range(min(11, n), n + 1):
        i = change(ps[:width])
        if round(sum(ps[i:width]) / (width - i) - sum(ps[:i]) / i, 12) >= 0.3:
            at, state = i, "fitted"
            break
    if at is None and max(ps) < 0.3:
        at, state = n, "never"
    if at is None:
        state = "ambiguous"
        within = [i for i, (s, *_) in enumerate(points) if start <= s < end]
        seeds = [i for i in within if points[i][3] >= 0.6]
        if seeds:
            at = seeds[0]
        elif conservative and within and all(points[i][3] <= 0.4 for i in within) and points[within[0]][0] - start >= 8:
            at, state = within[0], "low tail kept"
        else:
            at = next((i for i, (s, *_) in enumerate(points) if s >= end), n)
    base = at
    while at < n and points[at][3] >= 0.6:
        at += 1
    return (max(points[-1][1], end) if at >= n else points[at][0]), state + (", extended" if at > base else "")


@pytest.mark.parametrize("conservative", [True, False])
def test_ends_equal_the_steps_by_hand(spark, conservative):
    rng = random.Random(5)
    anchors, points, want = [], [], {}
    for k in range(60):
        n = rng.randint(2, 24)
        level = rng.choice([0.1, 0.5, 0.9])
        own = []
        for i in range(n):
            p = min(1.0, max(0.0, rng.gauss(level if i < n // 2 or rng.random() < 0.7 else 0.8, 0.15)))
            own.append((60.0 + 6 * i, 66.0 + 6 * i, round(p, 3), round(rng.choice([0.1, 0.2, 0.5, 0.9]) if k % 3 else 0.2, 3)))
        start, end = 50.0, rng.choice([70.0, 100.0, 130.0])
        anchors.append((k, start, end, False))
        points += [(k, i, *x) for i, x in enumerate(own)]
        want[k] = end_by_hand(start, end, own, conservative)
    anchors += [(100, 1.0, 9.0, True), (101, 1.0, 9.0, False)]
    want |= {100: (9.0, "localized run"), 101: (9.0, "no curve")}
    a = spark.createDataFrame(anchors, "k int, start double, end double, localized boolean")
    p = spark.createDataFrame(points, "k int, idx int, p_start double, p_end double, p double, ad double")
    got = {r.k: (r.new_end, r.reason) for r in detect.bound_ends(a, p, KEY, conservative=conservative).collect()}
    assert got == want


def test_start_edge_falls_back(spark):
    anchors = spark.createDataFrame([(1, 100.0, 130.0), (2, 100.0, 130.0), (3, 100.0, 130.0)], "k int, anchor_start double, anchor_end double")
    rows = []
    for k, ps in ((1, [0.1, 0.1, 0.1, 0.9, 0.9, 0.9]), (2, [0.9, 0.9, 0.9, 0.9, 0.9, 0.2]), (3, [0.4, 0.3, 0.2, 0.1, 0.1, 0.1])):
        rows += [(k, i, 80.0 + 10 * i, p) for i, p in enumerate(ps)]
    p = spark.createDataFrame(rows, "k int, idx int, start double, p double")
    got = {r.k: (r.new_start, r.pick) for r in curves.start_edge(p, anchors, KEY).collect()}
    assert got == {1: (110.0, "fitted"), 2: (100.0, "inside"), 3: (100.0, "kept")}


def test_flat_curves_do_not_rise(spark):
    """The mean of three times 0.1 is more than 0.1 by rounding alone."""
    rows = [(k, i, p) for k, p in enumerate([0.1, 0.4, 0.7]) for n in [4 + k] for i in range(n)] + [(9, i, p) for i, p in enumerate([0.1, 0.1, 0.3])]
    at = curves.gathered(spark.createDataFrame(rows, "k int, idx int, p double"), KEY).select("k", curves.fit_start(F.col("ys")).alias("at"))
    assert {r.k: r["at"] for r in at.collect()} == {0: 0, 1: 0, 2: 0, 9: 2}


def test_cuts_are_clamped_and_fused(spark):
    probs = [0.9, 0.95, 0.1, 0.1, 0.6, 0.6, 0.1]
    s = spark.createDataFrame([("a", i, i * 10.0, i * 10.0 + 10, "x", p) for i, p in enumerate(probs)], "k string, idx int, start double, end double, rule string, prob double")
    eps = spark.createDataFrame([("a", 55.0)], "k string, duration double")
    got = [(r.start, r.end, r.source) for r in detect.cuts(s, eps, KEY).orderBy("start").collect()]
    assert got == [(0.0, 20.0, "scan"), (40.0, 55.0, "localized")]


GOOD = """
[[rules]]
id = "sponsor"
prompt = "paid"
[[rules]]
id = "credits"
prompt = "names"
[audio]
bitrate_kbps = 96
[[channels]]
name = "A"
slug = "a"
latest = 5
keep = 7
rules = ["credits"]
[[channels]]
name = "B"
slug = "b"
"""


def test_settings(spark):
    c = config.parse(GOOD)
    rules, channels = config.tables(spark, c)
    assert sorted((r.channel, r.rule) for r in config.channel_rules(rules, channels).collect()) == [("a", "credits"), ("b", "credits"), ("b", "sponsor")]
    assert [(r.latest, r.keep, r.bitrate_kbps) for r in channels.orderBy("channel").collect()] == [(5, 7, 96), (10, 10, 96)]


@pytest.mark.parametrize(
    "change_", [("keep = 7", "keep = 3"), ("latest = 5", "latest = 0"), ('slug = "b"', 'slug = "A"'), ('slug = "b"', 'slug = "a b"'), ('id = "credits"', 'id = "content"'), ('["credits"]', '["none"]'), ("= 96", "= 9"), ("latest = 5", "latest = 5\nwatch_limit = 3")]
)
def test_wrong_settings_are_errors(change_):
    with pytest.raises(ValueError):
        config.parse(GOOD.replace(*change_))
