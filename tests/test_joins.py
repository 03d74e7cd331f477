"""Joins by keys in buckets, quotes, snapshots and complete writes."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cues, intervals
from tidemark.sources import captions, sinks

KEY = ["k"]
FIELDS = "k int, start double, end double, tag string"


def rows(rng, n, tag):
    out = []
    for _ in range(n):
        start = float(rng.randint(0, 40))
        out.append((rng.randint(0, 2), start, start + rng.randint(0, 12), tag))
    return out


@pytest.mark.parametrize("bucket", [None, 3.0, 10.0])
def test_overlaps_equal_all_pairs(spark, bucket):
    rng = random.Random(3)
    left, right = rows(rng, 60, None), rows(rng, 30, "r")
    left += left[:20] + [(0, None, 5.0, "n"), (1, 3.0, None, None), (None, 1.0, 9.0, "x"), (0, None, 5.0, "n")]
    a, b = spark.createDataFrame(left, FIELDS), spark.createDataFrame(right, FIELDS).drop("tag")
    meets = lambda x: [r for r in right if None not in x[:3] and r[0] == x[0] and x[2] > r[1] and x[1] < r[2]]
    got = {how: collections.Counter(map(tuple, intervals.overlapping(a, b, KEY, how, bucket).collect())) for how in ("inner", "left_semi", "left_anti")}
    assert got["left_semi"] == collections.Counter(x for x in left if meets(x))
    assert got["left_anti"] == collections.Counter(x for x in left if not meets(x))
    pairs = collections.Counter((r.k, r.start, r.end, r.r_start, r.r_end) for r in intervals.overlapping(a, b, KEY, "inner", bucket).collect())
    assert pairs == collections.Counter((*x[:3], r[1], r[2]) for x in left for r in meets(x))


def test_two_equal_rows_in_buckets(spark):
    left = spark.createDataFrame([(1, 0.0, 5.0, "a"), (1, 0.0, 5.0, "a"), (1, 50.0, 60.0, None)], FIELDS)
    right = spark.createDataFrame([(1, 4.0, 30.0)], "k int, start double, end double")
    assert [intervals.overlapping(left, right, KEY, how, 10.0).count() for how in ("left_semi", "left_anti")] == [2, 1]


def test_quotes_far_off_and_missing(spark):
    c = spark.createDataFrame([(1, 0.0, "So, hello and welcome to the show today"), (1, 100.0, "hello and welcome to the show!"), (2, 5.0, "else")], "k int, start double, text string")
    quotes = spark.createDataFrame([(1, 0, "Hello and welcome to the show", 90.0), (1, 1, "hello and welcome to the show", 40.0), (2, 2, "not there at all", 5.0), (2, 3, "", 5.0)], "k int, n int, quote string, at double")
    got = {r.n: (r.found, r.off) for r in cues.nearest_quotes(quotes, c, KEY, "n").collect()}
    assert got == {0: (100.0, False), 1: (0.0, True), 2: (None, True), 3: (None, True)}


def test_snapshots_and_complete_writes(spark, tmp_path):
    at = str(tmp_path / "state")
    assert captions.snapshot(spark, at, "a int") is None
    df = spark.createDataFrame([(2,), (1,)], "a int")
    with pytest.raises(ValueError):
        sinks.write_complete(df, at, 3, ["a"])
    assert captions.snapshot(spark, at, "a int") is None
    assert sinks.write_complete(df, at, 2, ["a"]) == 2
    assert sorted(r.a for r in captions.snapshot(spark, at, "a int").collect()) == [1, 2]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        captions.snapshot(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_listings_are_counted_by_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text("\n".join(f'{{"id": "{name}{i}", "title": "t", "availability": "{"private" if i == 1 else "public"}", "position": {i}}}' for i in range(5)))
    got = sorted(r.id for r in captions.listing(spark, str(tmp_path / "*.json"), 2).collect())
    assert got == ["a0", "a1", "a2", "b0", "b1", "b2"]


def test_same_start_before_greatest_overlap(spark):
    left = spark.createDataFrame([(1, 10.0, 20.0, "a"), (1, 30.0, 40.0, "b"), (1, 90.0, 95.0, "c")], FIELDS)
    right = spark.createDataFrame([(1, 10.0, 11.0, "short"), (1, 10.0, 12.0, "same"), (1, 5.0, 50.0, "long"), (1, 38.0, 60.0, "tail")], FIELDS).withColumnRenamed("tag", "other")
    got = {r.tag: (r.other, r.by) for r in intervals.same_start_or_greatest_overlap(left, right, KEY, ["tag"], ["other"]).collect()}
    assert got == {"a": ("short", "start"), "b": ("long", "overlap"), "c": (None, None)}
    assert intervals.same_start_or_greatest_overlap(left.where(F.lit(False)), right, KEY, ["tag"], ["other"]).count() == 0
