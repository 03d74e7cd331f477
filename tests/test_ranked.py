"""Overlap joins and nearest marks by numbers in time against all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as I
from tidemark.operators import ranked as R

KEY = ["k"]


def some(spark, seed, n, name):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = float(rng.randint(0, 60))
        rows.append((rng.choice(["a", "a", "a", "b", None]), start, start + rng.choice([0.0, 1.0, 3.0, 9.0, 80.0, -2.0]), i))
    return spark.createDataFrame(rows + rows[:3], f"k string, start double, end double, {name} int").repartition(3)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(R, "CELL", 4)
    left, right = some(spark, seed, 120, "i"), some(spark, seed + 10, 140, "j")
    pairs = R.overlapping(left, right, KEY)
    want = I.overlapping(left, right, KEY)
    assert pairs.columns == want.columns and rows_of(pairs) == rows_of(want)
    for how in ("left_semi", "left_anti"):
        assert rows_of(R.meeting(left, right, KEY, how)) == rows_of(I.overlapping(left, right, KEY, how))
    once = right.dropDuplicates(["k", "start", "end"])
    unique = left.dropDuplicates(["i"])
    assert rows_of(R.greatest_overlap(unique, once, KEY, ["j"]).select("i", "j", "overlap")) == rows_of(I.greatest_overlap(unique, once, KEY, ["i"], ["j"]).select("i", "j", "overlap"))


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_equals_all_pairs(spark, seed):
    points, marks = some(spark, seed, 90, "i").dropDuplicates(["i"]), some(spark, seed + 10, 60, "j").withColumn("m", (F.col("start") + F.col("end")) / 2)
    got = R.nearest(points, marks, KEY, "start", "m", 2.5).withColumn("snapped", F.coalesce("nearest", "start"))
    assert rows_of(got.select("i", "snapped")) == rows_of(I.snapped(points, marks, KEY, "start", ["i"], 2.5).select("i", "snapped"))
    none = R.nearest(points, marks.where("false"), KEY, "start", "m", 2.5)
    assert none.count() == points.count() and none.where("nearest is not null").count() == 0


def test_one_key_of_very_many_intervals(spark):
    """Short intervals of one key, a few that span all of them, all pairs of which no task could try."""
    n = 300_000
    short = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 1.0).alias("start"), (F.col("id") + 1.5).alias("end"), F.col("id").alias("i"))
    wide = spark.range(3).select(F.lit("a").alias("k"), (F.col("id") * -1.0).alias("start"), F.lit(n + 5.0).alias("end"), (F.col("id") + n).alias("i"))
    both = short.unionByName(wide)
    began = time.monotonic()
    other = both.withColumnRenamed("i", "j")
    pairs = R.overlapping(both, other, KEY)
    # each short one meets itself and its neighbours, and the three wide ones, on either side
    assert pairs.count() == (3 * n - 2) + 2 * 3 * n + 9
    assert time.monotonic() - began < 300


def test_no_range_in_the_plan(spark):
    points, marks = some(spark, 5, 30, "i"), some(spark, 6, 30, "j")
    plan = R.nearest(points, marks, KEY, "start", "start", 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
