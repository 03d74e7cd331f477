"""Overlap joins for keys of any length: cells chosen by the data, no range of a join compared pair by pair.

Two intervals meet if the right one starts in the left one, or the left one starts inside the right one.  Either way a point
lies in an interval.  The points of a key are numbered in order of time, so an interval holds a run of
numbers; its ends come from one merge of all points and ends.  Runs meet points in cells of CELL numbers: a cell has
CELL points whatever their times are, an interval that spans all lies in no more cells than it has pairs by CELL, and two.

Numbers are counts of a merged order that Spark has cut by ranges of (key, time); a key may lie in many of the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settling import discard, settle
from ..shipping import ship
from .intervals import Keys, overlap
from .long_keys import matched, sum_before

CELL = 128


def _cut_by_time(df: DataFrame, keys: Keys) -> DataFrame:
    """df (keys, _t, _kind, ...) settled in ranges of its order, with the number of the range (_slice)."""
    return settle(df.repartitionByRange(*keys, "_t", "_kind").withColumn("_slice", F.spark_partition_id()))


def _runs(points: DataFrame, ranges: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """points (keys, _id, _t) with their numbers by time (_n), and ranges (keys, _id, _from, _to) with the numbers from
    _low to before _high of the points with _from <= _t < _to."""
    marks = points.select(*keys, "_t", F.lit(2).alias("_kind"), "_id", F.lit(1).alias("_one"))
    for kind, at in ((0, "_from"), (1, "_to")):
        marks = marks.unionByName(ranges.select(*keys, F.col(at).alias("_t"), F.lit(kind).alias("_kind"), "_id", F.lit(0).alias("_one")))
    cut = _cut_by_time(marks, keys)
    counted = settle(sum_before(cut, keys, ["_t", "_kind", "_id"], F.col("_one"), "_n"))
    discard(cut)
    ends = counted.where("_kind < 2").groupBy(*keys, "_id").agg(F.max(F.when(F.col("_kind") == 0, F.col("_n"))).alias("_low"), F.max(F.when(F.col("_kind") == 1, F.col("_n"))).alias("_high"))
    return counted.where("_kind = 2").select(*keys, "_id", "_n"), ends.where("_high > _low")


def _inside(points: DataFrame, ranges: DataFrame, keys: Keys) -> DataFrame:
    """(_point, _range): the ids of points and of the ranges that hold them."""
    numbered, runs = _runs(points, ranges, keys)
    cells = F.sequence(F.expr(f"_low div {CELL}"), F.expr(f"(_high - 1) div {CELL}"))
    wide = runs.select(*keys, F.col("_id").alias("_range"), "_low", "_high", F.explode(cells).alias("_cell"))
    narrow = numbered.select(*keys, F.col("_id").alias("_point"), "_n", F.expr(f"_n div {CELL}").alias("_cell"))
    return wide.join(narrow, [*keys, "_cell"]).where("_low <= _n and _n < _high").select("_point", "_range")


def overlapping(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Pairs with an overlap of more than nothing; right's start and end are r_start and r_end.  Rows with null keys meet none."""
    ship(left.sparkSession)
    known = lambda df: df.dropna(subset=[*keys, "start", "end"]).withColumn("_id", F.monotonically_increasing_id())
    a, b = settle(known(left)), settle(known(right.withColumnsRenamed({"r_start": "start", "r_end": "end"})))
    point = lambda df: df.select(*keys, "_id", F.col("start").alias("_t"))
    span = lambda df, start: df.select(*keys, "_id", start.alias("_from"), F.col("end").alias("_to"))
    # right starts in left: left.start <= right.start < left.end; left starts after right's start and before its end
    first = _inside(point(b), span(a, F.col("start")), keys).select(F.col("_range").alias("_l"), F.col("_point").alias("_r"))
    second = _inside(point(a), span(b, F.col("start")), keys).select(F.col("_point").alias("_l"), F.col("_range").alias("_r")).withColumn("_second", F.lit(True))
    pairs = first.withColumn("_second", F.lit(False)).unionByName(second)
    r = b.select(F.col("_id").alias("_r"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), *[c for c in b.columns if c not in (*keys, "start", "end", "_id")])
    out = pairs.join(a.withColumnRenamed("_id", "_l"), "_l").join(r, "_r")
    meets = (F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end")) & (~F.col("_second") | (F.col("start") > F.col("r_start")))
    return out.where(meets).select(*left.columns, *[c for c in r.columns if c != "_r"])


def meeting(left: DataFrame, right: DataFrame, keys: Keys, how: str = "left_semi") -> DataFrame:
    """Left rows that overlap a right one (left_semi), or none (left_anti); rows with null keys meet none."""
    a = settle(left.withColumn("_row", F.monotonically_increasing_id()))
    met = overlapping(a, right.select(*keys, "start", "end"), keys).select("_row").distinct()
    return a.join(met, "_row", how).drop("_row")


def greatest_overlap(left: DataFrame, right: DataFrame, keys: Keys, right_cols: list[str]) -> DataFrame:
    """For each left row: the right row with the greatest overlap (earliest, then shortest, on ties), null if none."""
    a = settle(left.withColumn("_row", F.monotonically_increasing_id()))
    size: Column = overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    best = F.max_by(F.struct("r_start", "r_end", *right_cols, size.alias("overlap")), F.struct(size, -F.col("r_start"), -F.col("r_end")))
    chosen = overlapping(a.select(*keys, "start", "end", "_row"), right.select(*keys, "start", "end", *right_cols), keys).groupBy("_row").agg(best.alias("_b"))
    return a.join(chosen, "_row", "left").select(*left.columns, "_b.r_start", "_b.r_end", *[F.col(f"_b.{c}").alias(c) for c in right_cols], "_b.overlap")


def nearest(points: DataFrame, marks: DataFrame, keys: Keys, point: str, mark: str, reach: float) -> DataFrame:
    """points with `nearest`: the mark of the key (column `mark`) that is nearest to `point`, within reach, the earlier on ties.

    Marks and points stand in one order, where each point sees the last mark before it and the first after it; so
    no pairs are made.  A key may lie in many cuts of the order, which hand their first and last marks on.
    """
    ship(points.sparkSession)
    a = settle(points.withColumn("_id", F.monotonically_increasing_id()))
    known = marks.dropna(subset=[*keys, mark])
    order = known.select(*keys, F.col(mark).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_id"), F.col(mark).alias("_mark"))
    asked = a.where(F.col(point).isNotNull()).dropna(subset=list(keys))
    order = order.unionByName(asked.select(*keys, F.col(point).cast("double").alias("_t"), F.lit(1).alias("_kind"), "_id", F.lit(None).cast("double").alias("_mark")))
    cut = _cut_by_time(order, keys)
    edges = cut.where("_kind = 0").groupBy(*keys, "_slice").agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_last"))
    slices = matched(cut.select(*keys, "_slice").distinct(), edges, [*keys, "_slice"], "left")
    over = Window.partitionBy(*keys).orderBy("_slice")
    handed = slices.select(
        *keys,
        "_slice",
        F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    own = Window.partitionBy(*keys, "_slice").orderBy("_t", "_kind")
    seen = matched(
        cut.withColumn("_before", F.last("_mark", True).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.first("_mark", True).over(own.rowsBetween(0, Window.unboundedFollowing))).where("_kind = 1"),
        handed,
        [*keys, "_slice"],
    )
    before, after = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    gap = lambda m: F.abs(m - F.col("_t"))
    best = F.when(after.isNull() | (gap(before) <= gap(after)), before).otherwise(after)
    found = seen.select("_id", F.when(gap(best) <= reach, best).alias("nearest"))
    return a.join(found, "_id", "left").drop("_id")
