"""Predicted intervals against labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..options import DEFAULTS
from ..settling import discard, settle
from .intervals import Keys, blocks, clamp, difference, overlap, total, union
from .long_keys import matched


def score(labels: DataFrame, cuts: DataFrame, episodes: DataFrame, keys: Keys, worst: float = DEFAULTS.worst_cut) -> DataFrame:
    """One row for each episode (keys, duration): content seconds cut (outside all labels), required seconds kept, the longest
    content cut, and required blocks missed, partly and fully cut.  labels carry `borderline`."""
    sized = lambda df: df.join(episodes.select(*keys, "duration"), keys)
    label = clamp(sized(labels), "duration", 0.0).drop("duration")
    cut = union(clamp(sized(cuts), "duration", 0.0).drop("duration"), keys)
    must = label.where(~F.coalesce("borderline", F.lit(False)))
    lost = difference(cut, union(label, keys), keys)
    left = total(difference(union(must, keys), cut, keys), keys, "required_left")
    lost_sums = lost.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("content_lost"), F.max(F.col("end") - F.col("start")).alias("worst"))
    # the cuts are disjoint, so the overlaps of a block add up
    b = blocks(label, keys).where("required").select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    c = cut.select(*[F.col(k).alias(f"c_{k}") for k in keys], "start", "end")
    meets = (F.col("end") > F.col("b_start")) & (F.col("start") < F.col("b_end"))
    for k in keys:
        meets = meets & (F.col(k) == F.col(f"c_{k}"))
    both = overlap(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    # a block without a cut has nulls, which least and greatest would pass over
    hit = b.join(c, meets, "left").groupBy(*keys, "b_start", "b_end").agg(F.sum(F.when(F.col("start").isNull(), 0.0).otherwise(both)).alias("c"))
    full = F.col("b_end") - F.col("b_start") - F.col("c") <= 1e-9
    by_block = hit.groupBy(*keys).agg(F.count_if(F.col("c") <= 0).alias("missed"), F.count_if((F.col("c") > 0) & ~full).alias("partly"), F.count_if((F.col("c") > 0) & full).alias("fully"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        episodes.select(*keys)
        .join(lost_sums, keys, "left")
        .join(left, keys, "left")
        .join(by_block, keys, "left")
        .select(*keys, zero("content_lost"), zero("worst"), zero("required_left"), none("missed"), none("partly"), none("fully"))
    )


def rollup(scores: DataFrame, over: float = DEFAULTS.worst_cut, by: Keys | None = None) -> DataFrame:
    return scores.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum("content_lost").alias("content_lost"),
        F.max("worst").alias("worst"),
        F.count_if(F.col("worst") > over).alias("over"),
        F.sum("required_left").alias("required_left"),
        F.sum("missed").alias("missed"),
        F.sum("partly").alias("partly"),
        F.sum("fully").alias("fully"),
    )


#: Values of a key that are listed to find its median, and parts that a wider range of them is counted in.
LISTED, PARTS = 4096, 1024


def upper_medians(rows: DataFrame, keys: Keys, value: str) -> DataFrame:
    """(keys, median): the middle value of each key (of two middle ones the greater), exactly; null if it has none.

    A range that holds the middle is cut into PARTS, whose values are counted, and the part that holds it is the next range,
    until it holds LISTED values or one.  Counts are sums, so no key's values are gathered beyond that.  Values are numbers, not NaN.
    """
    held = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    known = held.where("_v is not null")
    ranges = settle(held.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to")).withColumn("_rank", F.floor(F.col("_n") / 2)))
    wide = (F.col("_n") > LISTED) & (F.col("_from") < F.col("_to"))
    while ranges.where(wide).limit(1).count():
        inside = matched(known, ranges.where(wide), keys).where(F.col("_v").between(F.col("_from"), F.col("_to")))
        share = (F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
        parts = inside.groupBy(*keys, "_rank", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part"))
        chosen = parts.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        narrower = chosen.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n")).select(*ranges.columns)
        following = settle(ranges.where(~wide | wide.isNull()).unionByName(narrower))
        discard(ranges)
        ranges = following
    one = ranges.where(F.col("_from").isNull() | (F.col("_from") == F.col("_to"))).select(*keys, F.col("_from").alias("median"))
    few = matched(known, ranges.where("_from < _to"), keys).where(F.col("_v").between(F.col("_from"), F.col("_to")))
    middle = F.get(F.array_sort(F.collect_list("_v")), F.any_value("_rank").cast("int"))
    return one.unionByName(few.groupBy(*keys).agg(middle.alias("median")))


def edge_summary(offsets: DataFrame, keys: Keys, value: str = "off", near: float = 5.0) -> DataFrame:
    """Signed edge offsets by key: how many, the upper median of their sizes, how many are near, and count and sum of those over, by sign."""
    x = F.col(value)
    sums = offsets.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.count_if(F.abs(x) <= near).alias("within"),
        F.count_if(x < -near).alias("early"),
        F.coalesce(F.sum(F.when(x < -near, -x)), F.lit(0.0)).alias("early_seconds"),
        F.count_if(x > near).alias("late"),
        F.coalesce(F.sum(F.when(x > near, x)), F.lit(0.0)).alias("late_seconds"),
    )
    medians = upper_medians(offsets.select(*keys, F.abs(x).alias("_size")), keys, "_size")
    return matched(sums, medians, keys, "left").select(*keys, "n", "median", *[c for c in sums.columns if c not in (*keys, "n")])


def class_counts(rows: DataFrame, label: str, distinct: list[str]) -> DataFrame:
    """(label, rows, <column>s): how many rows of each class, and how many different values of the columns."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(f"{c}s") for c in distinct])


def report(scores: DataFrame, keys: Keys, over: float = DEFAULTS.worst_cut) -> DataFrame:
    """(json): the totals of scores and each episode's row, by the keys.  One document, as the report is one file."""
    row = F.struct(*keys, *[c for c in scores.columns if c not in keys])
    rows = scores.agg(F.array_sort(F.collect_list(row)).alias("episodes"))
    return rollup(scores, over).select(F.struct("*").alias("totals")).crossJoin(rows).select(F.to_json(F.struct("totals", "episodes")).alias("json"))
