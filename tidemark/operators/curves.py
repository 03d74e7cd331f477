"""Boundary curves: points (keys, idx, p) in order, idx from 0 within a key.

A curve has a few hundred points at most, so the operators work on arrays of one curve: one shuffle
gathers a curve, the rest is higher-order functions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import appended, let, listed, paged
from ..options import DEFAULTS
from .intervals import Keys

#: Digits that squared errors are compared to: nearer ones are ties, and the earliest split wins.
TIE_DIGITS = 12


def average(runs: DataFrame, keys: Keys, run: str = "run") -> DataFrame:
    """Mean of several runs of one curve: (keys, idx, p); a point that a run lacks counts as nothing."""
    n = runs.groupBy(*keys).agg(F.count_distinct(run).alias("_n"))
    return runs.groupBy(*keys, "idx").agg(F.sum("p").alias("_s")).join(n, keys).select(*keys, "idx", (F.col("_s") / F.col("_n")).alias("p"))


def gathered(points: DataFrame, keys: Keys, *extra: str | Column, value: str = "p") -> DataFrame:
    """One row for each curve: ys, and an array for each extra column, by idx."""
    held = points.select(*keys, "idx", F.col(value).cast("double").alias("_p"), *extra)
    names = held.columns[len(keys) + 2 :]
    packed = F.array_sort(F.collect_list(F.struct("idx", "_p", *names)))
    return held.groupBy(*keys).agg(packed.alias("_c")).select(*keys, F.col("_c._p").alias("ys"), *[F.col(f"_c.{c}").alias(c) for c in names])


def _sum(ys: Column) -> Column:
    return F.aggregate(ys, F.lit(0.0), lambda a, y: a + y)


def _prefix(ys: Column) -> Column:
    """Sums of the first 0, 1, ..., n values."""

    def step(state: Column, y: Column) -> Column:
        total = state["total"] + y
        return F.struct(total.alias("total"), appended(state["sums"], total).alias("sums"))

    return F.concat(F.array(F.lit(0.0)), F.aggregate(ys, F.struct(F.lit(0.0).alias("total"), paged("double").alias("sums")), step, lambda s: listed(s["sums"])))


def changepoint(ys: Column) -> Column:
    """The split with the least squared error of two means, the earliest on ties; 0 for fewer than two points."""
    sums = F.struct(_prefix(ys).alias("s"), _prefix(F.transform(ys, lambda y: y * y)).alias("q"))
    return F.when(F.size(ys) < 2, F.lit(0)).otherwise(let(sums, lambda x: _best_split(x["s"], x["q"], F.size(ys))))


def _best_split(s: Column, q: Column, n: Column) -> Column:
    """The split of the first n values, given prefix sums of values and squares."""

    def error(i: Column) -> Column:
        left, right = F.get(s, i), F.get(s, n) - F.get(s, i)
        return F.get(q, n) - left * left / i - right * right / (n - i)

    splits = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.round(error(i), TIE_DIGITS).alias("e"), i.alias("i")))
    return F.array_min(splits)["i"]


def mean(ys: Column, first: Column, count: Column) -> Column:
    part = F.slice(ys, first + 1, F.greatest(count, F.lit(0)))
    return F.when(count > 0, _sum(part) / count)


def step_height(ys: Column, at: Column) -> Column:
    """Mean after the split minus mean before it; 0 at either end."""
    n = F.size(ys)
    inside = (at > 0) & (at < n)
    return F.when(inside, mean(ys, at, n - at) - mean(ys, F.lit(0), at)).otherwise(F.lit(0.0))


def fit_start(ys: Column) -> Column:
    """The changepoint if the curve rises there from a mean under one half, else 0.  Rises are compared to TIE_DIGITS: a flat curve has none."""
    fits = lambda at: (_rise(ys, at) > 0) & (F.round(mean(ys, F.lit(0), at), TIE_DIGITS) < 0.5)
    return let(changepoint(ys), lambda at: F.when(fits(at), at).otherwise(F.lit(0)))


def _rise(ys: Column, at: Column) -> Column:
    """step_height without what the order of summing leaves."""
    return F.round(step_height(ys, at), TIE_DIGITS)


def prefix_steps(ys: Column, first: int = DEFAULTS.end_first) -> Column:
    """Of the first `first` points, and of one more each time: struct(i, h), the best split and its step.  Empty for fewer than two."""
    n = F.size(ys)
    sums = F.struct(_prefix(ys).alias("s"), _prefix(F.transform(ys, lambda y: y * y)).alias("q"))

    def tried(x: Column) -> Column:
        s, q = x["s"], x["q"]
        height = lambda i, w: (F.get(s, w) - F.get(s, i)) / (w - i) - F.get(s, i) / i
        one = lambda w: let(_best_split(s, q, w), lambda i: F.struct(i.alias("i"), F.round(height(i, w), TIE_DIGITS).alias("h")))
        return F.transform(F.sequence(F.least(F.lit(first), n), n), one)

    return F.when(n < 2, F.array().cast("array<struct<i:int,h:double>>")).otherwise(let(sums, tried))


def end_fit(ys: Column, first: int = DEFAULTS.end_first, step: float = DEFAULTS.end_step, never: float = DEFAULTS.end_never) -> Column:
    """struct(end_idx, state): where the programme comes back on a curve.

    The first `first` points are fitted, then one more each time, until a step of at least `step` is found (state `fitted`).
    Without one: `never` if no point reaches `never`, else `ambiguous`; end_idx is then null.  Fewer than two points: 0, `short`.
    """
    n = F.size(ys)
    at = F.when(n < 2, F.lit(0)).otherwise(F.get(F.filter(prefix_steps(ys, first), lambda c: c["h"] >= step), 0)["i"])
    state = lambda i: F.when(n < 2, "short").when(i.isNotNull(), "fitted").when(F.array_max(ys) < never, "never").otherwise("ambiguous")
    return let(at, lambda i: F.struct(i.alias("end_idx"), state(i).alias("state")))


def fit_end(curves: DataFrame, keys: Keys, first: int = DEFAULTS.end_first, step: float = DEFAULTS.end_step, never: float = DEFAULTS.end_never) -> DataFrame:
    """(keys, end_idx, state) of curves with `ys`."""
    return curves.select(*keys, end_fit(F.col("ys"), first, step, never).alias("_f")).select(*keys, "_f.end_idx", "_f.state")


def start_edges(anchors: DataFrame, points: DataFrame, keys: Keys, reach: float = DEFAULTS.start_reach, inside: float = DEFAULTS.start_inside) -> DataFrame:
    """anchors (keys, anchor_start, anchor_end) with new_start, pick, step, points (how many it has) and seen (one from its start on
    is at `inside` or more), from their curves (keys, idx, start, p)."""
    x = anchors.join(gathered(points, keys, F.col("start").alias("_at")), keys, "left")
    all_ = F.coalesce(F.arrays_zip("ys", "_at"), F.array().cast("array<struct<ys:double,_at:double>>"))
    x = x.withColumn("_all", all_).withColumn("_near", F.filter("_all", lambda c: c["_at"] >= F.col("anchor_start") - reach))
    x = x.withColumn("_y", F.transform("_near", lambda c: c["ys"])).withColumn("_i", fit_start(F.col("_y")))
    within = F.filter("_near", lambda c: (c["_at"] >= F.col("anchor_start")) & (c["_at"] < F.col("anchor_end")) & (c["ys"] >= inside))
    x = x.withColumns({"_fit": F.when(F.col("_i") > 0, F.get("_near", F.col("_i"))["_at"]), "_inside": F.get(within, 0)["_at"]})
    pick = F.when(F.col("_fit").isNotNull(), "fitted").when(F.col("_inside").isNotNull(), "inside").otherwise("kept")
    return x.select(
        *anchors.columns,
        F.coalesce("_fit", "_inside", "anchor_start").alias("new_start"),
        pick.alias("pick"),
        F.when(F.col("_fit").isNotNull(), _rise(F.col("_y"), F.col("_i"))).otherwise(F.lit(0.0)).alias("step"),
        F.size("_all").alias("points"),
        F.exists("_all", lambda c: (c["_at"] >= F.col("anchor_start")) & (c["ys"] >= inside)).alias("seen"),
    )


def start_edge(points: DataFrame, anchors: DataFrame, keys: Keys, reach: float = DEFAULTS.start_reach, inside: float = DEFAULTS.start_inside) -> DataFrame:
    """Start of each anchor (keys, anchor_start, anchor_end) from its curve (keys, idx, start, p): (keys, new_start, pick, step).

    The points from `reach` seconds before the anchor on are fitted; without a fit the first point within the anchor at
    `inside` or more is taken (`inside`), and without one the anchor's start stays (`kept`).  step is the fitted step's height.
    """
    return start_edges(anchors, points, keys, reach, inside).select(*keys, "new_start", "pick", "step")


def end_walk(ads: Column, at: Column, extend: float = DEFAULTS.extend_while) -> Column:
    """From an end index on: past every point whose ad probability is still at `extend` or more."""
    n = F.size(ads)
    rest = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= at) & ((i >= n) | (F.get(ads, i) < extend)))
    return F.array_min(rest)


def trim_outro(regions: DataFrame, sentences: DataFrame, keys: Keys, at_least: float = DEFAULTS.outro_from) -> DataFrame:
    """A region's start moved to its first sentence (start, p) at `at_least` or more; never earlier."""
    s = sentences.select(*keys, F.col("start").alias("_s"), F.col("p").alias("_p"))
    first = regions.select(*keys, "start", "end").join(s, keys).where((F.col("_s") >= F.col("start")) & (F.col("_s") < F.col("end")) & (F.col("_p") >= at_least))
    moved = first.groupBy(*keys, "start", "end").agg(F.min("_s").alias("_to"))
    return regions.join(moved, [*keys, "start", "end"], "left").withColumn("start", F.greatest("start", F.coalesce("_to", "start"))).drop("_to")
