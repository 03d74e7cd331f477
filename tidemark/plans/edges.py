"""Edge rules against labelled blocks: every rule of a grid of thresholds in one pass over gathered curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import let
from ..operators import curves as C
from ..operators import evaluate as E
from ..operators import intervals as I
from ..options import DEFAULTS


def region_blocks(regions: DataFrame, segments: DataFrame, keys: I.Keys, gap: float = DEFAULTS.block_gap) -> DataFrame:
    """regions (keys, anchor, anchor_start, anchor_end) whose anchor overlaps a label block, with that block (block_start, block_end
    and the ranges start_lo..start_hi, end_lo..end_hi that its ends may fall in): the one that it overlaps most, if it is required."""
    blocks = I.blocks(segments, keys, gap).select(*keys, "start", "end", "required", "start_lo", "start_hi", "end_lo", "end_hi")
    named = regions.withColumnsRenamed({"anchor_start": "start", "anchor_end": "end"})
    best = I.greatest_overlap(named, blocks, keys, ["anchor"], ["required", "start_lo", "start_hi", "end_lo", "end_hi"])
    out = best.where(F.col("required") & (F.col("overlap") > 0)).drop("required", "overlap")
    return out.withColumnsRenamed({"start": "anchor_start", "end": "anchor_end", "r_start": "block_start", "r_end": "block_end"})


def start_grid(regions: DataFrame, points: DataFrame, keys: I.Keys, floors: list[float], reach: float = DEFAULTS.start_reach) -> DataFrame:
    """(regions' columns, floor, edge, off): where each rule puts the start of a region (with its block), and how far from the
    block's range that is, negative if early.  points: (keys, anchor, idx, start, p).

    The curve from `reach` seconds before the anchor on is fitted once; without a step the first point from the anchor on at `floor`
    or more counts, and without one the anchor's start.  Regions without points give nothing.
    """
    by = [*keys, "anchor"]
    x = regions.join(C.gathered(points, by, F.col("start").alias("_at")), by)
    x = x.withColumn("_all", F.arrays_zip("ys", "_at")).withColumn("_near", F.filter("_all", lambda c: c["_at"] >= F.col("anchor_start") - reach))
    fitted = let(C.fit_start(F.transform("_near", lambda c: c["ys"])), lambda i: F.when(i > 0, F.get("_near", i)["_at"]))
    x = x.withColumn("_fit", fitted)
    inside = F.filter("_all", lambda c: c["_at"] >= F.col("anchor_start"))
    first = lambda floor: F.get(F.filter(inside, lambda c: c["ys"] >= floor), 0)["_at"]
    rules = F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.coalesce("_fit", first(f), "anchor_start").alias("edge")) for f in floors])
    return x.select(*regions.columns, F.inline(rules)).withColumn("off", I.off(F.col("edge"), F.col("start_lo"), F.col("start_hi")))


def end_grid(regions: DataFrame, points: DataFrame, keys: I.Keys, grid: list[tuple[float, float, float]], first: int = DEFAULTS.end_first) -> DataFrame:
    """(regions' columns, step, never, extend, edge, off) for each (step, never, extend) of the grid: where the rule puts the end.

    points: (keys, anchor, idx, p_start, p_end, p, ad), p whether the programme is back, ad the score as an ad or null.  Every prefix
    of a curve of `first` points or more is fitted once, whatever the grid.  An ambiguous curve begins at the first point in the anchor
    that scores `extend` or more as an ad, or else after the anchor; then the end moves past points that score so.  Without
    scores nothing is extended.
    """
    by = [*keys, "anchor"]
    x = regions.join(C.gathered(points, by, "p_start", "p_end", F.coalesce("ad", F.lit(-1.0)).alias("_ad")), by)
    x = x.withColumn("_steps", C.prefix_steps(F.col("ys"), first)).withColumn("_n", F.size("ys"))
    places = F.sequence(F.lit(0), F.col("_n") - 1)
    at = lambda i: F.get("p_start", i)

    def rule(step: float, never: float, extend: float) -> Column:
        fit = F.when(F.col("_n") < 2, F.lit(0)).otherwise(F.get(F.filter("_steps", lambda c: c["h"] >= step), 0)["i"])
        sure = F.array_min(F.filter(places, lambda i: (at(i) >= F.col("anchor_start")) & (at(i) < F.col("anchor_end")) & (F.get("_ad", i) >= extend)))
        after = F.array_min(F.filter(places, lambda i: at(i) >= F.col("anchor_end")))
        open_ = F.when(F.array_max("ys") < never, F.col("_n")).otherwise(F.coalesce(sure, after, F.col("_n")))
        edge = let(C.end_walk(F.col("_ad"), F.coalesce(fit, open_), extend), lambda i: F.when(i >= F.col("_n"), F.greatest(F.element_at("p_end", -1), F.col("anchor_end"))).otherwise(at(i)))
        return F.struct(F.lit(float(step)).alias("step"), F.lit(float(never)).alias("never"), F.lit(float(extend)).alias("extend"), edge.alias("edge"))

    rules = F.array(*[rule(*g) for g in grid])
    return x.select(*regions.columns, F.inline(rules)).withColumn("off", I.off(F.col("edge"), F.col("end_lo"), F.col("end_hi")))


def summaries(offsets: DataFrame, by: I.Keys, near: float = 5.0) -> DataFrame:
    """edge_summary() of the offsets of each rule (the grid's columns)."""
    return E.edge_summary(offsets, by, "off", near)
