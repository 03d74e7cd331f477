"""Interval algebra over sets of intervals, one set for each key.

Every operator takes a DataFrame with `start` and `end` in seconds and a list of key columns, and
works on all keys at once.  A key is an episode: its intervals fit in a task, keys do not meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..options import DEFAULTS
from ..shipping import plain_unions

Keys = list[str]


def _col(value: Column | float | str) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(float(value))


def before(keys: Keys, *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: Keys, *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clamp(df: DataFrame, duration: Column | float | str, shortest: float = DEFAULTS.shortest) -> DataFrame:
    """Both ends clipped to 0..duration; what is not longer than `shortest` goes."""
    d = _col(duration)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.col(c), d))
    return df.withColumns({"start": clip("start"), "end": clip("end")}).where(F.col("end") - F.col("start") > shortest)


def pad(df: DataFrame, pre: float, post: float, duration: Column | float | str, shortest: float = DEFAULTS.shortest) -> DataFrame:
    return clamp(df.withColumns({"start": F.col("start") - pre, "end": F.col("end") + post}), duration, shortest)


def islands(df: DataFrame, keys: Keys, gap: float, order: tuple[str, ...] = ("start", "end"), name: str = "island") -> DataFrame:
    """Numbers the chains of intervals: one goes on while the next starts no later than `gap` after its end so far."""
    reach = F.max("end").over(before(keys, *order))
    return df.withColumn(name, F.coalesce(F.col("start") > reach + gap, F.lit(True)).cast("int")).withColumn(name, F.sum(name).over(upto(keys, *order)))


def one_or_mixed(column: str) -> Column:
    return F.when(F.min(column).eqNullSafe(F.max(column)), F.min(column)).otherwise("mixed")


def merge(df: DataFrame, keys: Keys, gap: float = DEFAULTS.merge_gap) -> DataFrame:
    """Chains fused: widest span; rule and source, `mixed` if they differ; least confidence (columns that df has)."""
    aggs = [F.min("start").alias("start"), F.max("end").alias("end")]
    aggs += [one_or_mixed(c).alias(c) for c in ("rule", "source") if c in df.columns]
    aggs += [F.min("confidence").alias("confidence")] if "confidence" in df.columns else []
    return islands(df, keys, gap).groupBy(*keys, "island").agg(*aggs).drop("island")


def union(df: DataFrame, keys: Keys, duration: Column | float | str | None = None) -> DataFrame:
    """Clipped, empty intervals dropped, touching ones fused."""
    out = df if duration is None else clamp(df, duration, 0.0)
    return merge(out.where("end > start").select(*keys, "start", "end"), keys, 0.0)


def keep_ranges(cuts: DataFrame, episodes: DataFrame, keys: Keys, min_keep: float = DEFAULTS.min_keep, shortest: float = DEFAULTS.shortest) -> DataFrame:
    """What the cuts leave of each episode (keys, duration): ranges of min_keep or more.

    A mark at each episode's end stands behind its cuts, so one pass sees all gaps, and an
    episode without cuts gives one range.
    """
    live = episodes.select(*keys, F.col("duration").cast("double").alias("duration")).where("duration > 0")
    cut = merge(clamp(cuts.select(*keys, "start", "end").join(live, keys), "duration", shortest).select(*keys, "start", "end"), keys, 0.0)
    marks = cut.unionByName(live.select(*keys, F.col("duration").alias("start"), F.col("duration").alias("end")))
    gap = marks.withColumn("from", F.lag("end", 1, 0.0).over(Window.partitionBy(*keys).orderBy("start", "end")))
    return gap.where((F.col("start") - F.col("from") >= min_keep) & (F.col("start") > F.col("from"))).select(*keys, F.col("from").alias("start"), F.col("start").alias("end"))


def prepare(raw: DataFrame, episodes: DataFrame, keys: Keys, pre: float = DEFAULTS.pad_before, post: float = DEFAULTS.pad_after, gap: float = DEFAULTS.merge_gap, min_keep: float = DEFAULTS.min_keep) -> tuple[DataFrame, DataFrame]:
    """(cuts, kept ranges) of raw cuts: clamp, pad, merge, invert."""
    sized = raw.join(episodes.select(*keys, F.col("duration").cast("double").alias("duration")), keys)
    cuts = merge(pad(clamp(sized, "duration"), pre, post, "duration").drop("duration"), keys, gap)
    return cuts, keep_ranges(cuts, episodes, keys, min_keep)


def total(df: DataFrame, keys: Keys, name: str = "total") -> DataFrame:
    """Seconds of all intervals, overlaps counted again, inverted ones as nothing."""
    return df.groupBy(*keys).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias(name))


def covered(df: DataFrame, keys: Keys, name: str = "covered") -> DataFrame:
    return total(merge(df.select(*keys, "start", "end"), keys, 0.0), keys, name)


def _swept(sides: list[DataFrame], keys: Keys) -> DataFrame:
    """The pieces between all ends of several sets, with how many intervals of each set cover them (d0, d1, ...)."""
    plain_unions(sides[0].sparkSession)
    events = []
    for i, side in enumerate(sides):
        for c, step in (("start", 1), ("end", -1)):
            events.append(side.where("end > start").select(*keys, F.col(c).alias("t"), *[F.lit(step if j == i else 0).alias(f"d{j}") for j in range(len(sides))]))
    names = [f"d{j}" for j in range(len(sides))]
    at = reduce(DataFrame.unionByName, events).groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in names])
    running = at.withColumns({n: F.sum(n).over(upto(keys, "t")) for n in names})
    return running.withColumn("until", F.lead("t").over(Window.partitionBy(*keys).orderBy("t"))).where("until is not null").withColumnsRenamed({"t": "start", "until": "end"})


def difference(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """What is in a left interval and in no right one."""
    pieces = _swept([left, right], keys).where("d0 > 0 and d1 = 0")
    return merge(pieces.select(*keys, "start", "end"), keys, 0.0)


def intersection(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    pieces = _swept([left, right], keys).where("d0 > 0 and d1 > 0")
    return merge(pieces.select(*keys, "start", "end"), keys, 0.0)


def blocks(segments: DataFrame, keys: Keys, gap: float = DEFAULTS.block_gap) -> DataFrame:
    """Label blocks: chains by start, with the required part and the ranges that their ends may fall in.

    Segments carry `borderline`: such parts may be cut or kept.  A block is required if any
    part is; its start may fall anywhere from its first start to its first required start, and
    its end from its last required end to its last end.
    """
    must = ~F.coalesce(F.col("borderline"), F.lit(False))
    return (
        islands(segments, keys, gap, ("start",))
        .groupBy(*keys, "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.bool_or(must).alias("required"),
            F.count(F.lit(1)).alias("parts"),
            F.min(F.when(must, F.col("start"))).alias("_first"),
            F.max(F.when(must, F.col("end"))).alias("_last"),
        )
        .select(
            *keys,
            "start",
            "end",
            "required",
            "parts",
            F.col("start").alias("start_lo"),
            F.coalesce("_first", "end").alias("start_hi"),
            F.coalesce("_last", "start").alias("end_lo"),
            F.col("end").alias("end_hi"),
        )
    )


def off(x: Column, lo: Column, hi: Column) -> Column:
    """Signed distance of x to lo..hi: negative before it, 0 inside."""
    return F.when(x < lo, x - lo).when(x > hi, x - hi).otherwise(F.lit(0.0))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def interior_left(required: DataFrame, hits: DataFrame, keys: Keys, bucket: float | None = None) -> DataFrame:
    """For each required block (keys, start, end): seconds between its first and last hit that no hit covers."""
    block = [*keys, "b_start", "b_end"]
    b = required.select(*keys, "start", "end")
    touching = overlapping(b, hits.select(*keys, "start", "end"), keys, bucket=bucket).withColumnsRenamed({"start": "b_start", "end": "b_end"})
    inside = touching.select(*block, F.greatest("r_start", "b_start").alias("start"), F.least("r_end", "b_end").alias("end"))
    spans = inside.groupBy(*block).agg(F.min("start").alias("_a"), F.max("end").alias("_b"))
    left = covered(inside, block).join(spans, block).select(*block, (F.col("_b") - F.col("_a") - F.col("covered")).alias("left"))
    return b.withColumnsRenamed({"start": "b_start", "end": "b_end"}).join(left, block, "left").select(*block, F.coalesce("left", F.lit(0.0)).alias("left"))


def _cells(start: Column, end: Column, bucket: float) -> Column:
    """The numbers of the time buckets from start to end."""
    return F.explode(F.sequence(F.floor(start / bucket), F.floor(end / bucket)))


def overlapping(left: DataFrame, right: DataFrame, keys: Keys, how: str = "inner", bucket: float | None = None) -> DataFrame:
    """Pairs (or left rows, for left_semi and left_anti) with an overlap of more than nothing.

    right's start and end are r_start and r_end.  The keys make it an equi-join with a residual range.  With
    `bucket` seconds both sides are cut into time buckets, which join too: for keys that hold
    very many intervals.  Pairs that meet in several buckets come once, from the first shared one; left rows that
    are equal in all columns are judged once and come as often as they stand there.
    """
    r = right.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    meets = (F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end"))
    if bucket is None:
        pair = reduce(lambda a, k: a & (left[k] == r[k]), keys[1:], left[keys[0]] == r[keys[0]]) & meets
        out = left.join(r, pair, how)
        return reduce(lambda d, k: d.drop(r[k]), keys, out) if how == "inner" else out
    rb = r.withColumn("_cell", _cells(F.col("r_start"), F.col("r_end"), bucket))
    if how == "inner":
        first = F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("r_start") / bucket))
        lb = left.withColumn("_cell", _cells(F.col("start"), F.col("end"), bucket))
        return lb.join(rb, [*keys, "_cell"]).where(meets & (F.col("_cell") == first)).drop("_cell")
    rows = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_n"))
    lb = rows.withColumn("_cell", _cells(F.col("start"), F.col("end"), bucket))
    pair = reduce(lambda a, k: a & (lb[k] == rb[k]), keys, lb["_cell"] == rb["_cell"]) & meets
    met = lb.join(rb, pair, "left_semi").drop("_cell").distinct()
    if how == "left_anti":
        m = met.select(*[F.col(c).alias(f"_m_{c}") for c in left.columns])
        met = rows.join(m, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in left.columns]), "left_anti")
    return met.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*left.columns)


def greatest_overlap(left: DataFrame, right: DataFrame, keys: Keys, left_id: Keys, right_cols: list[str], bucket: float | None = None) -> DataFrame:
    """For each left row: the right row with the greatest overlap (earliest, then shortest, on ties), null if none."""
    pairs = overlapping(left, right.select(*keys, "start", "end", *right_cols), keys, bucket=bucket)
    size = overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    best = F.max_by(F.struct("r_start", "r_end", *right_cols, size.alias("overlap")), F.struct(size, -F.col("r_start"), -F.col("r_end")))
    chosen = pairs.groupBy(*keys, *left_id).agg(best.alias("_b"))
    return left.join(chosen, [*keys, *left_id], "left").select(*left.columns, "_b.r_start", "_b.r_end", *[F.col(f"_b.{c}").alias(c) for c in right_cols], "_b.overlap")


def same_start_or_greatest_overlap(left: DataFrame, right: DataFrame, keys: Keys, left_id: Keys, right_cols: list[str], bucket: float | None = None) -> DataFrame:
    """For each left row: the right row that starts where it does (the shortest), or else the one with the greatest
    overlap; `by` is start, overlap or null."""
    equal = right.groupBy(*keys, F.col("start")).agg(F.min_by(F.struct(F.col("start").alias("r_start"), F.col("end").alias("r_end"), *right_cols), F.struct("end", *right_cols)).alias("_e"))
    best = greatest_overlap(left, right, keys, left_id, right_cols, bucket)
    both = best.withColumnsRenamed({c: f"_o_{c}" for c in ("r_start", "r_end", *right_cols)}).drop("overlap").join(equal, [*keys, "start"], "left")
    by = F.when(F.col("_e").isNotNull(), "start").when(F.col("_o_r_start").isNotNull(), "overlap")
    return both.select(*left.columns, *[F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in ("r_start", "r_end", *right_cols)], by.alias("by"))


def containing(points: DataFrame, segments: DataFrame, keys: Keys, point: str, point_id: Keys, seq: str, value: str, bucket: float | None = None) -> DataFrame:
    """Each point with `value` of the first segment (by seq) with start <= point < end, null if none."""
    p, on = points, list(keys)
    s = segments.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(seq).alias("_q"), F.col(value).alias("_v"))
    if bucket is not None:
        p, s, on = p.withColumn("_cell", F.floor(F.col(point) / bucket)), s.withColumn("_cell", _cells(F.col("_s"), F.col("_e"), bucket)), [*on, "_cell"]
    hit = p.join(s, on).where((F.col("_s") <= F.col(point)) & (F.col(point) < F.col("_e"))).groupBy(*keys, *point_id).agg(F.min_by("_v", "_q").alias(value))
    return points.join(hit, [*keys, *point_id], "left")


def snapped(points: DataFrame, silences: DataFrame, keys: Keys, point: str, point_id: Keys, reach: float = DEFAULTS.snap_reach, bucket: float | None = None) -> DataFrame:
    """Each point moved to the nearest silence's middle within reach (earliest on ties), else as it is: `snapped`."""
    p, on = points, list(keys)
    mids = silences.select(*keys, ((F.col("start") + F.col("end")) / 2).alias("_mid"))
    if bucket is not None:
        p, mids, on = p.withColumn("_cell", _cells(F.col(point) - reach, F.col(point) + reach, bucket)), mids.withColumn("_cell", F.floor(F.col("_mid") / bucket)), [*on, "_cell"]
    near = p.join(mids, on).where(F.abs(F.col("_mid") - F.col(point)) <= reach)
    moved = near.groupBy(*keys, *point_id).agg(F.min_by("_mid", F.struct(F.abs(F.col("_mid") - F.col(point)), F.col("_mid"))).alias("_to"))
    return points.join(moved, [*keys, *point_id], "left").withColumn("snapped", F.coalesce("_to", point)).drop("_to")


def tail_trim(cuts: DataFrame, episodes: DataFrame, keys: Keys, at_least: float = DEFAULTS.tail_min) -> DataFrame:
    """cuts, and for episodes (keys, duration, speech_end, keep_tail) whose speech ends `at_least` seconds early, the tail."""
    tail = episodes.where((F.col("duration") - F.col("speech_end") >= at_least) & (F.col("speech_end") > 0) & ~F.col("keep_tail"))
    return cuts.unionByName(tail.select(*keys, F.col("speech_end").alias("start"), F.col("duration").alias("end")), allowMissingColumns=True)


def cut_pattern(episodes: DataFrame, keys: Keys, period: float, length: float) -> DataFrame:
    """Synthetic cuts: `length` seconds in the middle of each whole period of an episode (keys, duration)."""
    n = F.floor(F.col("duration") / period)
    return episodes.where(n > 0).select(*keys, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i")).select(
        *keys, (F.col("i") * period + (period - length) / 2).alias("start"), (F.col("i") * period + (period + length) / 2).alias("end")
    )
