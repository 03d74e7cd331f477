"""Detection offline: from scored windows to cuts, one lineage for all episodes.

Model answers are data: the scores are a table, and nothing here asks for more.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import curves as C
from ..operators import intervals as I
from ..operators import runs as R
from ..options import DEFAULTS, Options

#: For the events table, whose windows lie hours apart.
EVENTS = replace(
    DEFAULTS, anchor_threshold=0.35, weak_lead=0.15, merge_gap=21600.0, min_region=600.0, min_localized_region=300.0, pad_before=300.0, pad_after=300.0, min_keep=60.0,
    start_reach=86400.0, start_inside=0.25, localized_min_step=0.1, end_first=5, end_step=0.12, outro_from=0.4,
)


def anchors(scored: DataFrame, keys: I.Keys, options: Options = DEFAULTS) -> DataFrame:
    """Strong runs, bridged, and weak leads: (keys, rule, start, end, prob, windows, localized)."""
    strong = R.bridge(R.clusters(scored, keys, options.anchor_threshold), keys, options.bridge_gap).withColumn("localized", F.lit(False))
    weak = R.weak_leads(scored, keys, options.weak_lead, options.anchor_threshold).withColumn("localized", F.lit(True))
    return strong.unionByName(weak)


def regions(scored: DataFrame, keys: I.Keys, options: Options = DEFAULTS) -> DataFrame:
    """Anchors with `kept`: those too short to be cut are dropped (a lower bar for localized ones)."""
    return R.region_filter(anchors(scored, keys, options), options.min_region, options.min_localized_region)


def cuts(scored: DataFrame, episodes: DataFrame, keys: I.Keys, options: Options = DEFAULTS) -> DataFrame:
    """Cuts of the scan alone (keys, start, end, rule, source, confidence): kept regions, clamped and fused."""
    return _fused(regions(scored, keys, options), episodes, keys, options)


def _fused(found: DataFrame, episodes: DataFrame, keys: I.Keys, options: Options, pre: float = 0.0, post: float = 0.0) -> DataFrame:
    kept = found.where("kept").join(episodes, keys)
    source = F.when(F.col("localized"), "localized").otherwise("scan")
    named = I.clamp(kept.withColumns({"source": source, "confidence": F.col("prob")}), "duration")
    padded = I.pad(named, pre, post, "duration") if pre or post else named
    return I.merge(padded.select(*keys, "start", "end", "rule", "source", "confidence"), keys, options.merge_gap)


def numbered(anchors_df: DataFrame, keys: I.Keys) -> DataFrame:
    """Anchors with `anchor`, their number within the keys in order of time."""
    return anchors_df.withColumn("anchor", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "rule", "localized")) - 1)


def bound_starts(anchors_df: DataFrame, points: DataFrame, classified: DataFrame, keys: I.Keys, options: Options = DEFAULTS) -> DataFrame:
    """Starts of anchors (keys, start, end, localized) from their start curves (keys, idx, p_start, p) and the sentences of
    theirs that were classified one by one (keys, start, p).  The keys name one anchor.  Result: keys, new_start, reason.

    The curve's step or its first point within the anchor moves the start, but for two cases: a localized anchor, which was
    found sentence by sentence, never starts at its end or later, and earlier only by a tall step; and another one starts earlier only
    if some point from its start on is recognised.  An anchor that is not localized and whose curve says nothing starts at its
    first classified sentence at the anchor threshold or more.  A curve of fewer than two points moves nothing.
    """
    return _starts(anchors_df, points, classified, keys, options).select(*keys, "new_start", "reason")


def _starts(anchors_df: DataFrame, points: DataFrame, classified: DataFrame, keys: I.Keys, options: Options) -> DataFrame:
    """anchors_df with new_start and reason."""
    named = anchors_df.withColumnsRenamed({"start": "anchor_start", "end": "anchor_end"})
    edge = C.start_edges(named, points.select(*keys, "idx", F.col("p_start").alias("start"), "p"), keys, options.start_reach, options.start_inside)
    sure = classified.where(F.col("p") >= options.anchor_threshold).groupBy(*keys).agg(F.min("start").alias("_sure"))
    x = edge.join(sure, keys, "left")
    earlier = F.col("new_start") < F.col("anchor_start")
    refines = (F.col("new_start") < F.col("anchor_end")) & (~earlier | (F.col("step") >= options.localized_min_step))
    moves = (F.col("points") > 1) & (F.col("pick") != "kept") & F.when(F.col("localized"), refines).otherwise(~earlier | F.col("seen"))
    asks = (F.col("points") > 1) & ~F.col("localized") & F.col("_sure").isNotNull()
    start = F.when(moves, F.col("new_start")).when(asks, F.col("_sure")).otherwise(F.col("anchor_start"))
    reason = F.when(moves, F.col("pick")).when(asks, "classified").otherwise("kept")
    out = x.withColumns({"new_start": start, "reason": reason}).withColumnsRenamed({"anchor_start": "start", "anchor_end": "end"})
    return out.select(*anchors_df.columns, "new_start", "reason")


def bounded(anchors_df: DataFrame, start_points: DataFrame, end_points: DataFrame, classified: DataFrame, outros: DataFrame, keys: I.Keys, options: Options = DEFAULTS) -> DataFrame:
    """Regions of anchors (keys with `anchor`; rule, start, end, prob, localized): start and end bounded, `kept` if long enough.

    An anchor that is an outro (outros: keys, outro) starts no earlier than its first classified sentence at `outro_from` or more.
    Ends are sought from the new start on.
    """
    x = _starts(anchors_df, start_points, classified, keys, options).withColumnRenamed("reason", "start_reason")
    sentences = classified.where(F.col("p") >= options.outro_from).groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("_sure"))
    x = x.join(outros.select(*keys, "outro"), keys, "left").join(sentences, keys, "left")
    first = F.get(F.filter("_sure", lambda t: (t >= F.col("new_start")) & (t < F.col("end"))), 0)
    trims = F.coalesce(F.col("outro"), F.lit(False)) & (F.col("new_start") < F.col("end"))
    x = x.withColumn("start", F.when(trims, F.coalesce(first, "new_start")).otherwise(F.col("new_start"))).drop("new_start", "outro", "_sure")
    found = _ends(x, end_points, keys, options, True).withColumnRenamed("reason", "end_reason").withColumn("end", F.col("new_end")).drop("new_end")
    return R.region_filter(found, options.min_region, options.min_localized_region)


def edited(found: DataFrame, episodes: DataFrame, keys: I.Keys, options: Options = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(cuts, kept ranges) of bounded regions: clamped, padded, fused, and what they leave."""
    done = _fused(found, episodes, keys, options, options.pad_before, options.pad_after)
    return done, I.keep_ranges(done, episodes, keys, options.min_keep)


def bound_ends(anchors_df: DataFrame, points: DataFrame, keys: I.Keys, options: Options = DEFAULTS, conservative: bool = True) -> DataFrame:
    """Ends of anchors (keys, start, end, localized) from their end curves (keys, idx, p_start, p_end, p, ad or null).

    The keys name one anchor.  Result: keys, new_end, reason.

    The fitted step is where the programme comes back; without any return the read runs to the last point.  An ambiguous curve
    starts from the first point inside the anchor that is scored as an ad; failing that, a wholly low-scored tail inside the
    anchor is kept (if `conservative`, and if a cut long enough remains), else the anchor's end counts.  Then the end moves on
    past points still scored as ads.  Localized anchors and curves of fewer than two points keep their end.
    """
    return _ends(anchors_df, points, keys, options, conservative).select(*keys, "new_end", "reason")


def _ends(anchors_df: DataFrame, points: DataFrame, keys: I.Keys, options: Options, conservative: bool) -> DataFrame:
    """anchors_df with new_end and reason."""
    curve = C.gathered(points, keys, "p_start", "p_end", "ad")
    fit = C.end_fit(F.col("ys"), options.end_first, options.end_step, options.end_never)
    x = anchors_df.join(curve.withColumn("_fit", fit).select("*", "_fit.end_idx", "_fit.state").drop("_fit"), keys, "left").withColumn("n", F.size("ys"))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    start_of = lambda i: F.get("p_start", i)
    ad_of = lambda i: F.get("ad", i)
    inside = F.filter(places, lambda i: (start_of(i) >= F.col("start")) & (start_of(i) < F.col("end")))
    has_ads = F.exists("ad", lambda a: a.isNotNull())
    x = x.withColumns(
        {
            "_inside": inside,
            "_seed": F.array_min(F.filter(inside, lambda i: ad_of(i) >= options.extend_while)),
            "_after": F.coalesce(F.array_min(F.filter(places, lambda i: start_of(i) >= F.col("end"))), F.col("n")),
        }
    )
    tail = F.array_min("_inside")
    low = F.size("_inside") > 0
    quiet = ~F.exists("_inside", lambda i: ad_of(i) > 1 - options.extend_while)
    keeps_tail = F.lit(conservative) & F.lit(0.5 < options.extend_while <= 1) & has_ads & low & quiet & (start_of(tail) - F.col("start") >= options.min_region)
    base = (
        F.when(F.col("state") == "never", F.col("n"))
        .when(F.col("state") != "ambiguous", F.col("end_idx"))
        .when(F.col("_seed").isNotNull(), F.col("_seed"))
        .when(keeps_tail, tail)
        .otherwise(F.col("_after"))
    )
    reason = F.when((F.col("state") == "ambiguous") & F.col("_seed").isNull() & keeps_tail, "low tail kept").otherwise(F.col("state"))
    x = x.withColumns({"_base": base, "_why": reason})
    walked = F.when(has_ads, C.end_walk(F.col("ad"), F.col("_base"), options.extend_while)).otherwise(F.col("_base"))
    x = x.withColumn("_at", walked)
    found = F.when(F.col("_at") >= F.col("n"), F.greatest(F.element_at("p_end", -1), F.col("end"))).otherwise(start_of(F.col("_at")))
    kept = F.col("localized") | F.col("n").isNull() | (F.col("n") < 2)
    why = F.when(F.col("localized"), "localized run").when(kept, "no curve").when(F.col("_at") > F.col("_base"), F.concat("_why", F.lit(", extended"))).otherwise(F.col("_why"))
    return x.select(*anchors_df.columns, F.when(kept, F.col("end")).otherwise(found).alias("new_end"), why.alias("reason"))
