"""Chapters carried through the ranges that an edit keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import Keys


def timeline(keeps: DataFrame, keys: Keys, crossfade: float) -> DataFrame:
    """Kept ranges with n from 0 and `offset`, the edited time where each begins: what was kept before, less a fade for each join."""
    w = Window.partitionBy(*keys).orderBy("start")
    ms = keeps.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)}).withColumn("n", F.row_number().over(w) - 1)
    kept = F.coalesce(F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return ms.withColumn("offset", kept - F.col("n") * round(crossfade, 3))


def timeline_problems(keeps: DataFrame, keys: Keys, crossfade: float, edited: DataFrame, slack: float = 0.25) -> DataFrame:
    """Keys whose ranges are out of order, shorter than the fade, or not as long as the edited audio (keys, duration)."""
    w = Window.partitionBy(*keys).orderBy("n")
    t = timeline(keeps, keys, crossfade).withColumn("_before", F.lag("end").over(w))
    facts = t.groupBy(*keys).agg(
        F.bool_or(F.coalesce(F.col("start") < F.col("_before"), F.lit(False)) | (F.col("end") <= F.col("start"))).alias("order"),
        F.bool_or(F.col("end") - F.col("start") < crossfade).alias("short"),
        F.max(F.col("offset") + F.col("end") - F.col("start")).alias("length"),
    )
    return facts.join(edited, keys).select(*keys, F.when(F.col("order"), "order").when(F.col("short"), "short").when(F.abs(F.col("length") - F.col("duration")) > slack, "length").alias("problem")).where("problem is not null")


def derive(chapters: DataFrame, keeps: DataFrame, episodes: DataFrame, keys: Keys, crossfade: float = 0.05) -> DataFrame:
    """Chapters (keys, seq, start, end or null, title) in edited time (keys, start, title).

    A chapter ends at the next later start, its own end or the source's end (episodes: keys, source_duration, duration).  It moves
    to where the first kept range that meets it begins to show it, and goes if none does.  Of chapters that
    land on one instant the first in source order stays.
    """
    usable = (F.col("start") >= 0) & ~F.isnan("start") & (F.trim("title") != "") & ~F.col("title").rlike(r"(?i)^\s*<untitled chapter \d+>\s*$")
    # equal starts share their next later start, so a range frame is needed, in whole microseconds
    c = chapters.withColumn("_us", F.round(F.col("start") * 1e6).cast("long"))
    later = Window.partitionBy(*keys).orderBy("_us").rangeBetween(1, Window.unboundedFollowing)
    c = c.withColumn("_next", F.min("start").over(later)).join(episodes, keys)
    c = c.where(usable & (F.col("start") < F.col("source_duration")) & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    c = c.withColumn("_end", F.least("source_duration", "_next", "end"))
    k = timeline(keeps, keys, crossfade).select(*keys, "n", F.col("start").alias("k_start"), F.col("end").alias("k_end"), "offset")
    meets = c.join(k, keys).where(F.greatest("k_start", "start") < F.least("k_end", "_end"))
    at = F.round(F.greatest(F.lit(0.0), F.col("offset") + F.greatest("k_start", "start") - F.col("k_start")), 3)
    first = meets.groupBy(*keys, "seq", "start", "title", "duration").agg(F.min_by(at, F.col("n")).alias("at")).where("at < duration")
    w = Window.partitionBy(*keys, "at").orderBy("start", "seq")
    return first.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, F.col("at").alias("start"), F.trim("title").alias("title"))


def chapter_json(chapters: DataFrame, keys: Keys) -> DataFrame:
    """(keys, json): the chapters of each key as a Podcasting 2.0 document."""
    rows = F.array_sort(F.collect_list(F.struct("start", "title")))
    body = F.struct(F.lit("1.2.0").alias("version"), F.transform(rows, lambda c: F.struct(c["start"].alias("startTime"), c["title"].alias("title"))).alias("chapters"))
    return chapters.groupBy(*keys).agg(F.to_json(body).alias("json"))
