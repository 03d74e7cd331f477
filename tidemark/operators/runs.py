"""Runs of scored windows: gaps and islands over (keys, idx, start, end, rule, prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..options import DEFAULTS
from .intervals import Keys, upto

CONTENT = "content"


def votes(df: DataFrame, keys: Keys, group: str) -> DataFrame:
    """(keys, group, rule): the rule with the greatest sum of probabilities; ties go to the smallest name."""
    sums = df.groupBy(*keys, group, "rule").agg(F.sum("prob").alias("votes"))
    order = Window.partitionBy(*keys, group).orderBy(F.desc("votes"), "rule")
    return sums.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def clusters(scored: DataFrame, keys: Keys, threshold: float = DEFAULTS.anchor_threshold) -> DataFrame:
    """Adjacent qualifying windows as one run: voted rule, span, greatest probability, number of windows."""
    qualifies = (F.col("rule") != CONTENT) & (F.col("prob") >= threshold)
    marked = scored.withColumn("_run", F.sum((~qualifies).cast("int")).over(upto(keys, "idx"))).where(qualifies)
    spans = marked.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("prob").alias("prob"), F.count(F.lit(1)).alias("windows"))
    return spans.join(votes(marked, keys, "_run").drop("votes"), [*keys, "_run"]).select(*keys, "rule", "start", "end", "prob", "windows")


def bridge(runs: DataFrame, keys: Keys, gap: float = DEFAULTS.bridge_gap) -> DataFrame:
    """Consecutive runs of one rule, at most `gap` apart, as one; its end is the last run's.  A run of another rule between them parts them."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    joins = (F.col("rule") == F.lag("rule").over(order)) & (F.col("start") - F.lag("end").over(order) <= gap)
    linked = runs.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(upto(keys, "start", "end")))
    return (
        linked.groupBy(*keys, "_run")
        .agg(F.min("rule").alias("rule"), F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.max("prob").alias("prob"), F.sum("windows").alias("windows"))
        .drop("_run")
    )


def weak_leads(scored: DataFrame, keys: Keys, weak: float = DEFAULTS.weak_lead, strong: float = DEFAULTS.anchor_threshold) -> DataFrame:
    """Runs of windows from weak to below strong, none beside a strong one (whatever its rule); the rule is the first window's."""
    order = Window.partitionBy(*keys).orderBy("idx")
    beside = (F.coalesce(F.lag("prob").over(order), F.lit(0.0)) >= strong) | (F.coalesce(F.lead("prob").over(order), F.lit(0.0)) >= strong)
    fits = (F.col("rule") != CONTENT) & (F.col("prob") >= weak) & (F.col("prob") < strong)
    marked = scored.withColumn("_fits", fits & ~beside).withColumn("_run", F.sum((~F.col("_fits")).cast("int")).over(upto(keys, "idx"))).where("_fits")
    return marked.groupBy(*keys, "_run").agg(
        F.min_by("rule", "idx").alias("rule"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("prob").alias("prob"), F.count(F.lit(1)).alias("windows")
    ).drop("_run")


def localized(sentences: DataFrame, keys: Keys, threshold: float = DEFAULTS.localize_threshold) -> DataFrame:
    """Runs of classified sentences (keys include the span) at or over the threshold, with the voted rule."""
    return clusters(sentences, keys, threshold)


def batches(windows: DataFrame, keys: Keys, size: int = DEFAULTS.batch) -> DataFrame:
    """Windows by request batch, each with one window of context on either side: batch, and context true for the neighbours."""
    own = F.floor(F.col("idx") / size).cast("int")
    ends = windows.withColumn("_last", F.max("idx").over(Window.partitionBy(*keys)))
    at = F.col("idx") % size
    before = F.when((at == size - 1) & (F.col("idx") < F.col("_last")), F.array(F.struct((own + 1).alias("batch"), F.lit(True).alias("context")))).otherwise(F.array().cast("array<struct<batch:int,context:boolean>>"))
    after = F.when((at == 0) & (F.col("idx") > 0), F.array(F.struct((own - 1).alias("batch"), F.lit(True).alias("context")))).otherwise(F.array().cast("array<struct<batch:int,context:boolean>>"))
    mine = F.array(F.struct(own.alias("batch"), F.lit(False).alias("context")))
    return ends.withColumn("_b", F.explode(F.concat(before, mine, after))).select(*windows.columns, "_b.batch", "_b.context")


def region_filter(regions: DataFrame, shortest: float = DEFAULTS.min_region, localized_shortest: float = DEFAULTS.min_localized_region) -> DataFrame:
    """regions (start, end, localized) with `kept`: long enough, for localized ones a lower bar."""
    bar = F.when(F.col("localized"), localized_shortest).otherwise(shortest)
    return regions.withColumn("kept", F.col("end") - F.col("start") >= bar)
