"""A ledger of model calls: (keys, rate, input, output, missing, reported_cost), summed and subtracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import Keys

COUNTERS = ("calls", "input", "output", "missing", "unpriced", "reported", "cost")


def observe(calls: DataFrame, rates: DataFrame, keys: Keys) -> DataFrame:
    """Counters of each (keys, rate): tokens of calls that reported usage, cost at the rate's prices a million tokens.

    Calls stay where they are and meet the price list there: dealt by rate, all calls of a rate would be one task's.
    """
    priced = calls.join(F.broadcast(rates), "rate", "left")
    seen = ~F.col("missing_usage")
    has_price = F.col("input_price").isNotNull()
    cost = (F.col("input") * F.col("input_price") + F.col("output") * F.col("output_price")) / 1e6
    return priced.groupBy(*keys, "rate").agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum(F.when(seen, F.col("input"))), F.lit(0)).alias("input"),
        F.coalesce(F.sum(F.when(seen, F.col("output"))), F.lit(0)).alias("output"),
        F.count_if(~seen).alias("missing"),
        F.count_if(seen & ~has_price).alias("unpriced"),
        F.count_if(F.col("reported_cost").isNotNull()).alias("reported"),
        F.coalesce(F.sum(F.when(seen & has_price, cost)), F.lit(0.0)).alias("cost"),
    )


def interval(now: DataFrame, then: DataFrame, keys: Keys) -> DataFrame:
    """now minus then, by (keys, rate); groups without a call in between vanish."""
    signed = lambda df, s: df.select(*keys, "rate", *[(F.col(c) * s).alias(c) for c in COUNTERS])
    return signed(now, 1).unionByName(signed(then, -1)).groupBy(*keys, "rate").agg(*[F.sum(c).alias(c) for c in COUNTERS]).where("calls <> 0")


def rollup(summary: DataFrame, levels: Keys) -> DataFrame:
    """Counters at every level of the keys, from the finest to the total (keys null above their level)."""
    return summary.rollup(*levels).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.grouping_id().cast("int").alias("level"))


def deltas(totals: DataFrame, keys: Keys, order: str, counters: list[str]) -> DataFrame:
    """Running totals as steps from the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    step: dict[str, Column] = {c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in counters}
    return totals.withColumns(step)


def attributed(attempts: DataFrame, runs: DataFrame, keys: Keys, at: str, counters: list[str]) -> DataFrame:
    """Unfinished runs (keys, at, result) with the counters of the attempts that began under them: those with the run's keys and
    start instant.  A finished run takes nothing more."""
    sums = attempts.groupBy(*keys, at).agg(*[F.sum(c).alias(c) for c in counters], F.count(F.lit(1)).alias("attempts"))
    open_ = F.col("result") == "unfinished"
    out = runs.join(sums, [*keys, at], "left")
    return out.select(*runs.columns, *[F.when(open_, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c) for c in ("attempts", *counters)])
