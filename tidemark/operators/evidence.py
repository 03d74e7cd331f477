"""Recorded model answers, found again by what was asked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import Keys


def key(kind: Column, state: Column, questions: Column) -> Column:
    """SHA-256 of a request; the order of its questions does not matter."""
    return F.sha2(F.concat_ws("\u0001", kind, state, F.array_join(F.array_sort(questions), "\u0002")), 256)


def replayed(asked: DataFrame, recorded: DataFrame, keys: Keys, order: str, answer: str) -> DataFrame:
    """The k-th request with a key gets the k-th recorded answer with it; `found` is false where there is none."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = asked.withColumn("_k", F.row_number().over(w))
    r = recorded.withColumn("_k", F.row_number().over(w)).select(*keys, "_k", answer, F.lit(True).alias("found"))
    return a.join(r, [*keys, "_k"], "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("_k")


def differing(left: DataFrame, right: DataFrame, columns: list[str], keys: Keys) -> DataFrame:
    """Keys whose rows of decisions differ, repeats counted, with how many rows stand on one side only."""
    a, b = left.select(*keys, *columns), right.select(*keys, *columns)
    one = a.exceptAll(b).withColumn("_s", F.lit("left")).unionByName(b.exceptAll(a).withColumn("_s", F.lit("right")))
    return one.groupBy(*keys).agg(F.count_if(F.col("_s") == "left").alias("only_left"), F.count_if(F.col("_s") == "right").alias("only_right"))


def same(left: DataFrame, right: DataFrame, columns: list[str], keys: Keys) -> bool:
    return differing(left, right, columns, keys).isEmpty()


def incomplete(replay: DataFrame, keys: Keys) -> DataFrame:
    """Keys with a request that has no recorded answer: such a replay decides nothing."""
    return replay.groupBy(*keys).agg(F.count_if(~F.col("found")).alias("unanswered")).where("unanswered > 0")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
