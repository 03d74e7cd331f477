"""Logistic scores of feature maps, and checks of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import Keys

LIMIT = 30.0


def sigmoid(z: Column, limit: float = LIMIT) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), z))))


def logistic(values: Column, weights: dict[str, float], bias: float) -> Column:
    """Score of a feature map; a feature that is not there counts as 0.  Terms are added in the order of their names."""
    z = F.lit(float(bias))
    for name in sorted(weights):
        z = z + F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(0.0)) * F.lit(float(weights[name]))
    return sigmoid(z)


def missing(values: Column, weights: dict[str, float]) -> Column:
    """Names with a weight and no feature, sorted."""
    return F.array_sort(F.array_except(F.array(*[F.lit(n) for n in sorted(weights)]), F.map_keys(values)))


def feature_maps(long: DataFrame, keys: Keys, name: str = "feature", value: str = "value") -> DataFrame:
    """(keys, values): long rows gathered into one map; a feature that comes twice keeps its greatest value."""
    once = long.groupBy(*keys, name).agg(F.max(value).cast("double").alias("_v"))
    return once.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col("_v").alias("value"))))).alias("values"))


def scan_rule(probs: Column, rules: list[str]) -> tuple[Column, Column]:
    """(rule, prob) of a window: the likeliest cut rule, first in order on ties, `content` if all are 0; the sum over cut rules."""
    p = [F.coalesce(F.try_element_at(probs, F.lit(r)), F.lit(0.0)) for r in rules]
    best = F.greatest(*p) if len(p) > 1 else p[0]
    rule = F.lit("content")
    for name, value in reversed(list(zip(rules, p, strict=True))):
        rule = F.when((value == best) & (best > 0), name).otherwise(rule)
    total = F.lit(0.0)
    for value in p:
        total = total + value
    return rule, total


def answer_problem(probs: Column, names: list[str], slack: float = 0.02) -> Column:
    """What is wrong with an answer's probabilities, or null: keys, range, or sum."""
    keys_ok = F.array_sort(F.map_keys(probs)) == F.array(*[F.lit(n) for n in sorted(names)])
    in_range = F.forall(F.map_values(probs), lambda v: v.between(0, 1))
    total = F.aggregate(F.map_values(probs), F.lit(0.0), lambda a, v: a + v)
    return F.when(~keys_ok, "keys").when(~in_range, "range").when(F.abs(total - 1) > slack, "sum")


def checked(df: DataFrame, problem: Column) -> DataFrame:
    """df if none of its rows has a problem, else an error that counts the rows of each problem.

    The rows are looked at here and now: an error inside a later filter would depend on which task came first.
    """
    # a row for each kind of problem
    found = df.select(problem.alias("_problem")).where("_problem is not null").groupBy("_problem").count().orderBy("_problem").collect()
    if found:
        raise ValueError("answers with problems: " + ", ".join(f"{r['_problem']} ({r['count']})" for r in found))
    return df


def with_predicate(maps: DataFrame, answers: DataFrame, keys: Keys, name: str = "predicate", value: str = "p") -> DataFrame:
    """Feature maps (keys, values) with one more feature: the answer (keys, p) of the predicate itself, where there is one."""
    both = maps.join(answers.select(*keys, F.col(value).cast("double").alias("_p")), keys, "left")
    more = F.when(F.col("_p").isNotNull(), F.map_concat("values", F.create_map(F.lit(name), F.col("_p")))).otherwise(F.col("values"))
    return both.withColumn("values", more).drop("_p")
