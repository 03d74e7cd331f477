"""Feature rows of candidate sentences, from answers and text to one dense row for each, and their labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import intervals as I
from ..operators import scoring as S

#: The features that are answered about each sentence of a start, in order.
START_FEATURES = (
    "first_person", "names_brand", "addresses_listener", "on_topic", "benefit_claim", "anecdote", "dated_fact", "transition", "gratitude",
    "could_be_removed", "problem_setup", "product_category", "continues_previous", "leads_into_ad", "production_meta",
)
#: Of an end: the lead-in gives way to the wind-down, and the answer to the return of the programme comes last.
END_FEATURES = (*(f for f in START_FEATURES if f != "leads_into_ad"), "winds_down_ad")
PREDICATE = "predicate_returned"
#: Features that the text alone answers, and what they look for.
LEXICAL = {
    "lex_thanks": ["thanks to", "thank you to", "sponsored by", "supported by", "brought to you by"],
    "lex_cta": ["head to", "check out", "sign up", "use code", "go to ", "visit ", "download the", "try it"],
    "lex_url": [".com", ".co/", ".io", "http", "slash "],
}


def feature_names(edge: str) -> list[str]:
    """The columns of a feature row: answered, then lexical, then (of an end) the predicate's answer."""
    return [*(START_FEATURES if edge == "start" else END_FEATURES), *LEXICAL, *([PREDICATE] if edge == "end" else [])]


def seams(sentences: DataFrame, keys: I.Keys) -> DataFrame:
    """sentences with `previous`, the text of the candidate before (empty at the first), and `place`, 0 at the first and 1 at the last."""
    order = Window.partitionBy(*keys).orderBy("idx")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    place = F.when(n > 1, (F.row_number().over(order) - 1) / (n - 1)).otherwise(F.lit(0.0))
    return sentences.withColumns({"previous": F.coalesce(F.lag("text").over(order), F.lit("")), "place": place})


def answer_columns(names: list[str]) -> Column:
    """What is wrong with a row's answers, or null: names that are missing, unknown or out of 0..1."""
    listed = F.array(*[F.lit(n) for n in sorted(names)])
    given = F.coalesce(F.map_keys("_answers"), F.array().cast("array<string>"))
    lacking, unknown = F.array_except(listed, given), F.array_except(given, listed)
    bad = F.exists(F.coalesce(F.map_values("_answers"), F.array().cast("array<double>")), lambda v: v.isNull() | ~v.between(0, 1))
    return (
        F.when(F.size(lacking) > 0, F.concat(F.lit("no answer to "), F.array_join(F.array_sort(lacking), ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(unknown), ", ")))
        .when(bad, "an answer out of range")
    )


def feature_rows(sentences: DataFrame, answers: DataFrame, keys: I.Keys, edge: str = "start", predicate: DataFrame | None = None) -> DataFrame:
    """One row for each candidate (keys, idx, start, end, text) with previous, place and the features of the edge as columns.

    answers: (keys, idx, feature, value) in any order; predicate (of an end): (keys, idx, value).  An answer that is
    missing, unknown or out of range is an error that counts the rows concerned, as is a missing predicate.
    """
    answered = list(START_FEATURES if edge == "start" else END_FEATURES)
    on = [*keys, "idx"]
    maps = S.feature_maps(answers, on).withColumnRenamed("values", "_answers")
    rows = seams(sentences, keys).join(maps, on, "left")
    problem = answer_columns(answered)
    if edge == "end":
        if predicate is None:
            raise ValueError("an end needs the predicate's answers")
        rows = rows.join(predicate.select(*on, F.col("value").cast("double").alias(PREDICATE)), on, "left")
        problem = F.coalesce(problem, F.when(F.col(PREDICATE).isNull() | ~F.col(PREDICATE).between(0, 1), "no answer of the predicate"))
    rows = S.checked(rows, problem)
    columns = [F.try_element_at("_answers", F.lit(n)).alias(n) for n in answered]
    columns += [T.lexical(F.col("text"), needles).alias(n) for n, needles in LEXICAL.items()]
    columns += [F.col(PREDICATE)] if edge == "end" else []
    return rows.select(*on, "start", "end", "text", "previous", "place", *columns)


def labelled(rows: DataFrame, segments: DataFrame, keys: I.Keys) -> DataFrame:
    """rows with `label`: 1 if their middle lies in a required segment (keys, seq, start, end, borderline), 0 if it lies in none, null
    in a borderline one; the first segment by seq counts."""
    named = segments.select(*keys, "seq", "start", "end", F.coalesce("borderline", F.lit(False)).alias("_border"))
    found = I.containing(rows.withColumn("_middle", (F.col("start") + F.col("end")) / 2), named, keys, "_middle", ["idx"], "seq", "_border")
    return found.withColumn("label", F.when(F.col("_border").isNull(), 0).when(~F.col("_border"), 1)).drop("_middle", "_border")


def training_counts(rows: DataFrame, keys: I.Keys) -> DataFrame:
    """(rows, labelled, ads, content, episodes) of labelled feature rows."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("label").alias("labelled"),
        F.count_if(F.col("label") == 1).alias("ads"),
        F.count_if(F.col("label") == 0).alias("content"),
        F.count_distinct(F.struct(*keys)).alias("episodes"),
    )


def score_columns(names: list[str], weights: dict[str, float], bias: float) -> Column:
    """The logistic score of a dense feature row; a feature without a weight counts as nothing."""
    z = reduce(lambda a, n: a + F.col(n) * F.lit(float(weights[n])), [n for n in names if n in weights], F.lit(float(bias)))
    return S.sigmoid(z)
