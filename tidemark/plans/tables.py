"""The test tables read as intervals, scored windows, cues and catalogue rows, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Length of an episode of the events table: 30 days.
DURATION = 30 * 86400.0
THRESHOLD = 0.35
GAP = 21600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of their user: seconds since 2024-01-01, a minute for each unit of value."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    prob = F.least(F.lit(1.0), F.col("value") / 250)
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", start.alias("start"), (start + F.col("value") * 60).alias("end"), F.col("event_type").alias("rule"), F.lit("events").alias("source"), prob.alias("confidence"), prob.alias("prob")
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored windows, idx by time."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    return segments(spark, sf_dir).withColumn("idx", F.row_number().over(w) - 1)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().withColumn("duration", F.lit(DURATION))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as cues, 15 characters a second."""
    from pyspark.sql.window import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) / 15.0
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), start.alias("start"), (start + F.length("text") / 15.0).alias("end"), "text")


SEG = """seg AS (
  SELECT user_id, event_id, (epoch_us(ts) - 1704067200000000) / 1000000.0 AS "start",
         (epoch_us(ts) - 1704067200000000) / 1000000.0 + value * 60 AS "end", event_type AS rule, 'events' AS source,
         least(1.0, value / 250) AS confidence, least(1.0, value / 250) AS prob FROM events)"""
SCORED = SEG + """, scored AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "start", event_id) - 1 AS idx FROM seg)"""
CUES = """cues AS (
  SELECT conv_id, turn AS seq, text,
         coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15e0 AS "start",
         coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15e0 + length(text) / 15e0 AS "end"
  FROM conversations)"""


def merged_sql(source: str, gap: float, name: str, extra: str = "", where: str = "TRUE") -> str:
    """CTEs that fuse chains of `source`'s intervals by user."""
    return f"""{name}_m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE {where}),
{name}_g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}_m),
{name} AS (SELECT user_id, min("start") AS "start", max("end") AS "end"{extra} FROM {name}_g GROUP BY user_id, g)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
