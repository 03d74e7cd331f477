"""Lifecycle states of episodes on a stream: each event of an episode as it comes, late and repeated ones too.

An event names the episode (keys), its version, stage and removal, and counters that are absolute: what was used in all so far.
The state of an episode is that of its newest version; once published it has been published, whatever comes after; a counter is
the greatest seen.  So the order of events and their repetition change nothing, and the last state is that of the batch query
`batch_states` over all events.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTERS = ("input", "output")


def batch_states(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, stage, removal, has_published, counters) of all events."""
    newest = F.max_by(F.struct("version", "stage", "removal"), "version")
    out = events.groupBy(*keys).agg(newest.alias("_s"), F.bool_or(F.col("stage") == "published").alias("has_published"), *[F.max(c).alias(c) for c in COUNTERS])
    return out.select(*keys, "_s.*", "has_published", *COUNTERS)


def states(events: DataFrame, keys: list[str]) -> DataFrame:
    """The stream of states (keys, version, stage, removal, has_published, counters) of the episodes that events came for."""
    return batch_states(events, keys)


def changes(after: DataFrame, before: DataFrame | None, keys: list[str]) -> DataFrame:
    """States that differ from those before, and what each counter grew by (<counter>_step; over all changes of an episode the
    steps add up to the counter)."""
    rest = [c for c in after.columns if c not in keys]
    if before is None:
        before = after.limit(0)
    held = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*rest).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    both = after.join(held, reduce(and_, same), "left").where(~F.struct(*rest).eqNullSafe(F.col("_before")))
    return both.select(*after.columns, *[(F.col(c) - F.coalesce(F.col("_before")[c], F.lit(0))).alias(f"{c}_step") for c in COUNTERS])


def follow(events: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Writes the changes of each micro-batch to path/epoch=<number>; a batch that is run again replaces what it wrote.

    The states before a batch are the last ones that earlier batches wrote to path.
    """

    def write(after: DataFrame, epoch: int) -> None:
        spark = after.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = epoch > 0 and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        before = _last(spark.read.parquet(path).where(F.col("epoch") < epoch), keys) if known else None
        changes(after, before, keys).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return states(events, keys).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    """The last state of each episode among the changes at path."""
    return _last(spark.read.parquet(path), keys)


def _last(changes: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in (*keys, "epoch") and not c.endswith("_step")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_s")).select(*keys, "_s.*")
