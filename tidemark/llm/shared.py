"""What the operators share on the Spark side: tables, checkpoints, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settling import discard, settle, shared_folder
from ..shipping import ship

__all__ = ["bounded_broadcast", "discard", "each_batch", "free_name", "give_back", "settle", "shared_folder", "small_batches", "table"]

#: Rows and bytes of texts in one Arrow batch; a longer text is a batch alone.
TEXT_BATCH, TEXT_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so the session's Arrow batches get smaller, by rows and by bytes (smaller ones that are set
    stay).  The package goes to the workers."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", TEXT_BATCH), ("maxBytesPerBatch", TEXT_BYTES)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}", str(most))
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores before it until no column of df has that name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is (then Spark shuffles)."""
    return F.broadcast(df) if rows <= limit else df


def each_batch(work: Callable, schema: str, df: DataFrame) -> DataFrame:
    """df.mapInArrow of a function of one record batch that yields record batches."""

    def run(batches):
        for batch in batches:
            yield from work(batch)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that the worker has freed goes back to the machine: workers wait for their next task beside the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
