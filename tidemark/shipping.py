"""Makes this package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def plain_unions(spark: SparkSession) -> None:
    """Unions in this session don't keep their sides' partitioning.

    Spark 4.1 joins the partitions of a union's sides one to one if both are dealt by the same keys; where a side turns out to be
    empty while the plan is adapted, it then fails with unequal numbers of partitions.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application.

    Functions that Spark sends to workers name this package, which need not be on the workers' path:
    they may run on other machines, or in another folder.
    """
    plain_unions(spark)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
        for at in sorted(Path(here).rglob("*.py")):
            package.write(at, at.relative_to(Path(here).parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
