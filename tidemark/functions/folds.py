"""Lists that folds over arrays build.

Appending to an array copies it, so a list that grows by one at each step costs the square of its length.  These lists are
kept as full pages and an open one: a step copies the open page, and the list of pages only when a page is full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 128


def paged(kind: str) -> Column:
    """An empty list of values of a type."""
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("open"))


def appended(pages: Column, value: Column) -> Column:
    """The list with one more value."""
    turn = F.size(pages["open"]) >= PAGE
    full = F.when(turn, F.concat(pages["full"], F.array(pages["open"]))).otherwise(pages["full"])
    return F.struct(full.alias("full"), F.when(turn, F.array(value)).otherwise(F.concat(pages["open"], F.array(value))).alias("open"))


def listed(pages: Column) -> Column:
    """The list as one array."""
    return F.concat(F.flatten(pages["full"]), pages["open"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and not at each place of its use."""
    return F.get(F.transform(F.array(value), use), 0)
