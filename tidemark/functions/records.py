"""Dates, states and titles of catalogue records, and texts that need exact rules."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Why an upload can't be used yet, by its availability or live state.
UNAVAILABLE = (("subscriber_only", "members-only"), ("premium_only", "premium-only"), ("private", "private"), ("needs_auth", "sign-in required"))
LIVE = (("is_upcoming", "upcoming"), ("is_live", "live now"))


@F.pandas_udf(DoubleType())
def milliseconds_exact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Rounded to milliseconds by the value's binary expansion, as C's %.3f does; round() goes by decimals, halves up."""
    for part in parts:
        yield part.map(lambda v: float(f"{v:.3f}"), na_action="ignore").astype("float64")


@F.pandas_udf(StringType())
def unescaped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities decoded."""
    for part in parts:
        yield part.map(html.unescape, na_action="ignore")


def excerpt(text: Column, limit: int = 1200) -> Column:
    """Trimmed, and cut after `limit` bytes with dots; a character that the cut would split goes."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    bytes_ = F.substring(t.cast("binary"), 1, limit)
    head = F.regexp_replace(F.make_valid_utf8(bytes_.cast("string")), "\uFFFD+$", "")
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(head, F.lit("...")))


def title_key(title: Column) -> Column:
    """Titles that differ by blanks and case only have one key."""
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


def is_title(title: Column) -> Column:
    """Not blank, and no made-up chapter name."""
    return (F.trim(title) != "") & ~title.rlike(r"(?i)^\s*<untitled chapter \d+>\s*$")


def source_date(timestamp: Column, upload_date: Column) -> Column:
    """The instant in unix seconds, else the day YYYYMMDD at midnight, else null."""
    return F.when(timestamp > 0, F.timestamp_seconds(timestamp)).otherwise(F.try_to_timestamp(upload_date, F.lit("yyyyMMdd")))


def publication_date(timestamp: Column, upload_date: Column, previous: Column) -> Column:
    """source_date, but a known time of the same day is kept where only the day is given; without a date the previous one."""
    date = source_date(timestamp, upload_date)
    same_day = (F.coalesce(timestamp, F.lit(0)) <= 0) & (F.date_trunc("day", date) == F.date_trunc("day", previous))
    return F.when(date.isNull() | F.coalesce(same_day, F.lit(False)), previous).otherwise(date)


def day_only(date: Column) -> Column:
    return F.date_trunc("day", date) == date


def unavailable(availability: Column, live_status: Column) -> Column:
    """Why a video can't be processed yet; null if nothing is known against it."""
    out = F.lit(None).cast("string")
    for state, reason in reversed(LIVE):
        out = F.when(live_status == state, reason).otherwise(out)
    for state, reason in reversed(UNAVAILABLE):
        out = F.when(availability == state, reason).otherwise(out)
    return out


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9_-]+$")


def retryable(status: Column) -> Column:
    """Whether a request that ended so is worth another try: no answer, timeout, too many, or a server's fault."""
    return status.isin(0, 408, 429) | (status >= 500)


def outcome(error: Column, skipped: Column, published: Column, rendered: Column) -> Column:
    """The first that holds: failed, skipped, published, rendered, else waiting."""
    return F.when(error.isNotNull(), "failed").when(skipped, "skipped").when(published, "published").when(rendered, "rendered").otherwise("waiting")


#: What a refusal's message holds, in lower case, and the reason it stands for; the first that fits counts.
REFUSALS = (
    ("members-only", "members-only"),
    ("available to this channel's members", "members-only"),
    ("private video", "private"),
    ("premieres in", "upcoming"),
    ("this live event will begin", "upcoming"),
)


def refusal(message: Column) -> Column:
    """The reason that a message gives for a video that can't be had; null for messages of passing failures."""
    low = F.lower(message)
    out = F.lit(None).cast("string")
    for text, reason in reversed(REFUSALS):
        out = F.when(F.contains(low, F.lit(text)), reason).otherwise(out)
    return out


def backoff(attempt: Column, first: float = 0.5, jitter: Column | float = 0.0) -> Column:
    """Seconds to wait after the attempt (from 0): twice as long each time, and the jitter's share more."""
    return F.lit(first) * F.pow(F.lit(2.0), attempt) * (F.lit(1.0) + (jitter if isinstance(jitter, Column) else F.lit(float(jitter))))
