"""A catalogue of episodes by channel: newest N, retention, order, upsert, plans and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import Keys


def latest(df: DataFrame, keys: Keys, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each key, with their `rank`.  The limit is applied before the shuffle, too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def retention(df: DataFrame, keys: Keys, keep: int, published: str, order: list[Column]) -> DataFrame:
    """All rows with `action` keep or prune; `ambiguous` where the cut falls between rows of one instant without a time of day."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("_next", F.lead(published).over(w))
    edge = (F.col("rank") == keep) & (F.col(published) == F.col("_next")) & (F.date_trunc("day", published) == F.col(published))
    action = F.when(F.col("rank") <= keep, "keep").otherwise("prune")
    return ranked.withColumn("action", action).withColumn("ambiguous", F.coalesce(F.max(edge).over(Window.partitionBy(*keys)), F.lit(False))).drop("_next")


def ordered_items(items: DataFrame, keys: Keys, published: str = "published_at", listing: str = "listing", prior: str = "prior") -> DataFrame:
    """Items by `place` from 0: newest day first; in a day where an item lacks a time of day, listed items first in listing
    order, then the others as they were; else by time, newest first.

    Listed items of a timed day that are out of time order stand by time here; `ordered_items_exact` keeps the listing's order.
    """
    day = F.date_trunc("day", published)
    dateless = F.max(F.col(published) == day).over(Window.partitionBy(*keys, day))
    by_list = F.when(dateless, F.when(F.col(listing).isNotNull(), 0).otherwise(1)).otherwise(0)
    time = F.when(dateless, F.lit(0)).otherwise(-F.unix_micros(F.col(published).cast("timestamp")))
    position = F.when(F.col(listing).isNotNull(), F.col(listing)).otherwise(F.lit(2**31))
    held = items.withColumns({"_day": day, "_list": by_list, "_time": time, "_position": position})
    w = Window.partitionBy(*keys).orderBy(F.desc("_day"), "_list", "_time", "_position", prior)
    return held.withColumn("place", F.row_number().over(w) - 1).drop("_day", "_list", "_time", "_position")


def ordered_items_exact(items: DataFrame, keys: Keys, published: str = "published_at", listing: str = "listing", prior: str = "prior") -> DataFrame:
    """The same for listed items of a timed day whose times are out of order, too: they stand in listing order.

    A listed item counts as no newer than the listed ones of its day before it: it takes the least of their times and its own, and
    the greatest of the priors of those that take the same time.  With that, one order of columns serves all items of a key.
    """
    day = F.date_trunc("day", published)
    dateless = F.max(F.col(published) == day).over(Window.partitionBy(*keys, day))
    listed = F.col(listing).isNotNull()
    held = items.withColumns({"_day": day, "_listed": listed, "_at": F.unix_micros(F.col(published).cast("timestamp"))}).withColumn("_dateless", dateless)
    ahead = Window.partitionBy(*keys, "_day", "_listed").orderBy(listing, prior)
    time = F.when(F.col("_listed"), F.min("_at").over(ahead.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("_at"))
    held = held.withColumn("_time", F.when(F.col("_dateless"), F.lit(0)).otherwise(-time))
    equal = Window.partitionBy(*keys, "_day", "_listed", "_time").orderBy(listing, prior).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_prior", F.when(F.col("_listed"), F.max(prior).over(equal)).otherwise(F.col(prior)))
    group = F.when(F.col("_dateless") & ~F.col("_listed"), 1).otherwise(0)
    position = F.when(F.col("_dateless"), F.lit(0)).otherwise(F.col("_prior"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_day"), group, "_time", position, listing, prior)
    return held.withColumn("place", (F.row_number().over(w) - 1).cast("int")).drop("_day", "_listed", "_at", "_dateless", "_time", "_prior")


def retention_actions(items: DataFrame, states: DataFrame, candidates: DataFrame, limits: DataFrame, keys: Keys, ident: str) -> DataFrame:
    """What a retention run would do, without doing it: (keys, ident, place, action).

    items: (keys, ident, published_at, listing, prior), a feed; states: (keys, ident, removal, delete_pending, has_published, stage);
    candidates: like items, uploads that are not in the feed; limits: (keys, keep, purge).

    `finish`: a removal that was begun; `exclude`: an episode or item of a purged key; `prune`: a feed item beyond `keep`, items on
    their way out not counted; `admit` and `reject`: a candidate that would be within `keep` if it alone were added, or not;
    `keep`: a feed item that stays.  place is that in the feed without items on their way out; null without one.
    """
    on = [*keys, ident]
    known = states.select(*on, (F.col("removal") != "").alias("_leaving"), "delete_pending")
    both = items.withColumn("_new", F.lit(False)).unionByName(candidates.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    rows = both.join(known, on, "left").join(limits, keys).withColumn("_leaving", F.coalesce("_leaving", F.lit(False)))
    # a candidate is judged against the feed alone, so candidates do not push each other out
    placed = ordered_items_exact(rows.where(~F.col("_leaving")), keys)
    before = F.coalesce(F.sum((~F.col("_new")).cast("int")).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("place", before.cast("int"))
    within = F.col("place") < F.col("keep")
    action = F.when(F.col("purge"), F.when(F.col("_new"), "reject").otherwise("exclude")).when(F.col("_new"), F.when(within, "admit").otherwise("reject"))
    judged = placed.select(*on, "place", action.otherwise(F.when(within, "keep").otherwise("prune")).alias("action"))
    # begun removals and, of purged keys, episodes that only their state knows
    leaving = states.join(limits, keys).where(F.col("delete_pending") | F.col("purge"))
    rest = leaving.join(judged.select(*on), on, "left_anti")
    begun = rest.select(*on, F.lit(None).cast("int").alias("place"), F.when(F.col("delete_pending"), "finish").otherwise("exclude").alias("action"))
    return judged.unionByName(begun)


def planned(uploads: DataFrame, feed: DataFrame, states: DataFrame, channels: DataFrame, keys: Keys, ident: str) -> DataFrame:
    """A read-only plan: one row for each episode that uploads, feed or state know, of channels that are enabled.

    uploads: (keys, ident, listing, title, seconds, accessible); feed: (keys, ident, published_at, bytes); states: (keys, ident, stage, removal, has_published,
    publish_pending, delete_pending, last_error, seconds); channels: (keys, enabled, wanted, keep).  Result: keys, ident, title, seconds, bytes,
    selected (an accessible upload among the first `wanted`, in listing order), status and recovery.

    status: the removal that is under way or (beyond `keep` in the feed) would be, or existing, waiting, rendered, retry, new.
    recovery: a removal of the episode has to be finished first.
    """
    sides = {"uploads": uploads, "feed": feed, "state": states}
    rows = joined(sides, [*keys, ident]).join(channels.where("enabled"), keys)
    usable = Window.partitionBy(*keys).orderBy("uploads_listing", ident).rowsBetween(Window.unboundedPreceding, -1)
    offered = F.col("in_uploads") & F.col("uploads_accessible")
    rank = F.coalesce(F.sum(offered.cast("int")).over(usable), F.lit(0))
    # uploads come first in listing order, so that the others do not count
    rows = rows.withColumn("uploads_listing", F.coalesce("uploads_listing", F.lit(2**31))).withColumn("selected", offered & (rank < F.col("wanted")))
    removal = F.coalesce(F.nullif("state_removal", F.lit("")), F.lit(None).cast("string"))
    stays = F.col("in_feed") & removal.isNull()
    place = F.sum(stays.cast("int")).over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("feed_published_at"), ident).rowsBetween(Window.unboundedPreceding, 0))
    pruned = F.when(stays & (place > F.col("keep")), "pruned")
    done = F.coalesce("state_has_published", F.lit(False)) & ~F.coalesce("state_publish_pending", F.lit(False))
    status = (
        F.when(removal.isNotNull(), removal)
        .when(pruned.isNotNull(), pruned)
        .when(done, "existing")
        .when(F.col("state_stage") == "waiting", "waiting")
        .when(F.col("state_stage") == "rendered", "rendered")
        .when(F.coalesce("state_last_error", F.lit("")) != "", "retry")
        .otherwise("new")
    )
    seconds = F.when(F.coalesce("uploads_seconds", F.lit(0.0)) > 0, F.col("uploads_seconds")).otherwise(F.coalesce("state_seconds", F.lit(0.0)))
    return rows.select(
        *keys, ident, F.col("uploads_title").alias("title"), seconds.alias("seconds"), F.coalesce("feed_bytes", F.lit(0)).alias("bytes"), "selected",
        status.alias("status"), F.coalesce("state_delete_pending", F.lit(False)).alias("recovery"),
    )


def plan_totals(plan: DataFrame, keys: Keys) -> DataFrame:
    """(keys, to_do, unknown, todo_seconds, stored_bytes, recovery) of a plan: selected episodes that are new or to be tried again, those without
    a length, what the feed stores after it, and whether anything has to be finished first."""
    open_ = F.col("selected") & F.col("status").isin("new", "retry")
    return plan.groupBy(*keys).agg(
        F.count_if(open_).alias("to_do"),
        F.count_if(open_ & (F.col("seconds") <= 0)).alias("unknown"),
        F.coalesce(F.sum(F.when(open_, F.greatest("seconds", F.lit(0.0)))), F.lit(0.0)).alias("todo_seconds"),
        F.coalesce(F.sum(F.when(F.col("status").isin("pruned", "excluded"), 0).otherwise(F.col("bytes"))), F.lit(0)).alias("stored_bytes"),
        F.bool_or("recovery").alias("recovery"),
    )


def upsert(current: DataFrame, changes: DataFrame, keys: Keys, version: str) -> DataFrame:
    """The newest version of each key; on equal versions the change wins."""
    both = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_side"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def fits_retention(candidates: DataFrame, current: DataFrame, keys: Keys, keep: int, order: list[Column], ident: str) -> DataFrame:
    """Candidates with `fits`: would it be among the first `keep` of its key, added alone?  Counts the current rows ahead of it."""
    both = current.select(*keys, ident, *[c for c in current.columns if c not in (*keys, ident)], F.lit(False).alias("_new")).unionByName(
        candidates.select(*keys, ident, *[c for c in current.columns if c not in (*keys, ident)], F.lit(True).alias("_new"))
    )
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum((~F.col("_new")).cast("int")).over(w), F.lit(0))
    return both.withColumn("ahead", ahead).where("_new").select(*keys, ident, "ahead", (F.col("ahead") < keep).alias("fits"))


def plan_estimate(items: DataFrame, channels: DataFrame, keys: Keys, rates: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Totals of a read-only plan for each channel: waiting and stored items, seconds and bytes, and a range of tokens from the
    least and greatest tokens a second seen in the channel; null without a sample."""
    pending = F.col("stage") == "pending"
    known = F.col("seconds") > 0
    sample = (F.col("stage") == "published") & known & (F.col("tokens") > 0)
    rate = F.when(sample, F.col("tokens") / F.col("seconds"))
    sums = items.groupBy(*keys).agg(
        F.count_if(pending).alias("to_do"),
        F.count_if(pending & ~known).alias("unknown"),
        F.coalesce(F.sum(F.when(pending & known, F.col("seconds"))), F.lit(0.0)).alias("todo_seconds"),
        F.coalesce(F.sum(F.when(F.col("stage") == "published", F.col("bytes"))), F.lit(0)).alias("stored_bytes"),
        F.count_if(sample).alias("samples"),
        F.min(rate).alias("_lo"),
        F.max(rate).alias("_hi"),
    )
    out = channels.select(*keys).join(sums, keys, "left")
    return out.select(
        *keys,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("to_do", "unknown", "stored_bytes", "samples")],
        F.coalesce("todo_seconds", F.lit(0.0)).alias("todo_seconds"),
        (F.col("_lo") * rates[0] * F.col("todo_seconds")).alias("tokens_low"),
        (F.col("_hi") * rates[1] * F.col("todo_seconds")).alias("tokens_high"),
    )


def status_counts(episodes: DataFrame, keys: Keys) -> DataFrame:
    count = lambda s: F.count_if(F.col("stage") == s).alias(s)
    return episodes.groupBy(*keys).agg(*[count(s) for s in ("published", "rendered", "waiting", "pending")], F.count_if("removing").alias("removing"), F.count_if("failed").alias("failed"))


def latest_state(events: DataFrame, keys: Keys, version: str) -> DataFrame:
    """The newest event of each key, with `has_published` as soon as any was published."""
    rest = [c for c in events.columns if c not in keys]
    out = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_s"), F.bool_or(F.col("stage") == "published").alias("has_published"))
    return out.select(*keys, "_s.*", "has_published")


def joined(sides: dict[str, DataFrame], keys: Keys) -> DataFrame:
    """Full outer join of several tables by their keys: in_<side> for each, and all other columns as <side>_<column> (null where
    a side lacks the key).  Each side has a key once; one shuffle serves all sides."""
    rows = None
    for name, df in sides.items():
        part = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys], *[F.lit(n == name).alias(f"in_{n}") for n in sides])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    flags = [f"in_{n}" for n in sides]
    rest = [c for c in rows.columns if c not in (*keys, *flags)]
    return rows.groupBy(*keys).agg(*[F.bool_or(c).alias(c) for c in flags], *[F.max(c).alias(c) for c in rest])


def live(revisions: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """revisions with `live`: whether anything used names their key."""
    named = used.select(F.col(key).alias("_used")).distinct()
    return revisions.join(named, revisions[key] == named["_used"], "left").withColumn("live", F.col("_used").isNotNull()).drop("_used")


def ready(episodes: DataFrame) -> DataFrame:
    """Rendered episodes that wait only for their publication."""
    return episodes.where((F.col("stage") == "rendered") & F.col("publish_pending") & ~F.col("delete_pending") & (F.col("removal") == ""))


def subscriptions(channels: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Enabled channels that have published anything."""
    return channels.where("enabled").join(published.select(key).distinct(), key, "left_semi")
