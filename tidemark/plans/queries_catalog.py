"""Queries of the catalogue, the usage ledger, chapters, evidence, fits, sinks and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog as K
from ..operators import chapters as H
from ..operators import evidence as V
from ..operators import usage as U
from ..settling import shared_folder
from ..sources import sinks
from ..streaming import states
from ..streaming.sessions import sessions
from . import detect, fitting
from .queries_curves import _change
from .queries_intervals import _BRIDGE, _CLUSTERS, _clamped, _keeps
from .tables import CUES, SCORED, cues, merged_sql, rounded, scored, segments, table



def _newest():
    return [F.desc("published_at"), F.asc("video_id")]


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "pending").otherwise("waiting")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("video_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.floor("o_totalprice").cast("long").alias("bytes"), stage.alias("stage"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
    )


def cat_latest_n(spark, sf_dir):
    return K.latest(_episodes(spark, sf_dir), ["channel"], 3, _newest()).select("channel", "video_id", "rank")


def cat_keep_k(spark, sf_dir):
    return K.retention(_episodes(spark, sf_dir), ["channel"], 5, "published_at", _newest()).select("channel", "video_id", "action", "ambiguous")


def _items(spark, sf_dir):
    """Events of a user as feed items; every third day lacks times of day, and every other item is listed."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", ts)
    at = F.when(F.dayofmonth(ts) % 3 == 0, day).otherwise(ts)
    listing = F.when((F.dayofmonth(ts) % 3 == 0) & (F.col("event_id") % 2 == 0), (F.col("event_id") * 7919) % 10007)
    return e.select("user_id", "event_id", at.alias("published_at"), listing.alias("listing"), F.col("event_id").alias("prior"))


def cat_order_items(spark, sf_dir):
    return K.ordered_items(_items(spark, sf_dir), ["user_id"]).select("user_id", "event_id", F.col("place").cast("int").alias("place"))


def cat_order_items_exact(spark, sf_dir):
    return K.ordered_items_exact(_items(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "place")


def cat_fits_retention(spark, sf_dir):
    e, columns = _episodes(spark, sf_dir), ["channel", "video_id", "published_at"]
    new, held = e.where("priority = '1-URGENT'").select(columns), e.where("priority <> '1-URGENT'").select(columns)
    return K.fits_retention(new, held, ["channel"], 4, _newest(), "video_id")


def cat_upsert(spark, sf_dir):
    e = _episodes(spark, sf_dir).select("channel", F.col("published_at").alias("version"), F.col("video_id").alias("value"), "stage")
    order = [F.desc("version"), F.desc("value")]
    current = K.latest(e.where("stage = 'published'"), ["channel"], 1, order).drop("rank", "stage")
    changes = K.latest(e.where("stage <> 'published'"), ["channel"], 1, order).drop("rank", "stage")
    return K.upsert(current, changes, ["channel"], "version").select("channel", "value")


def cat_plan_estimate(spark, sf_dir):
    e = _episodes(spark, sf_dir).withColumns({"seconds": F.when(F.col("video_id") % 7 == 0, 0.0).otherwise(F.col("price") / 100), "tokens": (F.col("video_id") % 1000).cast("double")})
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"))
    return rounded(K.plan_estimate(e, channels, ["channel"]), "todo_seconds", "tokens_low", "tokens_high", digits=2)


def _plan_sides(spark, sf_dir):
    """Orders as uploads (dear ones), feed items (done ones) and states; some with a removal, by price and priority."""
    e = _episodes(spark, sf_dir)
    by_price = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("price"), "video_id"))
    uploads = e.where("price > 60000").select("channel", "video_id", by_price.alias("listing"), F.col("priority").alias("title"), (F.col("bytes") % 4000).cast("double").alias("seconds"), (F.col("priority") != "3-MEDIUM").alias("accessible"))
    feed = e.where("stage = 'published'").select("channel", "video_id", "published_at", "bytes")
    removal = F.when(F.col("priority") == "5-LOW", "excluded").otherwise("")
    states = e.where("priority > '1-URGENT' or stage = 'pending'").select(
        "channel", "video_id", "stage", removal.alias("removal"), (F.col("stage") == "published").alias("has_published"), (F.col("priority") == "2-HIGH").alias("publish_pending"),
        ((F.col("priority") == "5-LOW") & (F.col("stage") == "waiting")).alias("delete_pending"), F.when(F.col("bytes") % 3 == 0, "failed").alias("last_error"), F.lit(60.0).alias("seconds"),
    )
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), (F.col("c_acctbal") > 0).alias("enabled"), F.lit(5).alias("wanted"), F.lit(3).alias("keep"), (F.col("c_acctbal") > 9000).alias("purge"))
    return uploads, feed, states, channels


def cat_plan(spark, sf_dir):
    return K.planned(*_plan_sides(spark, sf_dir), ["channel"], "video_id")


def cat_plan_totals(spark, sf_dir):
    return K.plan_totals(cat_plan(spark, sf_dir), ["channel"])


def cat_retention_actions(spark, sf_dir):
    uploads, feed, states, channels = _plan_sides(spark, sf_dir)
    dates = _episodes(spark, sf_dir).select("channel", "video_id", "published_at", F.col("video_id").alias("prior"))
    listed = dates.join(uploads.select("channel", "video_id", "listing"), ["channel", "video_id"], "left")
    items = listed.join(feed.select("channel", "video_id"), ["channel", "video_id"], "left_semi")
    candidates = listed.where("listing is not null").join(feed.select("channel", "video_id"), ["channel", "video_id"], "left_anti")
    return K.retention_actions(items, states, candidates, channels.select("channel", "keep", "purge"), ["channel"], "video_id")


def stream_latest_state(spark, sf_dir):
    """Orders as a stream of events of their customers: the last states after all of it."""
    known = table(spark, sf_dir, "orders")
    run = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    price = F.floor("o_totalprice").cast("long")
    # a pattern, as a stream of files takes no single file
    events = spark.readStream.schema(known.schema).parquet(f"{sf_dir}/order[s].parquet").select(
        F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("pending").alias("stage"),
        F.when(F.col("o_orderpriority") == "5-LOW", "excluded").otherwise("").alias("removal"), price.alias("input"), (price % 1000).alias("output"),
    )
    states.follow(events, ["channel"], f"{run}/out", f"{run}/log").awaitTermination()
    return states.current(spark, ["channel"], f"{run}/out")


def cat_status_counts(spark, sf_dir):
    e = _episodes(spark, sf_dir).withColumns({"removing": F.col("priority") == "1-URGENT", "failed": F.col("bytes") % 11 == 0})
    return K.status_counts(e, ["channel"])


def cat_latest_state(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    return K.latest_state(e.select("channel", "video_id", "stage"), ["channel"], "video_id").select("channel", "video_id", "stage", "has_published")


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("channel"), F.col("l_orderkey").alias("attempt"), F.col("l_quantity").cast("long").alias("input"), F.col("l_linenumber").cast("long").alias("output"),
        F.col("l_returnflag").alias("rate"), (F.col("l_linestatus") == "O").alias("missing_usage"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("reported_cost"),
    )


def _rates(spark):
    return spark.createDataFrame([("A", 42000.0, 0.0), ("R", 150000.0, 600000.0)], "rate string, input_price double, output_price double")


def usage_observe(spark, sf_dir):
    return rounded(U.observe(_calls(spark, sf_dir), _rates(spark), ["channel"]), "cost", digits=3)


def usage_interval(spark, sf_dir):
    c = _calls(spark, sf_dir)
    now, then = U.observe(c, _rates(spark), ["channel"]), U.observe(c.where("input <= 25"), _rates(spark), ["channel"])
    return rounded(U.interval(now, then, ["channel"]), "cost", digits=3)


def usage_rollup(spark, sf_dir):
    return rounded(U.rollup(U.observe(_calls(spark, sf_dir), _rates(spark), ["channel"]), ["channel", "rate"]), "cost", digits=2)


def usage_deltas(spark, sf_dir):
    from pyspark.sql.window import Window

    c = _calls(spark, sf_dir).groupBy("channel", "attempt").agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
    w = Window.partitionBy("channel").orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = c.select("channel", "attempt", F.sum("input").over(w).alias("input"), F.sum("output").over(w).alias("output"))
    return U.deltas(totals, ["channel"], "attempt", ["input", "output"])


def _chapter_inputs(spark, sf_dir):
    """Turns of a conversation as chapters; what long turns cover, moved by some seconds, is cut."""
    c = cues(spark, sf_dir)
    chapters = c.select("conv_id", "seq", F.round("start", 3).alias("start"), F.lit(None).cast("double").alias("end"), F.concat(F.lit("turn "), F.col("seq")).alias("title"))
    eps = c.groupBy("conv_id").agg(F.round(F.max("end"), 3).alias("source_duration"))
    from ..operators.intervals import keep_ranges

    cuts = c.where("length(text) > 200").select("conv_id", F.round(F.col("start") + 2, 3).alias("start"), F.round(F.col("end") + 3, 3).alias("end"))
    keeps = keep_ranges(cuts, eps.withColumnRenamed("source_duration", "duration"), ["conv_id"], 1.0)
    return chapters, keeps, eps.withColumn("duration", F.col("source_duration"))


def chap_timeline(spark, sf_dir):
    _, keeps, _ = _chapter_inputs(spark, sf_dir)
    return rounded(H.timeline(keeps, ["conv_id"], 0.05).select("conv_id", F.col("n").cast("int").alias("n"), "start", "end", "offset"), "start", "end", "offset", digits=3)


def chap_derive(spark, sf_dir):
    chapters, keeps, eps = _chapter_inputs(spark, sf_dir)
    return rounded(H.derive(chapters, keeps, eps, ["conv_id"]), "start", digits=3)


def ev_replay_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = V.key(F.lit("ask"), F.col("user_id").cast("string"), F.array(F.col("event_type"), F.lit("q")))
    asked = e.where("value < 20").select("event_id", key.alias("key"))
    recorded = e.where("value >= 20").select("event_id", key.alias("key"), F.col("value").alias("answer"))
    return V.replayed(asked, recorded, ["key"], "event_id", "answer")


def ev_same_decisions(spark, sf_dir):
    a = segments(spark, sf_dir).select("user_id", "rule", F.round("start", 3).alias("start"))
    b = a.where("rule <> 'error'")
    return V.differing(a, b, ["rule", "start"], ["user_id"])


def ev_incomplete(spark, sf_dir):
    return V.incomplete(ev_replay_join(spark, sf_dir), ["key"])


def fit_logistic(spark, sf_dir):
    """Toxic labels from plain text features: the fitted probability of each labelled document."""
    d = table(spark, sf_dir, "documents")
    f = d.select("doc_id", (F.length("text") / 10000).alias("f_len"), (F.size(F.split("text", r"\s+")) / 1000).alias("f_words"), F.contains(F.lower("text"), F.lit("idiot")).cast("double").alias("f_a"), F.contains(F.lower("text"), F.lit("trash")).cast("double").alias("f_b"))
    rows = f.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    names = ["f_a", "f_b", "f_len", "f_words"]
    return rounded(fitting.predicted(fitting.fit(rows, names, "toxic", 1.0, 3.0), rows, names).select("doc_id", "toxic", "p"), "p", digits=4)


def detect_plan(spark, sf_dir):
    """Cuts of the scan alone over scored windows: strong runs, bridged, and weak leads, long ones fused."""
    return rounded(detect.cuts(scored(spark, sf_dir), segments(spark, sf_dir).select("user_id").distinct().withColumn("duration", F.lit(30 * 86400.0)), ["user_id"], detect.EVENTS), "start", "end", "confidence")


def _detection(spark, sf_dir):
    """Anchors of the events, and a user's events around each as points of its start and end curves."""
    s = segments(spark, sf_dir)
    named = detect.numbered(detect.anchors(scored(spark, sf_dir), ["user_id"], detect.EVENTS), ["user_id"])
    a = named.select("user_id", "anchor", F.col("start").alias("a0"), F.col("end").alias("a1"))
    at = s.select("user_id", "event_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.round("prob", 6).alias("p"), F.when(F.col("user_id") % 2 == 0, F.round("prob", 6)).alias("ad"))

    def points(near):
        from pyspark.sql.window import Window

        w = Window.partitionBy("user_id", "anchor").orderBy("p_start", "event_id")
        return at.join(a, "user_id").where(near).withColumn("idx", F.row_number().over(w) - 1).drop("a0", "a1", "event_id")

    start = points((F.col("p_start") >= F.col("a0") - 172800) & (F.col("p_start") < F.col("a1")))
    end = points((F.col("p_start") >= F.col("a1") - 43200) & (F.col("p_start") < F.col("a1") + 172800))
    inside = points((F.col("p_start") >= F.col("a0")) & (F.col("p_start") < F.col("a1"))).select("user_id", "anchor", F.col("p_start").alias("start"), F.when(F.col("ad").isNotNull(), F.col("p")).otherwise(F.col("p") / 2).alias("p"))
    return named, start, end, inside


_ANCHOR = ["user_id", "anchor"]


def detect_starts(spark, sf_dir):
    named, start, _, inside = _detection(spark, sf_dir)
    return rounded(detect.bound_starts(named, start, inside, _ANCHOR, detect.EVENTS), "new_start")


def detect_ends(spark, sf_dir):
    named, _, end, _ = _detection(spark, sf_dir)
    return rounded(detect.bound_ends(named, end, _ANCHOR, detect.EVENTS), "new_end")


def detect_regions(spark, sf_dir):
    """The whole run from scored windows to padded cuts and what they leave, each user's first half of anchors as outros."""
    named, start, end, inside = _detection(spark, sf_dir)
    eps = segments(spark, sf_dir).select("user_id").distinct().withColumn("duration", F.lit(30 * 86400.0))
    found = detect.bounded(named, start, end, inside, named.select(*_ANCHOR, (F.col("anchor") % 2 == 0).alias("outro")), _ANCHOR, detect.EVENTS)
    done, kept = detect.edited(found.drop("anchor"), eps, ["user_id"], detect.EVENTS)
    return rounded(done.select("user_id", F.lit("cut").alias("kind"), "start", "end").unionByName(kept.select("user_id", F.lit("keep").alias("kind"), "start", "end")), "start", "end")


def stream_session_neighbour(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions(e, "user_id", "ts", "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def sink_feed(spark, sf_dir):
    items = K.latest(_episodes(spark, sf_dir), ["channel"], 3, _newest()).select("channel", F.col("rank").alias("place"), F.col("video_id").cast("string").alias("guid"), F.col("priority").alias("title"), "published_at", F.concat(F.lit("https://example.org/a?b&c="), F.col("video_id")).alias("url"), "bytes", (F.col("bytes") / 100).alias("seconds"))
    feeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.col("c_name").alias("title"), F.lit("https://example.org/").alias("link"), F.col("c_mktsegment").alias("description"))
    return sinks.feed_xml(feeds, items, "channel").select("channel", F.md5("xml").alias("digest"))


def sink_changed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    written = d.where("lang <> 'fr'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", "").otherwise(F.col("text")), 256).alias("sha256"))
    return sinks.changed(d, written, "doc_id", "text").select("doc_id", "sha256")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("cat_", "usage_", "chap_", "ev_", "fit_", "stream_", "sink_", "detect_")) and callable(f)}

_EP = """ep AS (SELECT o_custkey AS channel, o_orderkey AS video_id, o_orderdate AS published_at, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderpriority AS priority, o_totalprice AS price,
  CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'pending' ELSE 'waiting' END AS stage FROM orders)"""
_N = "row_number() OVER (PARTITION BY channel ORDER BY published_at DESC, video_id)"
_ITEMS = """items AS (SELECT user_id, event_id, CASE WHEN day(ts) % 3 = 0 THEN date_trunc('day', ts) ELSE ts END AS p, CASE WHEN day(ts) % 3 = 0 AND event_id % 2 = 0 THEN (event_id * 7919) % 10007 END AS l FROM events),
d AS (SELECT *, date_trunc('day', p) AS dd, max(CASE WHEN p = date_trunc('day', p) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date_trunc('day', p)) AS dateless FROM items)"""
_ORDER = """SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY dd DESC, CASE WHEN dateless = 1 AND l IS NULL THEN 1 ELSE 0 END, CASE WHEN dateless = 1 THEN 0 ELSE -epoch_us(p) END, coalesce(l, 2147483648), event_id) - 1 AS INTEGER) AS place FROM d"""
_CALLS = """calls AS (SELECT l_orderkey % 50 AS channel, l_orderkey AS attempt, CAST(l_quantity AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS o, l_returnflag AS rate, l_linestatus = 'O' AS miss, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END AS rep FROM lineitem),
prices AS (SELECT * FROM (VALUES ('A', 42000e0, 0e0), ('R', 150000e0, 600000e0)) t(rate, ip, op))"""


def _observed(where: str = "TRUE") -> str:
    return f"""(SELECT channel, rate, count(*) AS calls, CAST(coalesce(sum(i) FILTER (WHERE NOT miss), 0) AS BIGINT) AS input, CAST(coalesce(sum(o) FILTER (WHERE NOT miss), 0) AS BIGINT) AS output, count(*) FILTER (WHERE miss) AS missing,
count(*) FILTER (WHERE NOT miss AND ip IS NULL) AS unpriced, count(rep) AS reported, coalesce(sum((i * ip + o * op) / 1e6) FILTER (WHERE NOT miss AND ip IS NOT NULL), 0) AS cost FROM calls LEFT JOIN prices USING (rate) WHERE {where} GROUP BY channel, rate)"""


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in U.COUNTERS[:-1])
_KEEPS = CUES + """, eps AS (SELECT conv_id, round(max("end"), 3) AS d FROM cues GROUP BY conv_id),
cut0 AS (SELECT c.conv_id, greatest(0e0, least(round("start" + 2, 3), d)) AS "start", greatest(0e0, least(round("end" + 3, 3), d)) AS "end" FROM cues c JOIN eps USING (conv_id) WHERE length(text) > 200),
cut AS (SELECT * FROM cut0 WHERE "end" - "start" > 0.05),
cm AS (SELECT *, max("end") OVER (PARTITION BY conv_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cut),
cg AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM cm),
mk AS (SELECT conv_id, min("start") AS s, max("end") AS e FROM cg GROUP BY conv_id, g UNION ALL SELECT conv_id, d, d FROM eps),
kp AS (SELECT conv_id, round(f, 3) AS "start", round(s, 3) AS "end" FROM (SELECT conv_id, s, lag(e, 1, 0e0) OVER (PARTITION BY conv_id ORDER BY s, e) AS f FROM mk) t WHERE s - f >= 1 AND s > f),
tl AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(sum("end" - "start") OVER (PARTITION BY conv_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (row_number() OVER w - 1) * 0.05e0 AS off FROM kp WINDOW w AS (PARTITION BY conv_id ORDER BY "start"))"""
_KEY = "sha256(concat_ws(chr(1), 'ask', CAST(user_id AS VARCHAR), array_to_string(list_sort([event_type, 'q']), chr(2))))"
_REPLAY = f"""ev AS (SELECT event_id, value, {_KEY} AS key FROM events), a AS (SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY event_id) AS k FROM ev WHERE value < 20),
r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY event_id) AS k FROM ev WHERE value >= 20), rp AS (SELECT a.key, a.event_id, r.value AS answer, r.key IS NOT NULL AS found FROM a LEFT JOIN r ON r.key = a.key AND r.k = a.k)"""

ORACLES = {
    "cat_latest_n": f"WITH {_EP} SELECT * FROM (SELECT channel, video_id, CAST({_N} AS INTEGER) AS rank FROM ep) t WHERE rank <= 3",
    "cat_keep_k": f"""WITH {_EP}, r AS (SELECT *, {_N} AS n, lead(published_at) OVER (PARTITION BY channel ORDER BY published_at DESC, video_id) AS nx FROM ep)
SELECT channel, video_id, CASE WHEN n <= 5 THEN 'keep' ELSE 'prune' END AS action, coalesce(bool_or(n = 5 AND published_at = nx AND published_at = date_trunc('day', published_at)) OVER (PARTITION BY channel), false) AS ambiguous FROM r""",
    "cat_order_items": f"WITH {_ITEMS} {_ORDER}",
    "cat_order_items_exact": f"WITH {_ITEMS} {_ORDER}",
    "cat_fits_retention": f"""WITH {_EP}, b AS (SELECT *, priority = '1-URGENT' AS new FROM ep), c AS (SELECT *, coalesce(sum(CASE WHEN new THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY published_at DESC, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM b)
SELECT channel, video_id, CAST(a AS BIGINT) AS ahead, a < 4 AS fits FROM c WHERE new""",
    "cat_upsert": f"""WITH {_EP}, l AS (SELECT channel, video_id, published_at, stage <> 'published' AS side, row_number() OVER (PARTITION BY channel, stage <> 'published' ORDER BY published_at DESC, video_id DESC) AS n FROM ep)
SELECT channel, video_id AS value FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY published_at DESC, side DESC) AS m FROM l WHERE n = 1) t WHERE m = 1""",
    "cat_plan_estimate": f"""WITH {_EP}, e AS (SELECT *, CASE WHEN video_id % 7 = 0 THEN 0 ELSE price / 100 END AS s, CAST(video_id % 1000 AS DOUBLE) AS t FROM ep),
a AS (SELECT channel, count(*) FILTER (WHERE stage = 'pending') AS to_do, count(*) FILTER (WHERE stage = 'pending' AND s <= 0) AS unknown, coalesce(sum(s) FILTER (WHERE stage = 'pending' AND s > 0), 0) AS ts, coalesce(sum(bytes) FILTER (WHERE stage = 'published'), 0) AS sb,
 count(*) FILTER (WHERE stage = 'published' AND s > 0 AND t > 0) AS samples, min(t / s) FILTER (WHERE stage = 'published' AND s > 0 AND t > 0) AS lo, max(t / s) FILTER (WHERE stage = 'published' AND s > 0 AND t > 0) AS hi FROM e GROUP BY channel)
SELECT c_custkey AS channel, coalesce(to_do, 0) AS to_do, coalesce(unknown, 0) AS unknown, CAST(coalesce(sb, 0) AS BIGINT) AS stored_bytes, coalesce(samples, 0) AS samples, round(coalesce(ts, 0), 2) AS todo_seconds, round(lo * 0.5 * ts, 2) AS tokens_low, round(hi * 2 * ts, 2) AS tokens_high FROM customer LEFT JOIN a ON a.channel = c_custkey""",
    "cat_status_counts": f"""WITH {_EP} SELECT channel, count(*) FILTER (WHERE stage = 'published') AS published, count(*) FILTER (WHERE stage = 'rendered') AS rendered, count(*) FILTER (WHERE stage = 'waiting') AS waiting, count(*) FILTER (WHERE stage = 'pending') AS pending,
count(*) FILTER (WHERE priority = '1-URGENT') AS removing, count(*) FILTER (WHERE bytes % 11 = 0) AS failed FROM ep GROUP BY channel""",
    "cat_latest_state": f"WITH {_EP} SELECT channel, max(video_id) AS video_id, arg_max(stage, video_id) AS stage, bool_or(stage = 'published') AS has_published FROM ep GROUP BY channel",
    "usage_observe": f"WITH {_CALLS} SELECT channel, rate, calls, input, output, missing, unpriced, reported, round(cost, 3) AS cost FROM {_observed()} t",
    "usage_interval": f"""WITH {_CALLS}, n AS {_observed()}, o AS {_observed("i <= 25")}, b AS (SELECT *, 1 AS s FROM n UNION ALL SELECT *, -1 FROM o)
SELECT channel, rate, {", ".join(f"CAST(sum(s * {c}) AS BIGINT) AS {c}" for c in U.COUNTERS[:-1])}, round(coalesce(sum(cost) FILTER (WHERE s = 1), 0) - coalesce(sum(cost) FILTER (WHERE s = -1), 0), 3) AS cost FROM b GROUP BY channel, rate HAVING sum(s * calls) <> 0""",
    "usage_rollup": f"WITH {_CALLS}, n AS {_observed()} SELECT channel, rate, {_SUMS}, round(sum(cost), 2) AS cost, CAST(grouping(channel) * 2 + grouping(rate) AS INTEGER) AS level FROM n GROUP BY ROLLUP (channel, rate)",
    "usage_deltas": f"WITH {_CALLS} SELECT channel, attempt, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output FROM calls GROUP BY channel, attempt",
    "chap_timeline": f'WITH {_KEEPS} SELECT conv_id, CAST(n AS INTEGER) AS n, round("start", 3) AS "start", round("end", 3) AS "end", round(off, 3) AS "offset" FROM tl',
    "chap_derive": f"""WITH {_KEEPS}, ch AS (SELECT conv_id, seq, round("start", 3) AS s, 'turn ' || seq AS title FROM cues),
c2 AS (SELECT ch.*, d, least(d, coalesce((SELECT min(x.s) FROM ch x WHERE x.conv_id = ch.conv_id AND x.s > ch.s), d)) AS e FROM ch JOIN eps USING (conv_id) WHERE s < d),
m AS (SELECT c2.conv_id, c2.seq, c2.s, title, d, arg_min(round(greatest(0, off + greatest(t."start", c2.s) - t."start"), 3), t.n) AS at_ FROM c2 JOIN tl t ON t.conv_id = c2.conv_id AND greatest(t."start", c2.s) < least(t."end", c2.e) GROUP BY ALL)
SELECT conv_id, at_ AS "start", title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, at_ ORDER BY s, seq) AS k FROM m WHERE at_ < d) t WHERE k = 1""",
    "ev_replay_join": f"WITH {_REPLAY} SELECT key, event_id, answer, found FROM rp",
    "ev_incomplete": f"WITH {_REPLAY} SELECT key, count(*) FILTER (WHERE NOT found) AS unanswered FROM rp GROUP BY key HAVING count(*) FILTER (WHERE NOT found) > 0",
    "ev_same_decisions": f"WITH {SCORED} SELECT user_id, count(*) AS only_left, CAST(0 AS BIGINT) AS only_right FROM seg WHERE rule = 'error' GROUP BY user_id",
    "stream_session_neighbour": """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM g GROUP BY user_id, g""",
    "sink_feed": f"""WITH {_EP}, t AS (SELECT *, {_N} AS n FROM ep), x AS (SELECT channel, string_agg('<item><title>' || priority || '</title><guid>' || video_id || '</guid><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate><enclosure url="https://example.org/a?b&amp;c=' || video_id || '" length="' || bytes || '" type="audio/x-m4a"/><itunes:duration>' ||
 format('{{:d}}:{{:02d}}:{{:02d}}', CAST(floor(bytes / 100) AS BIGINT) // 3600, CAST(floor(bytes / 100) AS BIGINT) % 3600 // 60, CAST(floor(bytes / 100) AS BIGINT) % 60) || '</itunes:duration></item>', chr(10) ORDER BY n) AS items FROM t WHERE n <= 3 GROUP BY channel)
SELECT c_custkey AS channel, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>' || c_name || '</title><link>https://example.org/</link><description>' || c_mktsegment || '</description>' || coalesce(items, '') || '</channel></rss>') AS digest FROM customer LEFT JOIN x ON x.channel = c_custkey""",
    "sink_changed": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE lang IS NULL OR lang = 'fr' OR text IS NULL OR lang = 'de' AND text <> ''",
}
_O = detect.EVENTS
_ANCHORS = f"""{SCORED}, {_CLUSTERS.format(t=_O.anchor_threshold)}, {_BRIDGE.format(gap=_O.bridge_gap)},
wf AS (SELECT *, rule <> 'content' AND prob >= {_O.weak_lead} AND prob < {_O.anchor_threshold} AND coalesce(lag(prob) OVER w, 0) < {_O.anchor_threshold} AND coalesce(lead(prob) OVER w, 0) < {_O.anchor_threshold} AS ok FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
wg AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM wf),
weak AS (SELECT user_id, arg_min(rule, idx) AS rule, min("start") AS "start", max("end") AS "end", max(prob) AS prob FROM wg WHERE ok GROUP BY user_id, g),
both_ AS (SELECT user_id, rule, "start", "end", prob, false AS loc FROM bridged UNION ALL SELECT user_id, rule, "start", "end", prob, true FROM weak),
anc AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY "start", "end", rule, loc) - 1 AS INTEGER) AS anchor, "start" AS a0, "end" AS a1 FROM both_)"""


def _fused_sql(source: str, pre: float, post: float) -> str:
    """CTEs from regions (user_id, rule, start, end, prob, loc) to fused cuts: `cuts`."""
    more = ", CASE WHEN min(rule) = max(rule) THEN min(rule) ELSE 'mixed' END AS rule, CASE WHEN min(source) = max(source) THEN min(source) ELSE 'mixed' END AS source, min(confidence) AS confidence"
    return f"""long_ AS (SELECT user_id, rule, "start", "end", prob AS confidence, CASE WHEN loc THEN 'localized' ELSE 'scan' END AS source FROM {source} WHERE "end" - "start" >= CASE WHEN loc THEN {_O.min_localized_region} ELSE {_O.min_region} END),
{_clamped("long_", "cl", 2592000.0, ", rule, source, confidence")},
wide AS (SELECT user_id, rule, source, confidence, "start" - {pre} AS "start", "end" + {post} AS "end" FROM cl),
{_clamped("wide", "cw", 2592000.0, ", rule, source, confidence")},
{merged_sql("cw", _O.merge_gap, "cuts", more)}"""


_POINT = 'SELECT a.user_id, a.anchor, a.user_id * 100000 + a.anchor AS k, a0, a1, loc, s."start" AS s, s."end" AS e, round(s.prob, 6) AS p, CASE WHEN a.user_id % 2 = 0 THEN round(s.prob, 6) END AS ad, s.event_id'


def _starts_sql() -> str:
    """CTEs of detect_starts: `st` (user_id, anchor, new_start, reason)."""
    return f"""sp AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, event_id) - 1 AS o FROM ({_POINT} FROM anc a JOIN seg s ON s.user_id = a.user_id AND s."start" >= a0 - 172800 AND s."start" < a1) t),
near_ AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS idx FROM sp WHERE s >= a0 - {_O.start_reach}), {_change("(SELECT k, idx, p FROM near_)", "sc", "k")},
sf AS (SELECT n.k, n.s, sc.height FROM sc JOIN near_ n ON n.k = sc.k AND n.idx = sc.cp WHERE height > 0 AND before < 0.5),
si AS (SELECT k, arg_min(s, o) AS s FROM near_ WHERE s >= a0 AND p >= {_O.start_inside} GROUP BY k),
sq AS (SELECT k, min(s) FILTER (s >= a0 AND CASE WHEN ad IS NULL THEN p / 2 ELSE p END >= {_O.anchor_threshold}) AS sure, bool_or(s >= a0 AND p >= {_O.start_inside}) AS seen, count(*) AS n FROM sp GROUP BY k),
sm AS (SELECT a.*, coalesce(sf.s, si.s) AS new_, CASE WHEN sf.s IS NOT NULL THEN 'fitted' WHEN si.s IS NOT NULL THEN 'inside' END AS pick, coalesce(sf.height, 0) AS step, sure, seen, n
 FROM anc a LEFT JOIN sf ON sf.k = a.user_id * 100000 + a.anchor LEFT JOIN si ON si.k = a.user_id * 100000 + a.anchor LEFT JOIN sq ON sq.k = a.user_id * 100000 + a.anchor),
so AS (SELECT *, coalesce(n > 1 AND pick IS NOT NULL AND CASE WHEN loc THEN new_ < a1 AND (new_ >= a0 OR step >= {_O.localized_min_step}) ELSE new_ >= a0 OR seen END, false) AS ok, coalesce(n > 1 AND NOT loc AND sure IS NOT NULL, false) AS ask FROM sm),
st AS (SELECT user_id, anchor, rule, prob, loc, a1, CASE WHEN ok THEN new_ WHEN ask THEN sure ELSE a0 END AS new_start, CASE WHEN ok THEN pick WHEN ask THEN 'classified' ELSE 'kept' END AS reason FROM so)"""


def _ends_sql(source: str) -> str:
    """CTEs of detect_ends for anchors `source` (user_id, anchor, b0: start, a1: end, loc): `en` (user_id, anchor, new_end, reason)."""
    return f"""ep0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, event_id) - 1 AS idx FROM ({_POINT.replace("a0, ", "b0, ")} FROM {source} a JOIN seg s ON s.user_id = a.user_id AND s."start" >= a1 - 43200 AND s."start" < a1 + 172800) t),
el AS (SELECT k, count(*) AS n, max(p) AS m, count(ad) > 0 AS has, arg_max(e, idx) AS le, min(idx) FILTER (s >= b0 AND s < a1 AND ad >= {_O.extend_while}) AS seed, min(idx) FILTER (s >= a1) AS after, min(idx) FILTER (s >= b0 AND s < a1) AS tail,
 arg_min(s, idx) FILTER (s >= b0 AND s < a1) AS ts, coalesce(bool_or(ad > {1 - _O.extend_while}) FILTER (s >= b0 AND s < a1), false) AS loud, any_value(b0) AS b0 FROM ep0 GROUP BY k),
ew AS (SELECT k, unnest(range(least({_O.end_first}, n), n + 1)) AS w FROM el WHERE n >= 2),
epre AS (SELECT p.k * 10000 + w.w AS k, p.idx, p.p FROM ep0 p JOIN ew w ON w.k = p.k AND p.idx < w.w), {_change("epre", "ec", "k")},
eh AS (SELECT k // 10000 AS k, arg_min(cp, k) AS cp FROM ec WHERE round(height, 12) >= {_O.end_step} GROUP BY k // 10000),
es AS (SELECT el.*, cp, CASE WHEN n < 2 THEN 'short' WHEN cp IS NOT NULL THEN 'fitted' WHEN m < {_O.end_never} THEN 'never' ELSE 'ambiguous' END AS state, has AND tail IS NOT NULL AND NOT loud AND ts - b0 >= {_O.min_region} AS keeps FROM el LEFT JOIN eh USING (k)),
eb AS (SELECT *, CASE state WHEN 'never' THEN n WHEN 'ambiguous' THEN coalesce(seed, CASE WHEN keeps THEN tail ELSE coalesce(after, n) END) WHEN 'short' THEN 0 ELSE cp END AS base, CASE WHEN state = 'ambiguous' AND seed IS NULL AND keeps THEN 'low tail kept' ELSE state END AS why FROM es),
ea AS (SELECT eb.k, any_value(eb.n) AS n, any_value(base) AS base, any_value(why) AS why, any_value(le) AS le, CASE WHEN any_value(has) THEN coalesce(min(p.idx) FILTER (p.idx >= base AND p.ad < {_O.extend_while}), any_value(eb.n)) ELSE any_value(base) END AS at_ FROM eb JOIN ep0 p ON p.k = eb.k GROUP BY eb.k),
en AS (SELECT a.user_id, a.anchor, CASE WHEN loc OR coalesce(n, 0) < 2 THEN a.a1 WHEN at_ >= n THEN greatest(le, a.a1) ELSE q.s END AS new_end,
 CASE WHEN loc THEN 'localized run' WHEN coalesce(n, 0) < 2 THEN 'no curve' WHEN at_ > base THEN why || ', extended' ELSE why END AS reason
 FROM {source} a LEFT JOIN ea ON ea.k = a.user_id * 100000 + a.anchor LEFT JOIN (SELECT k, idx, s FROM ep0) q ON q.k = ea.k AND q.idx = ea.at_)"""


ORACLES |= {
    "detect_plan": f'WITH {_ANCHORS}, {_fused_sql("anc", 0, 0)} SELECT user_id, round("start", 6) AS "start", round("end", 6) AS "end", rule, source, round(confidence, 6) AS confidence FROM cuts',
    "detect_starts": f"WITH {_ANCHORS}, {_starts_sql()} SELECT user_id, anchor, round(new_start, 6) AS new_start, reason FROM st",
    "detect_ends": f"WITH {_ANCHORS}, anb AS (SELECT *, a0 AS b0 FROM anc), {_ends_sql('anb')} SELECT user_id, anchor, round(new_end, 6) AS new_end, reason FROM en",
    "detect_regions": f"""WITH {_ANCHORS}, {_starts_sql()},
tr AS (SELECT st.user_id, st.anchor, min(s) AS s FROM st JOIN sp ON sp.user_id = st.user_id AND sp.anchor = st.anchor WHERE st.anchor % 2 = 0 AND new_start < st.a1 AND sp.s >= sp.a0 AND sp.s >= new_start AND CASE WHEN ad IS NULL THEN p / 2 ELSE p END >= {_O.outro_from} GROUP BY ALL),
anb AS (SELECT st.*, greatest(new_start, coalesce(tr.s, new_start)) AS b0 FROM st LEFT JOIN tr USING (user_id, anchor)), {_ends_sql('anb')},
rg AS (SELECT anb.user_id, anb.rule, anb.prob, anb.loc, b0 AS "start", new_end AS "end" FROM anb JOIN en USING (user_id, anchor)), {_fused_sql("rg", _O.pad_before, _O.pad_after)}, {_keeps("cuts", _O.min_keep)}
SELECT user_id, 'cut' AS kind, round("start", 6) AS "start", round("end", 6) AS "end" FROM cuts UNION ALL SELECT user_id, 'keep', round("start", 6), round("end", 6) FROM kept""",
}
_SIDES = f"""{_EP},
up AS (SELECT channel, video_id, row_number() OVER (PARTITION BY channel ORDER BY price DESC, video_id) AS listing, priority AS title, CAST(bytes % 4000 AS DOUBLE) AS seconds, priority <> '3-MEDIUM' AS accessible FROM ep WHERE price > 60000),
fe AS (SELECT channel, video_id, published_at, bytes FROM ep WHERE stage = 'published'),
st AS (SELECT channel, video_id, stage, CASE WHEN priority = '5-LOW' THEN 'excluded' ELSE '' END AS removal, stage = 'published' AS hp, priority = '2-HIGH' AS pp,
  priority = '5-LOW' AND stage = 'waiting' AS dp, CASE WHEN bytes % 3 = 0 THEN 'failed' END AS err, 60e0 AS secs FROM ep WHERE priority > '1-URGENT' OR stage = 'pending'),
ch AS (SELECT c_custkey AS channel, c_acctbal > 0 AS enabled, c_acctbal > 9000 AS purge FROM customer)"""
_PLAN = f"""{_SIDES},
j AS (SELECT channel, video_id, up.* EXCLUDE (channel, video_id), fe.published_at, fe.bytes, fe.video_id IS NOT NULL AS in_feed, st.* EXCLUDE (channel, video_id), up.video_id IS NOT NULL AS in_up
  FROM up FULL JOIN fe USING (channel, video_id) FULL JOIN st USING (channel, video_id)),
k AS (SELECT j.*, in_up AND accessible AND (SELECT count(*) FROM up u WHERE u.channel = j.channel AND u.accessible AND u.listing < j.listing) < 5 AS sel,
  in_feed AND coalesce(removal, '') = '' AS stays FROM j JOIN ch USING (channel) WHERE enabled),
l AS (SELECT *, sum(CASE WHEN stays THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY published_at DESC NULLS LAST, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM k),
pl AS (SELECT channel, video_id, title, CASE WHEN coalesce(seconds, 0) > 0 THEN seconds ELSE coalesce(secs, 0) END AS seconds, coalesce(bytes, 0) AS bytes, coalesce(sel, false) AS selected,
  CASE WHEN coalesce(removal, '') <> '' THEN removal WHEN stays AND place > 3 THEN 'pruned' WHEN coalesce(hp, false) AND NOT coalesce(pp, false) THEN 'existing' WHEN stage = 'waiting' THEN 'waiting' WHEN stage = 'rendered' THEN 'rendered'
    WHEN coalesce(err, '') <> '' THEN 'retry' ELSE 'new' END AS status, coalesce(dp, false) AS recovery FROM l)"""
ORACLES |= {
    "cat_plan": f"WITH {_PLAN} SELECT * FROM pl",
    "cat_plan_totals": f"""WITH {_PLAN}, o AS (SELECT *, selected AND status IN ('new', 'retry') AS op FROM pl)
SELECT channel, count(*) FILTER (WHERE op) AS to_do, count(*) FILTER (WHERE op AND seconds <= 0) AS unknown, coalesce(sum(seconds) FILTER (WHERE op), 0e0) AS todo_seconds,
CAST(sum(CASE WHEN status IN ('pruned', 'excluded') THEN 0 ELSE bytes END) AS BIGINT) AS stored_bytes, bool_or(recovery) AS recovery FROM o GROUP BY channel""",
    "cat_retention_actions": f"""WITH {_SIDES},
x AS (SELECT e.channel, e.video_id, e.published_at, u.listing, f.video_id IS NULL AS new, coalesce(s.removal, '') <> '' AS leaving, purge
  FROM ep e LEFT JOIN up u USING (channel, video_id) LEFT JOIN fe f USING (channel, video_id) LEFT JOIN st s USING (channel, video_id) JOIN ch USING (channel) WHERE f.video_id IS NOT NULL OR u.listing IS NOT NULL),
r AS (SELECT *, coalesce(sum(CASE WHEN new THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY published_at DESC, listing IS NULL, listing, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM x WHERE NOT leaving),
a AS (SELECT channel, video_id, CAST(place AS INTEGER) AS place, CASE WHEN purge AND new THEN 'reject' WHEN purge THEN 'exclude' WHEN new AND place < 3 THEN 'admit' WHEN new THEN 'reject' WHEN place < 3 THEN 'keep' ELSE 'prune' END AS action FROM r)
SELECT * FROM a UNION ALL SELECT channel, video_id, NULL, CASE WHEN dp THEN 'finish' ELSE 'exclude' END FROM st JOIN ch USING (channel) WHERE (dp OR purge) AND NOT EXISTS (SELECT 1 FROM a WHERE a.channel = st.channel AND a.video_id = st.video_id)""",
    "stream_latest_state": """SELECT o_custkey AS channel, max(o_orderkey) AS version, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'published' ELSE 'pending' END, o_orderkey) AS stage,
arg_max(CASE WHEN o_orderpriority = '5-LOW' THEN 'excluded' ELSE '' END, o_orderkey) AS removal, bool_or(o_orderstatus = 'F') AS has_published, max(CAST(floor(o_totalprice) AS BIGINT)) AS input, max(CAST(floor(o_totalprice) AS BIGINT) % 1000) AS output FROM orders GROUP BY o_custkey""",
}
