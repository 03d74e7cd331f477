"""Queries of joins by keys, of class counts, of refusals, and of what goes into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import records as Rec
from ..operators import catalog as K
from ..operators import cues as C
from ..operators import evaluate as E
from ..operators import runs as R
from ..operators import scoring as S
from ..operators import usage as U
from ..sources import sinks
from .queries_intervals import _CLUSTERS
from .tables import CUES, SCORED, SEG, cues, rounded, scored, segments, table


def cat_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "video_id")
    sides = {
        "feed": o.where("o_orderstatus <> 'O'").select("video_id", F.floor("o_totalprice").cast("long").alias("bytes")),
        "state": o.where("o_orderpriority <> '5-LOW'").select("video_id", F.col("o_orderstatus").alias("stage")),
        "listing": o.where("o_totalprice > 150000").select("video_id", (F.col("video_id") % 97).alias("position")),
        "metadata": o.where("o_orderpriority < '3'").select("video_id", F.col("o_orderpriority").alias("title")),
    }
    names = {"feed_bytes": "bytes", "state_stage": "stage", "listing_position": "position", "metadata_title": "title"}
    return K.joined(sides, ["video_id"]).withColumnsRenamed(names)


def cat_live_keys(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.live(table(spark, sf_dir, "orders").select("o_orderkey"), used, "o_orderkey")


def cat_ready(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stage = F.when(F.col("o_orderstatus") == "F", "rendered").otherwise("waiting")
    return K.ready(o.select("o_orderkey", stage.alias("stage"), (F.col("o_orderpriority") < "4").alias("publish_pending"), (F.col("o_totalprice") < 50000).alias("delete_pending"), F.when(F.col("o_orderpriority") == "1-URGENT", "keep").otherwise("").alias("removal"))).select("o_orderkey")


def cat_subscriptions(spark, sf_dir):
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), (F.col("c_acctbal") > 0).alias("enabled"))
    published = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("channel"))
    return K.subscriptions(channels, published, "channel").select("channel")


def usage_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at"), "event_type", F.col("event_id").alias("tokens"))
    runs = e.where("event_type = 'signup'").select("user_id", "at").distinct().withColumn("result", F.when(F.dayofmonth("at") % 2 == 0, "unfinished").otherwise("done"))
    out = U.attributed(e.where("event_type <> 'signup'"), runs, ["user_id"], "at", ["tokens"])
    return out.select("user_id", F.unix_micros("at").alias("at_us"), "result", "attempts", "tokens")


def eval_class_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return E.class_counts(rows, "toxic", ["source", "lang"])


def eval_report(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy("user_id").agg(*[F.count_if(F.col("rule") == r).cast("double").alias(n) for r, n in (("view", "content_lost"), ("click", "worst"), ("error", "required_left"))],
        *[F.count_if(F.col("rule") == r).alias(n) for r, n in (("signup", "missed"), ("purchase", "partly"), ("view", "fully"))])
    return E.report(s, ["user_id"], 10.0).select(F.md5(F.replace("json", F.lit(".0"), F.lit(""))).alias("digest"))


def cfg_criteria(spark, sf_dir):
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("rule"), F.lower("o_orderpriority").alias("prompt")).distinct()
    text = F.array_join(F.transform(F.map_entries("criteria"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return config.criteria(rules, ["channel"], "the programme itself").select("channel", text.alias("criteria"))


def label_quote_nearest(spark, sf_dir):
    """Each turn quoted, at a time that is off by up to 40 seconds."""
    c = cues(spark, sf_dir)
    quotes = c.select("conv_id", "seq", F.col("text").alias("quote"), (F.col("start") + F.col("seq") * 7 % 41).alias("at"))
    return rounded(C.nearest_quotes(quotes, c, ["conv_id"], "seq").select("conv_id", "seq", "found", "off"), "found")


def score_with_predicate(spark, sf_dir):
    s = segments(spark, sf_dir)
    maps = S.feature_maps(s.where("rule <> 'view'").select("user_id", F.col("rule").alias("feature"), F.col("prob").alias("value")), ["user_id"])
    answers = s.where("rule = 'view'").groupBy("user_id").agg(F.max("prob").alias("p"))
    held = S.with_predicate(maps, answers, ["user_id"])
    return rounded(held.select("user_id", S.logistic(F.col("values"), {"predicate": 1.5, "click": -0.5}, 0.1).alias("score"), F.size("values").alias("n")), "score")


def run_localized(spark, sf_dir):
    """Sentences of each user's days as spans that were localized."""
    day = scored(spark, sf_dir).withColumn("day", F.floor(F.col("start") / 86400).cast("int"))
    return rounded(R.localized(day, ["user_id", "day"], 0.35), "start", "end", "prob")


def rec_refusal(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    message = F.element_at(F.array(*map(F.lit, ["ERROR: Private video. Sign in", "Premieres in 3 hours", "HTTP Error 429", "Join: members-only content", "This live event will begin in 5 days", "Available to this channel's members on level: x"])), (F.col("event_id") % 6 + 1).cast("int"))
    return d.select("event_id", Rec.refusal(message).alias("reason"), Rec.backoff(F.col("event_id") % 9).alias("wait"))


def sink_feature_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    return sinks.feature_lines(rows, ["o_orderkey"])


def sink_feed_full(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").cast("string").alias("guid"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.lit("https://example.org/a").alias("url"), F.lit(7).alias("bytes"), F.lit(61.0).alias("seconds"), F.col("o_orderstatus").alias("description"), F.when(F.col("o_orderkey") % 2 == 0, "https://example.org/i").alias("image"),
        F.when(F.col("o_orderkey") % 3 == 0, "https://example.org/c").alias("chapters_url"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.lit(1.5).alias("start"), F.lit("A & B").alias("title")))).otherwise(F.array().cast("array<struct<start:double,title:string>>")).alias("chapters"),
    )
    feeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.col("c_name").alias("title"), F.lit("https://example.org/f").alias("link"), F.lit("d").alias("description"), F.when(F.col("c_custkey") % 2 == 0, "de").otherwise("").alias("language"), F.col("c_mktsegment").alias("category"), F.lit("https://example.org/j").alias("image"))
    return sinks.feed_xml(feeds, items, "channel").select("channel", F.md5("xml").alias("digest"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("cat_", "usage_", "eval_", "cfg_", "label_", "score_", "run_", "rec_", "sink_")) and callable(f) and f.__module__ == __name__}

_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), '\s+'), lambda x: x <> '')"
_CHAPTERS = '<podcast:chapters url="https://example.org/c" type="application/json+chapters"/><psc:chapters version="1.2"><psc:chapter start="00:00:01.500" title="A &amp; B"/></psc:chapters>'
ORACLES = {
    "cat_joined": """SELECT o_orderkey AS video_id, o_orderstatus <> 'O' AS in_feed, o_orderpriority <> '5-LOW' AS in_state, o_totalprice > 150000 AS in_listing, o_orderpriority < '3' AS in_metadata,
CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) END AS bytes, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS stage, CASE WHEN o_totalprice > 150000 THEN o_orderkey % 97 END AS position, CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS title
FROM orders WHERE o_orderstatus <> 'O' OR o_orderpriority <> '5-LOW' OR o_totalprice > 150000 OR o_orderpriority < '3'""",
    "cat_live_keys": "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS live FROM orders",
    "cat_ready": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '4' AND o_totalprice >= 50000 AND o_orderpriority <> '1-URGENT'",
    "cat_subscriptions": "SELECT c_custkey AS channel FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "usage_runs": """WITH e AS (SELECT user_id, date_trunc('day', ts) AS at_, event_type, event_id FROM events), r AS (SELECT DISTINCT user_id, at_ FROM e WHERE event_type = 'signup')
SELECT r.user_id, epoch_us(r.at_) AS at_us, CASE WHEN day(r.at_) % 2 = 0 THEN 'unfinished' ELSE 'done' END AS result, CASE WHEN day(r.at_) % 2 = 0 THEN count(e.event_id) ELSE 0 END AS attempts, CAST(CASE WHEN day(r.at_) % 2 = 0 THEN coalesce(sum(e.event_id), 0) ELSE 0 END AS BIGINT) AS tokens
FROM r LEFT JOIN e ON e.user_id = r.user_id AND e.at_ = r.at_ AND e.event_type <> 'signup' GROUP BY r.user_id, r.at_""",
    "eval_class_counts": "SELECT toxic, count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM labels JOIN documents USING (doc_id) GROUP BY toxic",
    "eval_report": """WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS cl, count(*) FILTER (event_type = 'click') AS w, count(*) FILTER (event_type = 'error') AS rl, count(*) FILTER (event_type = 'signup') AS m, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT md5('{"totals":{"episodes":' || count(*) || ',"content_lost":' || sum(cl) || ',"worst":' || max(w) || ',"over":' || count(*) FILTER (w > 10) || ',"required_left":' || sum(rl) || ',"missed":' || sum(m) || ',"partly":' || sum(p) || ',"fully":' || sum(cl) || '},"episodes":[' ||
 string_agg('{"user_id":' || user_id || ',"content_lost":' || cl || ',"worst":' || w || ',"required_left":' || rl || ',"missed":' || m || ',"partly":' || p || ',"fully":' || cl || '}', ',' ORDER BY user_id) || ']}') AS digest FROM s""",
    "cfg_criteria": "WITH r AS (SELECT DISTINCT o_orderstatus AS channel, o_orderpriority || '=' || lower(o_orderpriority) AS x, o_orderpriority AS k FROM orders UNION SELECT DISTINCT o_orderstatus, 'content=the programme itself', 'content' FROM orders) SELECT channel, string_agg(x, ';' ORDER BY k) AS criteria FROM r GROUP BY channel",
    "label_quote_nearest": f"""WITH {CUES}, w AS (SELECT conv_id, seq, "start", "start" + seq * 7 % 41 AS at_, array_to_string({_WORDS.format(c="text")}, ' ') AS t, array_to_string(({_WORDS.format(c="text")})[1:6], ' ') AS head FROM cues),
h AS (SELECT q.conv_id, q.seq, q.at_, c."start" AS s, row_number() OVER (PARTITION BY q.conv_id, q.seq ORDER BY abs(c."start" - q.at_), c."start") AS n FROM w q LEFT JOIN w c ON c.conv_id = q.conv_id AND q.head <> '' AND contains(c.t, q.head))
SELECT conv_id, seq, round(s, 6) AS found, s IS NULL OR abs(s - at_) > 15 AS off FROM h WHERE n = 1""",
    "score_with_predicate": f"""WITH {SEG}, m AS (SELECT user_id, max(prob) FILTER (WHERE rule = 'click') AS c, max(prob) FILTER (WHERE rule = 'view') AS p, count(DISTINCT rule) FILTER (WHERE rule <> 'view') AS n FROM seg GROUP BY user_id)
SELECT user_id, round(1 / (1 + exp(-(0.1 + coalesce(c, 0) * -0.5 + coalesce(p, 0) * 1.5))), 6) AS score, CAST(n + CASE WHEN p IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n FROM m WHERE n > 0""",
    "run_localized": f"""WITH {SCORED.replace("scored AS (", "scored0 AS (")}, scored AS (SELECT * EXCLUDE (user_id), user_id * 1000 + CAST(floor("start" / 86400) AS INTEGER) AS user_id FROM scored0), {_CLUSTERS.format(t=0.35)}
SELECT user_id // 1000 AS user_id, CAST(user_id % 1000 AS INTEGER) AS "day", rule, round("start", 6) AS "start", round("end", 6) AS "end", round(prob, 6) AS prob, windows FROM runs""",
    "rec_refusal": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'private' WHEN 1 THEN 'upcoming' WHEN 3 THEN 'members-only' WHEN 4 THEN 'upcoming' WHEN 5 THEN 'members-only' END AS reason, 0.5e0 * pow(2, event_id % 9) AS wait FROM events",
    "sink_feature_lines": """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '","customer":' || o_custkey || '}' AS line FROM orders""",
    "sink_feed_full": f"""WITH x AS (SELECT o_custkey AS channel, string_agg('<item><title>' || o_orderpriority || '</title><guid>' || o_orderkey || '</guid><pubDate>' || strftime(CAST(o_orderdate AS TIMESTAMP), '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate><enclosure url="https://example.org/a" length="7" type="audio/x-m4a"/><itunes:duration>0:01:01</itunes:duration><description>' || o_orderstatus || '</description>' ||
 CASE WHEN o_orderkey % 2 = 0 THEN '<itunes:image href="https://example.org/i"/>' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '{_CHAPTERS}' ELSE '' END || '</item>', chr(10) ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey)
SELECT c_custkey AS channel, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0"{"".join(f' xmlns:{n}="{u}"' for n, u in sinks.NAMESPACES)}><channel><title>' || c_name || '</title><link>https://example.org/f</link><description>d</description><language>' || CASE WHEN c_custkey % 2 = 0 THEN 'de' ELSE 'en-us' END ||
 '</language><itunes:category text="' || c_mktsegment || '"/><itunes:image href="https://example.org/j"/><atom:link href="https://example.org/f" rel="self" type="application/rss+xml"/>' || coalesce(items, '') || '</channel></rss>') AS digest FROM customer LEFT JOIN x ON x.channel = c_custkey""",
}
