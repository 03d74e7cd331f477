"""Queries of what is read back from texts that were written: captions, feeds, pages, chapter documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import chapters as H
from ..operators import spans as P
from ..sources import captions, sinks
from .queries_catalog import _EP, _N, _episodes, _newest
from .queries_text import ORACLES as _TEXT
from .tables import CUES, cues, rounded, table


def src_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as caption files and read again: cleaned, without what a cue restates."""
    spoken = cues(spark, sf_dir).where(F.length("text") > 0)
    files = sinks.vtt(spoken, ["conv_id"])
    read = captions.parsed_vtt(files, ["conv_id"], "vtt")
    return rounded(read.select("conv_id", "seq", "start", "end", F.md5("text").alias("digest")), "start", "end", digits=3)


def _feeds(spark, sf_dir):
    """A feed of each customer's five newest orders, with chapters, as text; and what was written."""
    chapters = F.array(*[F.struct((F.lit(i) * 61.5).alias("start"), F.concat(F.col("priority"), F.lit(f" & {i}")).alias("title")) for i in range(3)])
    items = K.latest(_episodes(spark, sf_dir), ["channel"], 5, _newest()).select(
        "channel", F.col("rank").alias("place"), F.col("video_id").cast("string").alias("guid"), F.col("priority").alias("title"), "published_at", F.concat(F.lit("https://example.org/a?b&c="), "video_id").alias("url"), "bytes",
        F.floor(F.col("bytes") / 100).cast("double").alias("seconds"), F.concat(F.lit("About <"), "priority", F.lit(">")).alias("description"), F.concat(F.lit("https://example.org/i/"), "video_id").alias("image"),
        F.concat(F.lit("https://example.org/c/"), "video_id").alias("chapters_url"), F.when(F.col("bytes") % 2 == 0, chapters).otherwise(F.slice(chapters, 1, 0)).alias("chapters"),
    )
    feeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.col("c_name").alias("title"), F.lit("https://example.org/f").alias("link"), F.concat("c_mktsegment", F.lit(" & more")).alias("description"), F.lit("de").alias("language"), F.lit("").alias("category"), F.lit("https://example.org/p").alias("image"))
    return captions.parsed_feeds(sinks.feed_xml(feeds, items, "channel"), ["channel"], "xml")


def src_feed_channels(spark, sf_dir):
    return captions.feed_channels(_feeds(spark, sf_dir), ["channel"])


def src_feed_entries(spark, sf_dir):
    entries = captions.feed_entries(_feeds(spark, sf_dir), ["channel"])
    placed = K.ordered_items_exact(entries.withColumn("listing", F.lit(None).cast("int")), ["channel"])
    listed = F.array_join(F.transform("chapters", lambda c: F.format_string("%.1f %s", c["start"], c["title"])), "|")
    return placed.select("channel", "place", "guid", "title", "description", F.unix_seconds("published_at").alias("at"), "url", "bytes", "seconds", "image", "chapters_url", listed.alias("chapters"))


def src_missing(spark, sf_dir):
    """Customers that were asked for and have no urgent order."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"))
    return captions.missing(asked, _episodes(spark, sf_dir).where("priority = '1-URGENT'"), ["channel"])


def sink_subscription_page(spark, sf_dir):
    shows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.col("s_name"), F.lit(" & Co")).alias("title"), F.concat(F.lit("https://example.org/f?s="), F.col("s_suppkey")).alias("url"))
    page = sinks.subscription_page(shows, "k")
    return page.select(F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest"))


def sink_opml(spark, sf_dir):
    shows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.col("s_name"), F.lit(" & Co")).alias("title"), F.concat(F.lit("https://example.org/f?s="), F.col("s_suppkey")).alias("url"))
    return sinks.opml(shows, "k").select(F.length("opml").cast("long").alias("chars"), F.md5("opml").alias("digest"))


def span_reversed_ids(spark, sf_dir):
    return P.reversed_ids(cues(spark, sf_dir).select("conv_id", F.col("seq").alias("idx")), ["conv_id"], "L").select("conv_id", "idx", "sid")


def chap_document(spark, sf_dir):
    """Each conversation's turns of ten words or more as a chapter document."""
    c = cues(spark, sf_dir).where(F.length("text") >= 60).select("conv_id", F.floor("start").cast("double").alias("start"), F.concat(F.lit('turn "'), "seq", F.lit('"')).alias("title"))
    return H.chapter_json(c, ["conv_id"]).select("conv_id", F.md5(F.regexp_replace("json", r"\.0", "")).alias("digest"))


def chap_problems(spark, sf_dir):
    """Ranges between long turns against lengths that are off for many of them."""
    c = cues(spark, sf_dir).where(F.length("text") >= 20)
    keeps = c.select("conv_id", "start", F.when(F.col("seq") == 3, F.col("start") + 0.02).otherwise(F.col("end")).alias("end"))
    sums = keeps.groupBy("conv_id").agg(F.sum(F.round("end", 3) - F.round("start", 3)).alias("s"), F.count(F.lit(1)).alias("n"))
    edited = sums.select("conv_id", (F.col("s") - (F.col("n") - 1) * 0.05 + F.when(F.col("n") > 4, 1.0).otherwise(0.0)).alias("duration"))
    return H.timeline_problems(keeps, ["conv_id"], 0.05, edited)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("src_", "sink_", "span_", "chap_", "ev_")) and callable(f)}

_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '\"'), '\s+', ' ', 'g'))"
_READ = rf"""sp AS (SELECT conv_id, "start", "end", text, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS seq FROM cues WHERE length(text) > 0),
roll AS (SELECT conv_id, CAST(seq AS INTEGER) AS seq, {_CLEAN} AS text, round("start", 3) AS "start", round("end", 3) AS "end" FROM sp),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS k FROM roll WHERE text <> '')"""
_FOLD = _TEXT["cue_dedupe"]
_FEED = f"""{_EP}, it AS (SELECT *, {_N} AS n FROM ep), last AS (SELECT * FROM it WHERE n <= 5)"""
_SHOW = "(SELECT s_suppkey AS k, replace(s_name || ' & Co', '&', '&amp;') AS title, s_name || ' & Co' AS t, 'https://example.org/f?s=' || s_suppkey AS url FROM supplier)"
ORACLES = {
    "src_captions": f"WITH RECURSIVE {CUES}, {_READ}," + _FOLD[_FOLD.index("\nf(") :].split("\nSELECT conv_id, seq, md5(fresh)")[0] + """
SELECT f.conv_id, f.seq, roll."start", roll."end", md5(fresh) AS digest FROM f JOIN roll ON roll.conv_id = f.conv_id AND roll.seq = f.seq WHERE fresh <> ''""",
    "src_feed_channels": "SELECT c_custkey AS channel, c_name AS title, c_mktsegment || ' & more' AS description, 'de' AS language, 'Technology' AS category, 'https://example.org/p' AS image FROM customer",
    "src_feed_entries": f"""WITH {_FEED} SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY published_at DESC, n) - 1 AS INTEGER) AS place, CAST(video_id AS VARCHAR) AS guid, priority AS title, 'About <' || priority || '>' AS description, CAST(epoch(published_at) AS BIGINT) AS "at",
'https://example.org/a?b&c=' || video_id AS url, bytes, CAST(floor(bytes / 100) AS DOUBLE) AS seconds, 'https://example.org/i/' || video_id AS image, 'https://example.org/c/' || video_id AS chapters_url,
CASE WHEN bytes % 2 = 0 THEN '0.0 ' || priority || ' & 0|61.5 ' || priority || ' & 1|123.0 ' || priority || ' & 2' ELSE '' END AS chapters FROM last""",
    "src_missing": "SELECT c_custkey AS channel FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "sink_subscription_page": f"""WITH x AS (SELECT '<!doctype html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><meta name="robots" content="noindex"><title>Feeds</title></head>' || chr(10) || '<body><h1>Feeds</h1>' || chr(10) || '<ul>' || chr(10) ||
string_agg('<li><b>' || title || '</b> <a href="{sinks.SUBSCRIBE}https%3A%2F%2Fexample.org%2Ff%3Fs%3D' || k || '">Subscribe</a> <a href="' || url || '">' || url || '</a></li>', chr(10) ORDER BY t, k) || chr(10) || '</ul>' || chr(10) || '<p><a href="feeds.opml" download="feeds.opml">All feeds as one list</a></p></body></html>' AS h FROM {_SHOW} s)
SELECT length(h) AS chars, md5(h) AS digest FROM x""",
    "sink_opml": f"""WITH x AS (SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<opml version="2.0"><body>' || chr(10) || string_agg('<outline type="rss" text="' || title || '" xmlUrl="' || url || '"/>', chr(10) ORDER BY t, k) || chr(10) || '</body></opml>' AS h FROM {_SHOW} s)
SELECT length(h) AS chars, md5(h) AS digest FROM x""",
    "span_reversed_ids": "SELECT conv_id, turn AS idx, format('L{:03d}', count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1) AS sid FROM conversations",
    "chap_document": f"""WITH {CUES}, c AS (SELECT conv_id, '{{"startTime":' || CAST(floor("start") AS BIGINT) || ',"title":"turn \\"' || seq || '\\""}}' AS x, floor("start") AS s, 'turn "' || seq || '"' AS t FROM cues WHERE length(text) >= 60)
SELECT conv_id, md5(replace('{{"version":"1.2.0","chapters":[' || string_agg(x, ',' ORDER BY s, t) || ']}}', '.0', '')) AS digest FROM c GROUP BY conv_id""",
    "chap_problems": f"""WITH {CUES}, k AS (SELECT conv_id, seq, round("start", 3) AS s, round(CASE WHEN seq = 3 THEN "start" + 0.02 ELSE "end" END, 3) AS e FROM cues WHERE length(text) >= 20)
SELECT conv_id, CASE WHEN bool_or(e - s < 0.05) THEN 'short' ELSE 'length' END AS problem FROM k GROUP BY conv_id HAVING bool_or(e - s < 0.05) OR count(*) > 4""",
}
