"""Queries of candidates, silences, marks, matching, dates and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as Rec
from ..operators import cues as C
from ..operators import spans as P
from .tables import CUES, SEG, cues, rounded, segments, table
from .queries_text import _PIECES, _RAW

KEY = ["user_id"]


def span_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    anchors = s.where("rule = 'error'").select("user_id", F.col("event_id").alias("aid"), (F.col("start") - 172800).alias("a_start"), (F.col("end") + 86400).alias("a_end"))
    left = P.candidates(s.select("user_id", "event_id", "start", "end"), anchors, KEY, "aid", "L", 4)
    right = P.candidates(s.select("user_id", "event_id", "start", "end"), anchors, KEY, "aid", "R", 4)
    return left.select("aid", "event_id", "idx", F.lit("L").alias("side")).unionByName(right.select("aid", "event_id", "idx", F.lit("R").alias("side")))


def span_previous_text(spark, sf_dir):
    return P.previous_text(cues(spark, sf_dir), ["conv_id"], "seq").select("conv_id", "seq", F.md5("before").alias("digest"))


def span_outros(spark, sf_dir):
    c = cues(spark, sf_dir)
    anchors = c.select("conv_id", F.col("seq").alias("aid"), F.col("end").alias("a_end"))
    return P.outros(c, anchors, ["conv_id"], "aid", 30.0, 700).select("conv_id", "aid", "outro")


def span_silences(spark, sf_dir):
    """Log lines made of a user's events: signup opens a silence, click closes it, the rest is noise."""
    e = table(spark, sf_dir, "events")
    word = F.when(F.col("event_type") == "signup", "silence_start: ").when(F.col("event_type") == "click", "silence_end: ").otherwise("frame ")
    lines = e.select("user_id", F.col("event_id").alias("seq"), F.concat(F.lit("[x] "), word, F.col("event_id").cast("string")).alias("line"), F.lit(10.0).alias("offset"), F.lit(1e6).alias("window_end"))
    return P.silences(lines, KEY)


def span_marked(spark, sf_dir):
    s = segments(spark, sf_dir)
    out = P.marked(s.withColumnRenamed("event_id", "idx"), s.where("rule in ('click', 'error')").select("user_id", "start", "end"), KEY)
    return out.select(F.col("idx").alias("event_id"), "inside")


def span_matched(spark, sf_dir):
    s = segments(spark, sf_dir)
    return rounded(P.matched(s.where("rule = 'view'"), s.where("rule in ('click', 'error')"), KEY), "start", "end")


def span_excerpt(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(Rec.excerpt(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), 300)).alias("digest"))


def rec_publication_date(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    stamp = F.when(F.col("event_id") % 3 == 0, F.unix_seconds(ts)).otherwise(F.lit(0))
    day = F.when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyyMMdd")).otherwise("none")
    previous = F.when(F.col("event_id") % 2 == 0, ts).otherwise(ts - F.expr("INTERVAL 2 DAYS"))
    at = Rec.publication_date(stamp, day, previous)
    return e.select("event_id", F.unix_micros(at).alias("at_us"), Rec.day_only(at).alias("day_only"))


def rec_unavailable(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    availability = F.when(F.col("event_type") == "view", "subscriber_only").when(F.col("event_type") == "click", "private").otherwise("public")
    live = F.when(F.col("event_id") % 4 == 0, "is_upcoming").when(F.col("event_id") % 4 == 1, "is_live").otherwise("not_live")
    return e.select("event_id", Rec.unavailable(availability, live).alias("reason"), Rec.retryable((F.col("event_id") % 600).cast("int")).alias("retry"))


def rec_outcome(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    error = F.when(F.col("o_totalprice") > 300000, "x")
    out = Rec.outcome(error, F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")
    return o.groupBy(out.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def rec_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title = F.concat(F.lit("  "), F.when(F.col("page_id") % 3 == 0, "<Untitled Chapter 5>").when(F.col("page_id") % 3 == 1, "").otherwise("A  b"), F.lit(" "))
    return p.select("page_id", Rec.title_key(title).alias("key"), Rec.is_title(title).alias("ok"), Rec.is_slug(F.regexp_replace("url", "^https?://", "")).alias("slug"))


def rec_milliseconds(spark, sf_dir):
    """Exact rounding of halves: by the binary value, not the decimal one."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", Rec.milliseconds_exact(F.col("value") / 8 + 0.0005).alias("ms"))


def span_rewritten(spark, sf_dir):
    """Descriptions with a chapter line for each turn of a conversation, replaced by the turns' edited times."""
    c = cues(spark, sf_dir).withColumn("title", F.concat(F.lit("Turn "), F.col("seq")))
    from ..functions.text import clock

    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", clock(F.col("start")).alias("t"), "title"))), lambda x: F.concat(x["t"], F.lit(" - "), F.upper(x["title"]))), "\n")
    d = c.groupBy("conv_id").agg(text.alias("_t")).select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Hello\n"), "_t", F.lit("\nBye"))).otherwise(F.lit("Hello")).alias("text"))
    edited = c.select("conv_id", (F.col("start") + 1).alias("start"), "title")
    return P.rewritten(d, c.select("conv_id", F.floor("start").alias("start"), "title"), edited, ["conv_id"]).select("conv_id", F.md5("text").alias("digest"))


def cue_labelled_text(spark, sf_dir):
    s = C.raw_sentences(cues(spark, sf_dir), ["conv_id"]).withColumn("sid", F.format_string("S%03d", F.col("idx") + 1))
    return C.labelled_text(s, ["conv_id"], "sid").select("conv_id", F.md5("block").alias("digest"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("span_", "rec_", "cue_")) and callable(f)}

_CAND = """(SELECT a.event_id AS aid, s.event_id, s."start", s."end" FROM seg a JOIN seg s ON s.user_id = a.user_id AND s."end" > a."start" - 172800 AND s."start" < a."end" + 86400 WHERE a.rule = 'error')"""
_CLOCK = "format('{{:02d}}:{{:02d}}:{{:02d}}', CAST(floor({s}) AS BIGINT) // 3600, CAST(floor({s}) AS BIGINT) % 3600 // 60, CAST(floor({s}) AS BIGINT) % 60)"
ORACLES = {
    "span_candidates": f"""WITH {SEG}, c AS {_CAND},
l AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY "start" DESC, "end" DESC) AS n FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY "start", "end") AS n FROM c)
SELECT aid, event_id, CAST(row_number() OVER (PARTITION BY aid ORDER BY "start", "end") - 1 AS INTEGER) AS idx, 'L' AS side FROM l WHERE n <= 4
UNION ALL SELECT aid, event_id, CAST(n - 1 AS INTEGER), 'R' FROM r WHERE n <= 4""",
    "span_previous_text": f"WITH {CUES} SELECT conv_id, seq, md5(lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY seq)) AS digest FROM cues",
    "span_outros": f"""WITH {CUES}, a AS (SELECT conv_id, seq AS aid, "end" AS e FROM cues)
SELECT a.conv_id, aid, coalesce(sum(strlen(c.text)) + count(c.seq) - 1, 0) < 700 AS outro FROM a LEFT JOIN cues c ON c.conv_id = a.conv_id AND c."end" > e AND c."start" < e + 30 GROUP BY a.conv_id, aid""",
    "span_silences": """WITH m AS (SELECT user_id, event_id, event_type AS k, event_id + 10e0 AS t, lead(event_type) OVER w AS nk, lead(event_id) OVER w + 10e0 AS nt FROM events WHERE event_type IN ('signup', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, t AS "start", coalesce(nt, 1e6) AS "end" FROM m WHERE k = 'signup' AND (nk IS NULL OR nk = 'click')""",
    "span_marked": f"""WITH {SEG} SELECT event_id, EXISTS (SELECT 1 FROM seg r WHERE r.user_id = s.user_id AND r.rule IN ('click', 'error') AND s."start" >= r."start" AND s."start" < r."end") AS inside FROM seg s""",
    "span_matched": f"""WITH {SEG}, l AS (SELECT * FROM seg WHERE rule = 'view'), r AS (SELECT * FROM seg WHERE rule IN ('click', 'error')), p AS (SELECT l.event_id AS a, r.event_id AS b FROM l JOIN r ON l.user_id = r.user_id AND l."end" > r."start" AND l."start" < r."end")
SELECT user_id, round("start", 6) AS "start", round("end", 6) AS "end", CASE WHEN event_id IN (SELECT a FROM p) THEN 'both' ELSE 'new' END AS side FROM l
UNION ALL SELECT user_id, round("start", 6), round("end", 6), 'old' FROM r WHERE event_id NOT IN (SELECT b FROM p)""",
    "span_excerpt": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 300) || '...' END) AS digest FROM t""",
    "rec_publication_date": """WITH p AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 2 DAY END AS prev, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) END AS d FROM events),
a AS (SELECT event_id, CASE WHEN d IS NULL OR (event_id % 3 = 1 AND d = date_trunc('day', prev)) THEN prev ELSE d END AS at_ FROM p)
SELECT event_id, epoch_us(at_) AS at_us, at_ = date_trunc('day', at_) AS day_only FROM a""",
    "rec_unavailable": """SELECT event_id, CASE WHEN event_type = 'view' THEN 'members-only' WHEN event_type = 'click' THEN 'private' WHEN event_id % 4 = 0 THEN 'upcoming' WHEN event_id % 4 = 1 THEN 'live now' END AS reason,
event_id % 600 IN (0, 408, 429) OR event_id % 600 >= 500 AS retry FROM events""",
    "rec_outcome": """SELECT CASE WHEN o_totalprice > 300000 THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'O' THEN 'rendered' ELSE 'waiting' END AS status, count(*) AS n FROM orders GROUP BY 1""",
    "rec_titles": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<untitled chapter 5>' WHEN 1 THEN '' ELSE 'a b' END AS key, page_id % 3 = 2 AS ok, false AS slug FROM pages""",
    "rec_milliseconds": "SELECT event_id, CAST(printf('%.3f', value / 8 + 0.0005e0) AS DOUBLE) AS ms FROM events",
    "cue_labelled_text": f"""WITH {CUES}, {_PIECES.format(key="conv_id", src="cues")}, {_RAW} SELECT conv_id, md5(string_agg('[' || format('S{{:03d}}', idx + 1) || '] ' || text || chr(10), '' ORDER BY idx)) AS digest FROM raw GROUP BY conv_id""",
    "span_rewritten": f"""WITH {CUES}, t AS (SELECT conv_id, seq, "start" AS s, 'Turn ' || seq AS title FROM cues), n AS (SELECT conv_id, string_agg({_CLOCK.format(s="s + 1")} || ' ' || title, chr(10) ORDER BY seq) AS l FROM t GROUP BY conv_id)
SELECT conv_id, md5(CASE WHEN conv_id % 2 = 0 THEN 'Hello' || chr(10) || l || chr(10) || 'Bye' ELSE 'Hello' || chr(10) || chr(10) || 'Chapters' || chr(10) || l END) AS digest FROM n""",
}
