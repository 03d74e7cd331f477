"""Queries of cues, sentences and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cues as C
from ..operators import long_keys as L
from .tables import CUES, cues, rounded, table

KEY = ["conv_id"]


def cue_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cues(spark, sf_dir).select("conv_id", "seq", "start", "end"), "start", "end")


def cue_slice(spark, sf_dir):
    return C.sliced(cues(spark, sf_dir), 30.0, 90.0).select("conv_id", "seq")


def cue_windows(spark, sf_dir):
    w = C.windows(cues(spark, sf_dir), KEY)
    return rounded(w.select("conv_id", "wid", "start", "end", F.length("text").cast("long").alias("chars"), F.size("cues").cast("long").alias("n")), "start", "end")


def cue_windows_sliced(spark, sf_dir):
    """Windows in slices of 8 cues, so that most windows of a conversation lie in several."""
    w = L.windows(cues(spark, sf_dir), KEY, rows=8)
    return rounded(w.select("conv_id", "wid", "start", "end", F.length("text").cast("long").alias("chars"), F.size("cues").cast("long").alias("n")), "start", "end")


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit(0).alias("seq"), F.lit(0.0).alias("start"), (F.col("n_chars") / 15.0).alias("end"), "text")


def cue_sentences_raw(spark, sf_dir):
    p = C.pieces(_documents(spark, sf_dir), ["doc_id"])
    return rounded(p.select("doc_id", F.col("part").cast("long").alias("part"), "start", "end", F.md5("text").alias("digest"), "terminal"), "start", "end")


def cue_sentences_grouped(spark, sf_dir):
    s = C.raw_sentences(cues(spark, sf_dir), KEY)
    return rounded(s.select("conv_id", "idx", "start", "end", F.md5("text").alias("digest")), "start", "end", digits=5)


def cue_sentences(spark, sf_dir):
    s = C.sentences(cues(spark, sf_dir), KEY)
    return rounded(s.select("conv_id", "sid", "start", "end", F.md5("text").alias("digest")), "start", "end", digits=5)


def cue_sentences_sliced(spark, sf_dir):
    s = L.sentences(cues(spark, sf_dir), KEY, rows=8)
    return rounded(s.select("conv_id", "sid", "start", "end", F.md5("text").alias("digest")), "start", "end", digits=5)


def _rolling(spark, sf_dir):
    """Cues that restate the last three words of the cue before, as rolling captions do."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("seq")
    tail = F.slice(F.concat(F.array(F.lit(""), F.lit(""), F.lit("")), T.words(F.lag("text").over(w))), -3, 3)
    c = cues(spark, sf_dir).withColumn("tail", F.coalesce(F.array_join(tail, " "), F.lit("")))
    return c.withColumn("text", F.trim(F.concat("tail", F.lit(" "), T.clean(F.col("text"))))).drop("tail")


def cue_dedupe(spark, sf_dir):
    return C.deduplicated(_rolling(spark, sf_dir), KEY).select("conv_id", "seq", F.md5("text").alias("digest"))


def cue_dedupe_sliced(spark, sf_dir):
    return L.deduplicated(_rolling(spark, sf_dir), KEY, rows=8).select("conv_id", "seq", F.md5("text").alias("digest"))


def cue_out_of_order(spark, sf_dir):
    c = cues(spark, sf_dir).withColumn("start", F.when(F.col("seq") % 3 == 2, F.col("start") - 60).otherwise(F.col("start")))
    return C.out_of_order(c, KEY).select("conv_id", "seq")


def txt_speech_end(spark, sf_dir):
    return rounded(C.speech_end(cues(spark, sf_dir), KEY), "speech_end")


def txt_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean(F.col("html"))).alias("digest"), F.length(T.clean(F.col("html"))).cast("long").alias("chars"))


NEEDLES = ["license", "example.com", "rights reserved", "AKIA"]


def txt_lexical(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.lexical(F.col("text"), NEEDLES).alias("lex"), T.lexical(F.col("text"), ["http", "www."]).alias("lex_url"))


def txt_url_id(spark, sf_dir):
    u = F.col("url")
    page = F.try_to_number(F.regexp_extract(F.try_parse_url(u, F.lit("PATH")), r"(\d+)$", 1), F.lit("999999999999")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.try_parse_url(u, F.lit("HOST"))).alias("host"), page.alias("number"), F.try_parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"))


def txt_video_id(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    ident = F.concat(F.lit("a-B_"), F.lpad(F.col("page_id").cast("string"), 7, "0"))
    kind = F.col("page_id") % 5
    url = (
        F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), ident))
        .when(kind == 1, F.concat(F.lit("https://youtu.be/"), ident, F.lit("?t=3")))
        .when(kind == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), ident))
        .when(kind == 3, ident)
        .otherwise(F.col("url"))
    )
    return p.select("page_id", T.video_id(url).alias("video_id"))


def txt_timestamp_parse(spark, sf_dir):
    v = F.round(F.col("value") * 1000).cast("long")
    text = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("01:")).otherwise(F.lit("")), F.lpad((v % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((v % 59).cast("string"), 2, "0"), F.lit(","), F.lpad((v % 1000).cast("string"), 3, "0"))
    return rounded(table(spark, sf_dir, "events").select("event_id", T.timestamp_seconds(text).alias("seconds")), "seconds")


def txt_time_format(spark, sf_dir):
    s = F.col("value") * 37
    return table(spark, sf_dir, "events").select("event_id", T.clock(s).alias("clock"), T.duration_text(s).alias("duration"))


def txt_normal_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(T.normal_words(F.col("text")), " ")).alias("digest"), F.size(T.normal_words(F.col("text"))).alias("n"))


def txt_overlap_suffix(spark, sf_dir):
    from pyspark.sql.window import Window

    c = _rolling(spark, sf_dir)
    return c.withColumn("n", T.overlap_suffix(F.lag("text").over(Window.partitionBy("conv_id").orderBy("seq")), F.col("text"))).select("conv_id", "seq", "n")


def txt_line_chapter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stamp = F.format_string("%d:%02d", (F.col("event_id") % 75).cast("int"), (F.col("user_id") % 70).cast("int"))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(stamp, F.lit(" - "), F.col("event_type"))).when(F.col("event_id") % 3 == 1, F.concat(F.col("event_type"), F.lit(" "), stamp)).otherwise(F.col("event_type"))
    c = T.line_chapter(line)
    return e.select("event_id", c["start"].alias("start"), c["title"].alias("title"))


def label_quote_check(spark, sf_dir):
    """For each benchmark item and each document that holds its first six words: the first place among the document's words.

    The words before a hit must be whole: both sides are joined with blanks around them.  Six-word heads are joined by equality.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(T.normal_words(F.col("text")), 1, 6), " ").alias("head"), F.size(T.normal_words(F.col("text"))).alias("n")).where("n >= 6")
    d = table(spark, sf_dir, "documents").select("doc_id", T.normal_words(F.col("text")).alias("w")).where(F.size("w") >= 6)
    # the heads are made from the words at once: a row for each place must not carry all words
    heads = F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " "))
    six = d.select("doc_id", F.posexplode(heads).alias("place", "head"))
    return six.join(b, "head").groupBy("item_id", "doc_id").agg(F.min("place").cast("long").alias("place"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("cue_", "txt_", "label_")) and callable(f)}

_DOCS = "docs AS (SELECT doc_id, text, n_chars / 15e0 AS e FROM documents)"
_PIECES = r"""p0 AS (SELECT {key}, seq, "start", "end", text, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.?!])', '\1' || chr(1), 'g'), '\.' || chr(1) || '([A-Za-z0-9])', '.\1', 'g'), '\.' || chr(1) || '([A-Za-z0-9])', '.\1', 'g'), chr(1)), lambda x: x <> '') AS ps FROM {src} WHERE strlen(text) > 0),
p1 AS (SELECT {key}, seq, "start", "end", strlen(text) AS n, unnest(ps) AS p, unnest(range(len(ps))) AS part FROM p0),
p2 AS (SELECT *, sum(strlen(p)) OVER (PARTITION BY {key}, seq ORDER BY part) AS upto FROM p1),
pieces AS (SELECT {key}, seq, part, "start" + ("end" - "start") * ((upto - strlen(p)) / n) AS "start", "start" + ("end" - "start") * (upto / n) AS "end", regexp_replace(p, '^\s+|\s+$', '', 'g') AS text, regexp_matches(p, '[.?!]\s*$') AS terminal FROM p2 WHERE regexp_replace(p, '^\s+|\s+$', '', 'g') <> '')"""
_WEB = "(com|org|net|io|co|ai|tv|fm|dev|app|gov|edu|us|uk|ly|me)"
_RAW = rf"""r1 AS (SELECT *, text LIKE '%.' AND coalesce(regexp_matches(lead(text) OVER w, '(?i)^{_WEB}\b'), false) AS dot FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY seq, part)),
r2 AS (SELECT *, coalesce(lag(dot) OVER w, false) AS glue, CASE WHEN terminal AND NOT dot THEN 1 ELSE 0 END AS ends FROM r1 WINDOW w AS (PARTITION BY conv_id ORDER BY seq, part)),
r3 AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY conv_id ORDER BY seq, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, idx ORDER BY seq, part) AS k FROM r3),
raw AS (SELECT conv_id, CAST(idx AS INTEGER) AS idx, arg_min("start", k) AS "start", arg_max("end", k) AS "end", string_agg(CASE WHEN glue OR k = 1 THEN text ELSE ' ' || text END, '' ORDER BY k) AS text FROM r4 GROUP BY conv_id, idx)"""
_C = r"""(SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '"'), '\s+', ' ', 'g')) AS c FROM pages)"""
_WORDS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), '\s+'), lambda x: x <> '')"
_ROLL = r"""wc AS (SELECT conv_id, seq, "start", "end", trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM cues),
roll AS (SELECT conv_id, seq, trim(coalesce(array_to_string(list_concat(['', '', ''], lag(w) OVER (PARTITION BY conv_id ORDER BY seq))[-3:], ' '), '') || ' ' || t) AS text FROM wc)"""

ORACLES = {
    "cue_build": f'WITH {CUES} SELECT conv_id, seq, round("start", 6) AS "start", round("end", 6) AS "end" FROM cues',
    "cue_slice": f'WITH {CUES} SELECT conv_id, seq FROM cues WHERE "end" > 30 AND "start" < 90',
    "cue_windows": rf"""WITH RECURSIVE {CUES}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS k, regexp_matches(text, '[.?!]\s*$') AS stop FROM cues),
f(conv_id, k, n, opened, closed) AS (
  SELECT conv_id, k, 0, "start", "end" - "start" >= 30 AND ("end" - "start" >= 45 OR stop) FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.k, CASE WHEN f.closed THEN f.n + 1 ELSE f.n END, CASE WHEN f.closed THEN o."start" ELSE f.opened END,
    o."end" - CASE WHEN f.closed THEN o."start" ELSE f.opened END >= 30 AND (o."end" - CASE WHEN f.closed THEN o."start" ELSE f.opened END >= 45 OR o.stop)
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1)
SELECT o.conv_id, format('W{{:03d}}', f.n + 1) AS wid, round(min("start"), 6) AS "start", round(arg_max("end", o.k), 6) AS "end", CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars, count(*) AS n FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k GROUP BY o.conv_id, f.n""",
    "cue_sentences_raw": f"""WITH {_DOCS}, src AS (SELECT doc_id, 0 AS seq, 0e0 AS "start", e AS "end", text FROM docs), {_PIECES.format(key="doc_id", src="src")}
SELECT doc_id, CAST(part AS BIGINT) AS part, round("start", 6) AS "start", round("end", 6) AS "end", md5(text) AS digest, terminal FROM pieces""",
    "cue_sentences_grouped": f"""WITH {CUES}, {_PIECES.format(key="conv_id", src="cues")}, {_RAW} SELECT conv_id, idx, round("start", 5) AS "start", round("end", 5) AS "end", md5(text) AS digest FROM raw""",
    "cue_sentences": f"""WITH RECURSIVE {CUES}, {_PIECES.format(key="conv_id", src="cues")}, {_RAW},
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS k FROM raw),
f(conv_id, k, n, s, e, t) AS (
  SELECT conv_id, k, 0, "start", "end", text FROM o WHERE k = 1
  UNION ALL SELECT o.conv_id, o.k,
    CASE WHEN strlen(f.t) >= 40 AND strlen(o.text) >= 40 THEN f.n + 1 ELSE f.n END, CASE WHEN strlen(f.t) >= 40 AND strlen(o.text) >= 40 THEN o."start" ELSE f.s END, o."end",
    CASE WHEN strlen(f.t) >= 40 AND strlen(o.text) >= 40 THEN o.text ELSE trim(f.t || ' ' || o.text) END
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1)
SELECT conv_id, format('S{{:03d}}', n + 1) AS sid, round(arg_max(s, k), 5) AS "start", round(arg_max(e, k), 5) AS "end", md5(arg_max(t, k)) AS digest FROM f GROUP BY conv_id, n""",
    "cue_dedupe": rf"""WITH RECURSIVE {CUES}, {_ROLL}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS k FROM roll),
f(conv_id, k, seq, said, fresh) AS (
  SELECT conv_id, k, seq, text, text FROM o WHERE k = 1
  UNION ALL SELECT conv_id, k, seq, CASE WHEN fresh = '' THEN said ELSE text END, fresh FROM (
    SELECT conv_id, k, seq, said, text, CASE WHEN text = said THEN '' WHEN starts_with(text, said || ' ') THEN trim(substr(text, length(said) + 1))
      ELSE trim(substr(text, length(array_to_string(b[1:list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda n: n = 0 OR a[len(a) - n + 1:] = bl[1:n]))], ' ')) + 1)) END AS fresh
    FROM (SELECT o.conv_id, o.k, o.seq, f.said, o.text, string_split(lower(f.said), ' ') AS a, string_split(o.text, ' ') AS b, string_split(lower(o.text), ' ') AS bl FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1) x) y)
SELECT conv_id, seq, md5(fresh) AS digest FROM f WHERE fresh <> ''""",
    "cue_out_of_order": f"""WITH {CUES}, s AS (SELECT conv_id, seq, CASE WHEN seq % 3 = 2 THEN "start" - 60 ELSE "start" END AS s FROM cues), l AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY seq) AS b FROM s) SELECT conv_id, seq FROM l WHERE s < b""",
    "txt_speech_end": rf"""WITH {CUES}, s AS (SELECT *, trim(regexp_replace(text, '\[[^\]]*\]', '', 'g')) AS t FROM cues)
SELECT conv_id, round(coalesce(arg_max(least("start" + length(t) / 8e0 + 1.5, "end"), seq) FILTER (WHERE t <> ''), 0), 6) AS speech_end FROM s GROUP BY conv_id""",
    "txt_clean": f"SELECT page_id, md5(c) AS digest, length(c) AS chars FROM {_C} t",
    "txt_lexical": "SELECT doc_id, CAST(" + " OR ".join(f"contains(lower(text), '{n.lower()}')" for n in NEEDLES) + " AS DOUBLE) AS lex, CAST(contains(lower(text), 'http') OR contains(lower(text), 'www.') AS DOUBLE) AS lex_url FROM documents",
    "txt_url_id": r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, TRY_CAST(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(\d+)$', 1), '') AS BIGINT) AS number, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""",
    "txt_video_id": "SELECT page_id, CASE WHEN page_id % 5 < 4 THEN 'a-B_' || lpad(CAST(page_id AS VARCHAR), 7, '0') END AS video_id FROM pages",
    "txt_timestamp_parse": "WITH v AS (SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS v FROM events) SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN 3600 ELSE 0 END + (v % 60) * 60 + v % 59 + (v % 1000) / 1000e0, 6) AS seconds FROM v",
    "txt_time_format": "WITH v AS (SELECT event_id, CAST(floor(value * 37) AS BIGINT) AS s FROM events) SELECT event_id, format('{:02d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS clock, format('{:d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS duration FROM v",
    "txt_normal_words": f"SELECT conv_id, turn, md5(array_to_string({_WORDS}, ' ')) AS digest, CAST(len({_WORDS}) AS INTEGER) AS n FROM conversations",
    "txt_overlap_suffix": rf"""WITH {CUES}, {_ROLL}, p AS (SELECT conv_id, seq, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS b, list_filter(string_split(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY seq)), ' '), lambda x: x <> '') AS a FROM roll)
SELECT conv_id, seq, CASE WHEN a IS NOT NULL THEN CAST(list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda k: k = 0 OR a[len(a) - k + 1:] = b[1:k])) AS INTEGER) END AS n FROM p""",
    "txt_line_chapter": """SELECT event_id, CASE WHEN ok THEN CAST((event_id % 75) * 60 + user_id % 70 AS DOUBLE) END AS "start", CASE WHEN ok THEN event_type END AS title
FROM (SELECT *, event_id % 3 < 2 AND event_id % 75 < 60 AND user_id % 70 < 60 AS ok FROM events) t""",
    "label_quote_check": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i:i + 5], ' ') AS head FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d) t)
SELECT item_id, doc_id, min(place) AS place FROM s JOIN (SELECT item_id, array_to_string(w[1:6], ' ') AS head FROM b WHERE len(w) >= 6) b USING (head) GROUP BY item_id, doc_id""",
}
ORACLES |= {f"{name}_sliced": ORACLES[name] for name in ("cue_windows", "cue_sentences", "cue_dedupe")}
