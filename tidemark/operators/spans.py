"""Candidates and context around anchors, silences, marks, and matching of segment lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import records as Rec
from ..functions import text as T
from ..options import DEFAULTS
from .intervals import Keys, overlapping


def candidates(sentences: DataFrame, anchors: DataFrame, keys: Keys, anchor: str, side: str, cap: int = DEFAULTS.candidate_cap) -> DataFrame:
    """Sentences that overlap each anchor's search span (keys, anchor, a_start, a_end), the `cap` nearest the anchor:
    the last ones for side L, the first for side R.  Places keep their order: idx from 0."""
    near = sentences.join(anchors, keys).where((F.col("end") > F.col("a_start")) & (F.col("start") < F.col("a_end")))
    per = Window.partitionBy(*keys, anchor)
    order = per.orderBy(F.desc("start"), F.desc("end")) if side == "L" else per.orderBy("start", "end")
    kept = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
    return kept.withColumn("idx", F.row_number().over(per.orderBy("start", "end")) - 1).drop("_n", "a_start", "a_end")


def reversed_ids(rows: DataFrame, keys: Keys, prefix: str) -> DataFrame:
    """rows (keys, idx) with `sid`, ids whose order runs against idx: the last is 001.  For finding out what hangs on the order of ids."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("sid", F.format_string(f"{prefix}%03d", n - F.row_number().over(Window.partitionBy(*keys).orderBy("idx")) + 1))


def previous_text(rows: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Each row with the text before it: `before`, empty for the first."""
    return rows.withColumn("before", F.lag("text", 1, "").over(Window.partitionBy(*keys).orderBy(order)))


def outros(cues: DataFrame, anchors: DataFrame, keys: Keys, anchor: str, span: float = 120.0, narration: int = 400) -> DataFrame:
    """Anchors (keys, anchor, a_end) with `outro`: little is said, in bytes, in the `span` seconds after them."""
    hit = cues.join(anchors, keys).where((F.col("end") > F.col("a_end")) & (F.col("start") < F.col("a_end") + span))
    said = hit.groupBy(*keys, anchor).agg((F.sum(F.octet_length("text")) + F.count(F.lit(1)) - 1).alias("_b"))
    return anchors.join(said, [*keys, anchor], "left").withColumn("outro", F.coalesce("_b", F.lit(0)) < narration).drop("_b")


def silences(lines: DataFrame, keys: Keys) -> DataFrame:
    """(keys, start, end) of a detector's log lines (keys, seq, line, offset, window_end): a start line and the next end line
    make one, a start without an end runs to the window's end, an end without a start is none."""
    value = lambda word: F.regexp_extract("line", rf"silence_{word}: (-?[0-9.]+)", 1)
    marks = lines.withColumn("_s", value("start")).withColumn("_e", value("end"))
    kind = F.when(F.col("_s") != "", "s").when(F.col("_e") != "", "e")
    marks = marks.withColumn("_k", kind).where("_k is not null").withColumn("_t", F.when(F.col("_k") == "s", F.col("_s")).otherwise(F.col("_e")).cast("double") + F.col("offset"))
    w = Window.partitionBy(*keys).orderBy("seq")
    # of starts in a row the last counts: it is the one that an end follows
    nxt = marks.withColumn("_nk", F.lead("_k").over(w)).withColumn("_nt", F.lead("_t").over(w))
    open_ = (F.col("_k") == "s") & (F.col("_nk").isNull() | (F.col("_nk") == "e"))
    return nxt.where(open_).select(*keys, F.col("_t").alias("start"), F.coalesce("_nt", "window_end").alias("end"))


def marked(sentences: DataFrame, spans: DataFrame, keys: Keys) -> DataFrame:
    """Sentences with `inside`: one of the spans holds their start."""
    s = spans.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = sentences.join(s, keys).where((F.col("start") >= F.col("_a")) & (F.col("start") < F.col("_b"))).select(*keys, "idx").distinct().withColumn("_h", F.lit(True))
    return sentences.join(hit, [*keys, "idx"], "left").withColumn("inside", F.coalesce("_h", F.lit(False))).drop("_h")


def matched(new: DataFrame, old: DataFrame, keys: Keys) -> DataFrame:
    """New segments against old: (keys, start, end, side) with side both, new or old, by whether any overlaps."""
    a, b = new.select(*keys, "start", "end"), old.select(*keys, "start", "end")
    both = overlapping(a, b, keys, "left_semi").withColumn("side", F.lit("both"))
    return both.unionByName(overlapping(a, b, keys, "left_anti").withColumn("side", F.lit("new"))).unionByName(overlapping(b, a, keys, "left_anti").withColumn("side", F.lit("old")))


def rewritten(descriptions: DataFrame, source: DataFrame, edited: DataFrame, keys: Keys, near: float = 0.5) -> DataFrame:
    """(keys, text): descriptions (keys, text) whose chapter lines give way to the edited chapters.

    A line is a chapter line if a source chapter (keys, start, title) within `near` seconds has its title.  The first such line
    becomes all edited chapters (keys, start, title), the others go; without one they are appended under a heading.
    """
    newline = F.when(F.contains("text", F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))
    lines = descriptions.withColumn("_nl", newline).select(*keys, "_nl", F.posexplode(F.split("text", r"\r\n|\n")).alias("_i", "_line"))
    lines = lines.withColumn("_c", T.line_chapter(F.col("_line")))
    known = source.select(*keys, F.col("start").alias("_s"), Rec.title_key(F.col("title")).alias("_t"))
    fits = lines.where("_c is not null").select(*keys, "_i", F.col("_c.start").alias("_x"), Rec.title_key(F.col("_c.title")).alias("_t")).join(known, [*keys, "_t"])
    fits = fits.where(F.abs(F.col("_s") - F.col("_x")) <= near).select(*keys, "_i").distinct().withColumn("_hit", F.lit(True))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "title"))), lambda c: F.concat(T.clock(c["start"]), F.lit(" "), c["title"]))
    lists = edited.groupBy(*keys).agg(listed.alias("_list"))
    x = lines.join(fits, [*keys, "_i"], "left").withColumn("_first", F.min(F.when(F.col("_hit"), F.col("_i"))).over(Window.partitionBy(*keys)))
    x = x.where(F.col("_hit").isNull() | (F.col("_i") == F.col("_first"))).groupBy(*keys, "_nl").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_line", F.col("_hit").isNotNull().alias("_hit")))).alias("_lines"), F.max("_first").alias("_first")
    )
    x = x.join(lists, keys, "left").withColumn("_list", F.coalesce("_list", F.array().cast("array<string>")))
    body = F.array_join(F.flatten(F.transform("_lines", lambda r: F.when(r["_hit"], F.col("_list")).otherwise(F.array(r["_line"])))), "\u0001")
    appended = F.concat(body, F.when(body != "", "\u0001\u0001").otherwise(""), F.lit("Chapters\u0001"), F.array_join("_list", "\u0001"))
    text = F.when(F.col("_first").isNull() & (F.size("_list") > 0), appended).otherwise(body)
    return x.select(*keys, F.replace(text, F.lit("\u0001"), F.col("_nl")).alias("text"))
