"""Candidates, silences, matching, rewritten descriptions, dates and states."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import records as rec
from tidemark.operators import spans

KEY = ["k"]


def test_silences(spark):
    rows = ["silence_end: 1.0", "silence_start: 2.5", "noise", "silence_end: 3.5 | silence_duration: 1", "silence_start: 4", "silence_start: 5", "silence_end: 6", "silence_start: 8"]
    df = spark.createDataFrame([("a", i, f"[silencedetect @ 0x1] {r}", 10.0, 20.0) for i, r in enumerate(rows)], "k string, seq int, line string, offset double, window_end double")
    assert sorted((r.start, r.end) for r in spans.silences(df, KEY).collect()) == [(12.5, 13.5), (15.0, 16.0), (18.0, 20.0)]


def test_candidates_nearest_the_anchor(spark):
    s = spark.createDataFrame([("a", float(i), i + 1.0) for i in range(10)], "k string, start double, end double")
    a = spark.createDataFrame([("a", 1, 2.5, 7.0)], "k string, aid int, a_start double, a_end double")
    left = spans.candidates(s, a, KEY, "aid", "L", 2).orderBy("idx").collect()
    right = spans.candidates(s, a, KEY, "aid", "R", 2).orderBy("idx").collect()
    assert [(r.start, r.idx) for r in left] == [(5, 0), (6, 1)] and [(r.start, r.idx) for r in right] == [(2, 0), (3, 1)]


def test_rewritten_description(spark):
    source = spark.createDataFrame([("a", 0.0, "Intro"), ("a", 60.0, "The  Middle")], "k string, start double, title string")
    edited = spark.createDataFrame([("a", 0.0, "Intro"), ("a", 45.5, "The Middle")], "k string, start double, title string")
    text = lambda t: spans.rewritten(spark.createDataFrame([("a", t)], "k string, text string"), source, edited, KEY).first().text
    assert text("Hi\r\n0:00 Intro\r\n1:00 the middle\r\n1:00 other\r\nBye") == "Hi\r\n00:00:00 Intro\r\n00:00:45 The Middle\r\n1:00 other\r\nBye"
    assert text("Hi") == "Hi\n\nChapters\n00:00:00 Intro\n00:00:45 The Middle"
    none = spans.rewritten(spark.createDataFrame([("b", "1:00 x")], "k string, text string"), source, edited, KEY).first()
    assert none.text == "1:00 x"


def test_matching(spark):
    f = lambda rows: spark.createDataFrame([("a", *r) for r in rows], "k string, start double, end double")
    got = {(r.start, r.side) for r in spans.matched(f([(0.0, 5.0), (20.0, 30.0)]), f([(4.0, 6.0), (50.0, 60.0)]), KEY).collect()}
    assert got == {(0.0, "both"), (20.0, "new"), (50.0, "old")}


def test_dates(spark):
    noon = dt.datetime(2024, 5, 1, 12)
    rows = [(1714564800, "20240501", noon), (0, "20240501", noon), (0, "20240502", noon), (0, "bad", noon), (None, None, None)]
    df = spark.createDataFrame(rows, "t long, d string, p timestamp").select(rec.publication_date(F.col("t"), F.col("d"), F.col("p")).alias("x"))
    assert [r.x for r in df.collect()] == [noon, noon, dt.datetime(2024, 5, 2), noon, None]


def test_exact_texts(spark):
    df = spark.createDataFrame([(1.0005, "a&amp;b &eacute;"), (None, None)], "v double, t string")
    got = df.select(rec.milliseconds_exact(F.col("v")).alias("m"), rec.unescaped(F.col("t")).alias("u")).collect()
    assert [tuple(r) for r in got] == [(1.0, "a&b é"), (None, None)]
    cut = spark.createDataFrame([(" ééé ",), ("abc",)], "t string").select(rec.excerpt(F.col("t"), 3).alias("e")).collect()
    assert [r.e for r in cut] == ["é...", "abc"]
