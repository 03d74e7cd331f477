"""Captions, sentences, windows and text functions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import folds
from tidemark.functions import text as tx
from tidemark.operators import cues as C
from tidemark.sources import captions

KEY = ["k"]


def cues(spark, rows):
    return spark.createDataFrame([("a", i, float(s), float(e), t) for i, (s, e, t) in enumerate(rows)], "k string, seq int, start double, end double, text string")


VTT = """WEBVTT
Kind: captions

NOTE a note

1
00:00:00.080 --> 00:00:02.000 align:start
 
hello there &amp; <c>welcome</c>

00:00:02.000 --> 00:00:02.010
hello there &amp; welcome

00:00:02.010 --> 00:00:04.500
hello there &amp; welcome
to the show

00:05:04,500 --> 00:05:06,000
to the show again
"""


def test_vtt(spark):
    df = captions.parsed_vtt(spark.createDataFrame([("f", VTT)], "k string, value string"), KEY, "value")
    assert [(r.start, r.end, r.text) for r in df.orderBy("seq").collect()] == [(0.08, 2.0, "hello there & welcome"), (2.01, 4.5, "to the show"), (304.5, 306.0, "to the show again")]


@pytest.mark.parametrize("bad", ["00:00:02.000 --> 00:00:01.000\nx", "00:00:05.000 --> 00:00:06.000\nx\n\n00:00:01.000 --> 00:00:02.000\ny", "0:0 --> now\nx"])
def test_broken_vtt_is_an_error(bad):
    with pytest.raises(ValueError):
        C.read_vtt(bad)


def test_repeats(spark):
    def run(rows):
        df = spark.createDataFrame([("k", n, float(s), float(e), t) for n, (s, e, t) in enumerate(rows)], "k string, seq int, start double, end double, text string")
        return [(r.seq, r.text) for r in C.deduplicated(df, ["k"]).orderBy("seq").collect()]

    assert run([(0, 1, "a b"), (1, 2, "a b"), (2, 3, "a b c d"), (3, 4, "C D e")]) == [(0, "a b"), (2, "c d"), (3, "e")]
    assert run([(0, 1, "a b"), (5, 6, "a b")]) == [(0, "a b"), (1, "a b")]
    # what overlaps wholly is not said anew, and what was said before it still counts
    assert run([(0, 1, "a b c"), (1, 2, "b c"), (2, 3, "b c d")]) == [(0, "a b c"), (2, "d")]


def test_lists_of_folds(spark):
    n = 5 * folds.PAGE + 3
    state = lambda s, v: folds.appended(s, v)
    got = spark.range(1).select(F.aggregate(F.sequence(F.lit(1), F.lit(n)), folds.paged("int"), state, folds.listed).alias("x")).first().x
    assert got == list(range(1, n + 1))
    assert spark.range(1).select(folds.listed(folds.paged("int")).alias("x")).first().x == []


def test_timestamps(spark):
    values = ["01:02:03.250", "02:03.500", "00:00:01,250", "x", "1:2:3:4"]
    df = spark.createDataFrame([(v,) for v in values], "t string").select(tx.timestamp_seconds(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [3723.25, 123.5, 1.25, None, None]
    out = spark.range(1).select(tx.clock(F.lit(3723.25), True).alias("a"), tx.clock(F.lit(3723.99)).alias("b"), tx.duration_text(F.lit(59.9)).alias("c")).first()
    assert tuple(out) == ("01:02:03.250", "01:02:03", "0:00:59")


def brute_windows(rows, target=30, longest=45):
    out, cur = [], []
    for s, e, t in rows:
        cur.append((s, e, t))
        if e - cur[0][0] >= target and (e - cur[0][0] >= longest or t.rstrip()[-1:] in ".?!"):
            out.append((cur[0][0], e, len(cur)))
            cur = []
    return out + ([(cur[0][0], cur[-1][1], len(cur))] if cur else [])


def test_windows_equal_brute_force(spark):
    rng = random.Random(2)
    for _ in range(3):
        t, rows = 0.0, []
        for _ in range(40):
            d = rng.randint(1, 20)
            rows.append((t, t + d, rng.choice(["so it goes.", "and then", "why?", "well "])))
            t += d
        got = C.windows(cues(spark, rows), KEY).orderBy("idx").collect()
        assert [(r.start, r.end, len(r.cues)) for r in got] == brute_windows(rows)
        assert [r.wid for r in got[:2]] == ["W001", "W002"]


def sentences(spark, rows, shortest=12):
    return [(round(r.start, 2), round(r.end, 2), r.text) for r in C.sentences(cues(spark, rows), KEY, shortest).orderBy("idx").collect()]


def test_sentences(spark):
    assert sentences(spark, [(0, 10, "This is the first one. Right?"), (10, 12, "Then another sentence follows.")]) == [(0, 10, "This is the first one. Right?"), (10, 12, "Then another sentence follows.")]
    assert [t for *_, t in sentences(spark, [(0, 1, "So. "), (1, 5, "This one takes it in.")])] == ["So. This one takes it in."]
    assert [t for *_, t in sentences(spark, [(0, 4, "Head over to acmedoc."), (4, 8, "com/now to get started, 3.5 times.")])] == ["Head over to acmedoc.com/now to get started, 3.5 times."]
    at = sentences(spark, [(0, 4, "né à la carte. abcdefghijklm")], 1)
    assert at[0][1] == round(4 * 16 / 30, 2)  # by bytes


def test_speech_end(spark):
    df = cues(spark, [(0, 10, "hello there, friends"), (10, 60, "[Music]")])
    assert C.speech_end(df, KEY).first().speech_end == min(20 / 8 + 1.5, 10)
    assert C.speech_end(cues(spark, [(0, 5, "[Music] ")]), KEY).first().speech_end == 0


def test_clean_and_lexical(spark):
    df = spark.createDataFrame([("<b>a</b> &amp;lt; b&nbsp;&#39;c&#39;",), ("Buy at EXAMPLE.com",), (None,)], "t string")
    assert [r.t for r in df.select(tx.clean(F.col("t")).alias("t")).collect()] == ["a < b 'c'", "Buy at EXAMPLE.com", None]
    assert [r.x for r in df.select(tx.lexical(F.col("t"), ["example.COM"]).alias("x")).collect()] == [0.0, 1.0, 0.0]


def test_video_ids(spark):
    rows = ["https://www.youtube.com/watch?v=ab-DE_12345&t=1", "https://youtu.be/ab-DE_12345", "https://evil.example/watch?v=ab-DE_12345", "ab-DE_12345", "short", "https://www.youtube.com/shorts/ab-DE_12345"]
    df = spark.createDataFrame([(r,) for r in rows], "u string")
    assert [r.v for r in df.select(tx.video_id(F.col("u")).alias("v")).collect()] == ["ab-DE_12345", "ab-DE_12345", None, "ab-DE_12345", None, "ab-DE_12345"]


def test_chapter_lines(spark):
    rows = ["0:00 Intro", "Outro - 1:02:03", "[12:34] Middle part", "99:99 no", "no time"]
    df = spark.createDataFrame([(r,) for r in rows], "l string").select(tx.line_chapter(F.col("l")).alias("c"))
    assert [tuple(r.c) if r.c else None for r in df.collect()] == [(0.0, "Intro"), (3723.0, "Outro"), (754.0, "Middle part"), None, None]


def test_overlaps_split_each_text_once(spark):
    rng = random.Random(8)
    pairs = [tuple(" ".join(rng.choice("aAbc") for _ in range(rng.randint(0, 9))) for _ in "xy") for _ in range(200)] + [(None, "a"), ("a", None)]
    n = tx.overlap_suffix(F.col("x"), F.col("y"))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", n.alias("n")).collect()
    for r in got:
        if r.x is None or r.y is None:
            assert r.n is None
        else:
            a, b = r.x.lower().split(), r.y.lower().split()
            assert r.n == max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])
    assert str(n).count("split(") == 2
