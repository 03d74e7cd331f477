"""Feeds that are read back, and those that are refused; pages; captions written and read; reversed ids."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import spans
from tidemark.sources import captions, sinks

ITEM = (
    "<item><title>A &amp; b</title><guid>g1</guid><description>d &lt;x&gt;</description><pubDate>Wed, 01 May 2024 12:00:00 +0200</pubDate>"
    '<enclosure url="https://x.example/1" length="10" type="audio/x-m4a"/><itunes:duration>{duration}</itunes:duration><itunes:image href="https://x.example/i"/>'
    '<podcast:chapters url="https://x.example/c.json" type="application/json+chapters"/><psc:chapters version="1.2">{chapters}</psc:chapters></item>'
)
HEAD = "<title>Show</title><link>https://x.example/f</link><description>about</description><language>en-us</language><itunes:category text='Arts'/><itunes:image href='https://x.example/p'/><atom:link href='https://x.example/f' rel='self'/>"


def rss(body, channels=1):
    spaces = " ".join(f'xmlns:{n}="{u}"' for n, u in sinks.NAMESPACES)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" {spaces}>' + f"<channel>{HEAD}{body}</channel>" * channels + "</rss>"


def parsed(spark, *texts):
    return captions.parsed_feeds(spark.createDataFrame(list(enumerate(texts)), "k int, xml string"), ["k"], "xml")


def test_feeds_with_all_fields(spark):
    chapters = '<psc:chapter start="00:00:00.000" title="Intro"/><psc:chapter start="01:00:01.500" title="B &quot;c&quot;"/>'
    feeds = parsed(spark, rss(ITEM.format(duration="1:02:03", chapters=chapters) + ITEM.format(duration="02:03", chapters="").replace("g1", "g2")), rss(""))
    assert [tuple(r) for r in captions.feed_channels(feeds, ["k"]).orderBy("k").collect()] == [(k, "Show", "about", "en-us", "Arts", "https://x.example/p") for k in (0, 1)]
    rows = captions.feed_entries(feeds, ["k"]).orderBy("k", "prior").collect()
    assert [(r.k, r.prior, r.guid, r.title, r.description, r.bytes, r.seconds) for r in rows] == [(0, 0, "g1", "A & b", "d <x>", 10, 3723.0), (0, 1, "g2", "A & b", "d <x>", 10, 123.0)]
    assert rows[0].published_at == dt.datetime(2024, 5, 1, 10) and rows[0].image == "https://x.example/i" and rows[0].chapters_url == "https://x.example/c.json"
    assert [tuple(c) for c in rows[0].chapters] == [(0.0, "Intro"), (3601.5, 'B "c"')] and rows[1].chapters == []


@pytest.mark.parametrize(
    ("text", "said"),
    [
        (rss("", channels=2), "one channel"), (rss("", channels=0), "one channel"), ("<html><channel/></html>", "one channel"), ("<rss><channel>", None),
        (rss(ITEM.format(duration="1:2:3:4", chapters="")), "duration"), (rss(ITEM.format(duration="x", chapters="")), "duration"),
        (rss(ITEM.format(duration="5", chapters='<psc:chapter start="00:10" title="t"/>')), "chapter start"),
        (rss(ITEM.format(duration="5", chapters="").replace("01 May", "41 May")), "publication date"), (rss(ITEM.format(duration="5", chapters="").replace('length="10"', 'length="ten"')), "enclosure length"),
    ],
)
def test_feeds_that_are_refused(spark, text, said):
    with pytest.raises(Exception, match=said):
        captions.feed_entries(parsed(spark, text), ["k"]).collect()


def test_subscription_page(spark):
    page = sinks.subscription_page(spark.createDataFrame([(1, "B & c", "https://x.example/f?a=1&b"), (2, "A", "https://y.example/")], "k int, title string, url string"), "k").first().html
    assert page.index("<b>A</b>") < page.index("<b>B &amp; c</b>")
    assert 'subscribe?url=https%3A%2F%2Fx.example%2Ff%3Fa%3D1%26b"' in page and 'href="https://x.example/f?a=1&amp;b"' in page and "feeds.opml" in page


def test_captions_written_are_read(spark):
    cues = spark.createDataFrame([("a", 3, 0.0, 1.25, "one  <b>two</b>"), ("a", 7, 2.5, 3601.5, "three\nfour &amp; five")], "k string, seq int, start double, end double, text string")
    read = captions.parsed_vtt(sinks.vtt(cues, ["k"]), ["k"], "vtt").orderBy("seq")
    assert [tuple(r) for r in read.collect()] == [("a", 0, 0.0, 1.25, "one two"), ("a", 1, 2.5, 3601.5, "three four & five")]


def test_ids_that_run_backwards(spark):
    rows = spark.range(12).select((F.col("id") % 2).alias("k"), F.col("id").alias("idx"))
    got = {(r.k, r.idx): r.sid for r in spans.reversed_ids(rows, ["k"], "L").collect()}
    assert got[(0, 0)] == "L006" and got[(0, 10)] == "L001" and got[(1, 1)] == "L006" and len(set(got.values())) == 6


def test_a_feed_is_parsed_once(spark, tmp_path):
    path = str(tmp_path / "feeds")
    spark.createDataFrame([("a", rss("")), ("b", rss(""))], "channel string, xml string").write.parquet(path)
    files = spark.read.parquet(path).select("channel", F.concat("xml", F.lit(" ")).alias("xml"))
    entries = captions.feed_entries(captions.parsed_feeds(files, ["channel"], "xml"), ["channel"])
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_xml") == 1
    assert entries.count() == 0  # feeds without items have no entries
