"""Catalogue, usage, chapters, evidence, sinks, fits, sessions, and the registered queries."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, chapters, evidence, scoring, usage
from tidemark.plans import fitting
from tidemark.sources import captions, sinks
from tidemark.streaming import sessions


def test_exact_order_follows_listing_in_a_timed_day(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [("c", "a", day + dt.timedelta(hours=8), 0, 0), ("c", "b", day + dt.timedelta(hours=18), 1, 1), ("c", "d", day - dt.timedelta(days=1), None, 2)]
    df = spark.createDataFrame(rows, "k string, id string, published_at timestamp, listing int, prior int")
    assert [r.id for r in catalog.ordered_items_exact(df, ["k"]).orderBy("place").collect()] == ["a", "b", "d"]
    dateless = [("c", "a", day, None, 0), ("c", "b", day + dt.timedelta(hours=3), 5, 1), ("c", "d", day, 2, 2)]
    df = spark.createDataFrame(dateless, "k string, id string, published_at timestamp, listing int, prior int")
    for form in (catalog.ordered_items, catalog.ordered_items_exact):
        assert [r.id for r in form(df, ["k"]).orderBy("place").collect()] == ["d", "b", "a"]


def test_usage_interval_drops_what_did_not_change(spark):
    fields = "k string, rate string, calls long, input long, output long, missing long, unpriced long, reported long, cost double"
    now = spark.createDataFrame([("a", "x", 3, 10, 1, 0, 0, 0, 2.0), ("a", "y", 1, 5, 0, 0, 0, 0, 1.0), ("a", "z", 1, 0, 0, 1, 0, 0, 0.0)], fields)
    then = spark.createDataFrame([("a", "x", 1, 4, 1, 0, 0, 0, 0.5), ("a", "y", 1, 5, 0, 0, 0, 0, 1.0)], fields)
    got = {r.rate: (r.calls, r.input, r.cost) for r in usage.interval(now, then, ["k"]).collect()}
    assert got == {"x": (2, 6, 1.5), "z": (1, 0, 0.0)}


def test_calls_meet_the_price_list_where_they_are(spark, capsys):
    """Dealt by rate, all calls of a rate would be one task's."""
    calls = spark.createDataFrame([("a", "x", 3, 1, False, None), ("a", "x", 1, 1, True, 2.0), ("b", None, 5, 5, False, None)], "k string, rate string, input long, output long, missing_usage boolean, reported_cost double")
    rates = spark.createDataFrame([("x", 1e6, 2e6)], "rate string, input_price double, output_price double")
    seen = usage.observe(calls, rates, ["k"])
    assert sorted(tuple(r) for r in seen.where("k = 'a'").collect()) == [("a", "x", 2, 3, 1, 1, 0, 1, 5.0)]
    assert [tuple(r) for r in seen.where("k = 'b'").collect()] == [("b", None, 1, 5, 5, 0, 1, 0, 0.0)]
    seen.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "hashpartitioning(rate" not in plan


def test_chapters_through_cuts(spark):
    keeps = spark.createDataFrame([("a", 0.0, 600.0), ("a", 720.0, 1800.0)], "k string, start double, end double")
    source = spark.createDataFrame([("a", 0, 0.0, None, "Intro"), ("a", 1, 600.0, None, "Ad ends"), ("a", 2, 610.0, 700.0, "Gone"), ("a", 3, 900.0, None, "Rest"), ("a", 4, 1700.0, None, "<Untitled Chapter 5>")], "k string, seq int, start double, end double, title string")
    eps = spark.createDataFrame([("a", 1800.0, 1679.95)], "k string, source_duration double, duration double")
    got = [(r.start, r.title) for r in chapters.derive(source, keeps, eps, ["k"], 0.05).orderBy("start").collect()]
    assert got == [(0.0, "Intro"), (779.95, "Rest")]
    document = json.loads(chapters.chapter_json(spark.createDataFrame([("a", s, t) for s, t in got], "k string, start double, title string"), ["k"]).first().json)
    assert document == {"version": "1.2.0", "chapters": [{"startTime": 0.0, "title": "Intro"}, {"startTime": 779.95, "title": "Rest"}]}
    edited = spark.createDataFrame([("a", 1000.0)], "k string, duration double")
    assert chapters.timeline_problems(keeps, ["k"], 0.05, edited).first().problem == "length"


def test_replay(spark):
    asked = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3), ("p", 4)], "key string, n int")
    known = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.7)], "key string, n int, answer double")
    out = evidence.replayed(asked, known, ["key"], "n", "answer").orderBy("n").collect()
    assert [(r.answer, r.found) for r in out] == [(0.5, True), (0.7, True), (None, False), (None, False)]
    a, b = (spark.range(1).select(evidence.key(F.lit("ask"), F.lit("s"), F.array(*map(F.lit, q))).alias("k")).first().k for q in (["x", "y"], ["y", "x"]))
    assert a == b


def test_answers(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.5},), ({"a": 1.5, "b": -0.5},), ({"a": 0.5},), ({"a": 0.5, "b": 0.3},)], "p map<string,double>")
    assert [r.x for r in df.select(scoring.answer_problem(F.col("p"), ["a", "b"]).alias("x")).collect()] == [None, "range", "keys", "sum"]
    problem = scoring.answer_problem(F.col("p"), ["a", "b"])
    with pytest.raises(ValueError, match=r"keys \(1\), range \(1\), sum \(1\)"):
        scoring.checked(df, problem)
    for name, where in (("range", "p['a'] > 1"), ("keys", "size(p) = 1"), ("sum", "p['b'] = 0.3D")):
        with pytest.raises(ValueError, match=rf"problems: {name} \(1\)$"):
            scoring.checked(df.where(where), problem)
    assert scoring.checked(df.where("p['a'] = 0.5D and p['b'] = 0.5D"), problem).count() == 1
    rule, total = scoring.scan_rule(F.col("p"), ["b", "a"])
    assert [tuple(r) for r in df.limit(1).select(rule, total).collect()] == [("b", 1.0)]


def test_feed_round_trip(spark, tmp_path):
    feeds = spark.createDataFrame([("c", "A & B", "https://x.example/", "d")], "k string, title string, link string, description string")
    items = spark.createDataFrame([("c", 1, "g1", "One <1>", dt.datetime(2024, 5, 1, 12), "https://x.example/1?a&b", 10, 3723.0)], "k string, place int, guid string, title string, published_at timestamp, url string, bytes long, seconds double")
    xml = sinks.feed_xml(feeds, items, "k").first().xml
    (tmp_path / "f.xml").write_text(xml)
    r = captions.feed_items(spark, str(tmp_path / "f.xml")).first()
    assert (r.guid, r.title, r.url, r.bytes, r.seconds) == ("g1", "One <1>", "https://x.example/1?a&b", 10, 3723.0)
    assert r.published_at == dt.datetime(2024, 5, 1, 12)
    assert "A &amp; B" in sinks.opml(feeds.withColumn("url", F.col("link")), "k").first().opml


def test_labels_and_records(spark, tmp_path):
    for v, c in (("v1", "c1"), ("v2", "c2")):
        (tmp_path / f"{v}.json").write_text(json.dumps({"video_id": v, "channel": c, "title": "t", "duration": 100, "segments": [{"category": "sponsor", "start": 1, "end": 2.5, "borderline": False}]}))
    labels = captions.labels(spark, str(tmp_path / "*.json"))
    assert sorted((r.video_id, r.start, r.end) for r in captions.label_segments(labels).collect()) == [("v1", 1.0, 2.5), ("v2", 1.0, 2.5)]
    assert [r.video_id for r in captions.selected(labels, ["c2"]).collect()] == ["v2"]
    with pytest.raises(ValueError):
        captions.selected(labels, ["nobody"])
    assert [r.video_id for r in captions.missing(labels, labels.where("channel = 'c1'"), ["video_id"]).collect()] == ["v2"]
    at = tmp_path / "records/c1/v9"
    at.mkdir(parents=True)
    (at / "render.m4a.json").write_text(json.dumps({"channel": "c1", "video_id": "other"}))
    with pytest.raises(Exception, match="not its path"):
        captions.records(spark, str(tmp_path / "records"), "channel string, video_id string").collect()
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        captions.labels(spark, str(tmp_path / "bad.json")).collect()


def test_fit_equals_newton(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(200, 3)
    y = (x @ [1.0, -2.0, 0.5] + rng.randn(200) > 0.3).astype(float)
    rows = spark.createDataFrame([(*map(float, a), int(b), i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y int, g int")
    weight = np.where(y == 0, 3.0, 1.0)
    design = np.column_stack([x, np.ones(200)])
    beta, ridge = np.zeros(4), np.diag([1.0, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        beta -= np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge, design.T @ (weight * (p - y)) + ridge @ beta)
    model = fitting.fit(rows, ["a", "b", "c"], "y", 1.0, 3.0)
    assert np.allclose([*model.coefficients, model.intercept], beta, atol=1e-5)
    assert fitting.leave_group_out(rows, ["a", "b", "c"], "y", "g").count() == 200


def test_sessions_on_a_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(u, base + dt.timedelta(minutes=m)) for u, m in ((1, 0), (1, 10), (1, 50), (2, 5), (9, 10_000))]
    spark.createDataFrame(rows, "u int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp").parquet(str(tmp_path / "in"))
    q = sessions.run_once(sessions.sessions(stream, "u", "ts", "20 minutes", "1 hour"), "parquet", str(tmp_path / "ck"), str(tmp_path / "out"))
    assert q.awaitTermination(90) or not q.isActive
    got = sorted((r.u, r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, base, 2), (1, base + dt.timedelta(minutes=50), 1), (2, base + dt.timedelta(minutes=5), 1)]


def test_latest_state_and_upsert(spark):
    e = spark.createDataFrame([("a", 1, "published"), ("a", 2, "pending"), ("b", 1, "waiting")], "k string, v int, stage string")
    assert sorted(tuple(r) for r in catalog.latest_state(e, ["k"], "v").collect()) == [("a", 2, "pending", True), ("b", 1, "waiting", False)]
    new = spark.createDataFrame([("a", 2, "rendered"), ("c", 0, "pending")], "k string, v int, stage string")
    assert sorted((r.k, r.stage) for r in catalog.upsert(e.where("v = 2 or k = 'b'"), new, ["k"], "v").collect()) == [("a", "rendered"), ("b", "waiting"), ("c", "pending")]


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
