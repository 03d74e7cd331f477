"""Exact feed order, joined sides, retention actions, quotes by index, and states on a stream."""

import datetime as dt
import functools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, cues
from tidemark.functions import text as T
from tidemark.streaming import states


def plain_order(items):
    """By pairs: a day's listed items as listed, a dateless day's others after them as they were, all else by time."""
    rows = sorted(items, key=lambda x: x["prior"])
    dateless = {x["at"].date() for x in rows if x["at"].time() == dt.time()}

    def compare(a, b):
        if a["at"].date() == b["at"].date():
            if a["listing"] is not None and b["listing"] is not None:
                return a["listing"] - b["listing"]
            if a["at"].date() in dateless:
                return (a["listing"] is None) - (b["listing"] is None)
        return (a["at"] < b["at"]) - (a["at"] > b["at"])

    return [x["id"] for x in sorted(rows, key=functools.cmp_to_key(compare))]


@pytest.mark.parametrize("seed", range(3))
def test_exact_order_equals_pairs_where_pairs_agree(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for k in range(12):
        items = []
        for i in range(rng.randint(1, 14)):
            at = dt.datetime(2024, 5, rng.randint(1, 3), *(rng.choice([(0, 0), (9, 0), (9, 30), (17, 5), (21, 0)]) if k % 3 else rng.choice([(8, 0), (12, 0), (20, 0)])))
            items.append({"id": f"{k}-{i}", "at": at, "listing": None, "prior": i})
        # what is listed stands in the order of its times, so all pairs agree
        listed = rng.sample(items, rng.randint(0, len(items)))
        for n, x in enumerate(sorted(listed, key=lambda x: (-x["at"].timestamp(), x["prior"]))):
            x["listing"] = n
        want[k] = plain_order(items)
        rows += [(k, x["id"], x["at"], x["listing"], x["prior"]) for x in items]
    rng.shuffle(rows)
    out = catalog.ordered_items_exact(spark.createDataFrame(rows, "k int, id string, published_at timestamp, listing int, prior int"), ["k"])
    got = {}
    for r in out.orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.id)
    assert got == want


def test_joined_sides_keep_columns_of_one_name_apart(spark):
    a = spark.createDataFrame([(1, "old title"), (2, "x")], "id int, title string")
    b = spark.createDataFrame([(1, "a newer title"), (3, "y")], "id int, title string")
    got = {r.id: (r.feed_title, r.state_title, r.in_feed, r.in_state) for r in catalog.joined({"feed": a, "state": b}, ["id"]).collect()}
    assert got == {1: ("old title", "a newer title", True, True), 2: ("x", None, True, False), 3: (None, "y", False, True)}


def test_retention_actions(spark):
    day = lambda n: dt.datetime(2024, 5, n, 12)
    fields = "c string, id string, published_at timestamp, listing int, prior int"
    feed = spark.createDataFrame([("a", "i1", day(9), None, 0), ("a", "i2", day(8), None, 1), ("a", "i3", day(7), None, 2), ("a", "i4", day(6), None, 3), ("b", "p1", day(1), None, 0)], fields)
    new = spark.createDataFrame([("a", "n1", day(10), 0, 9), ("a", "n2", day(5), 1, 10), ("b", "n3", day(9), 0, 9)], fields)
    known = spark.createDataFrame([("a", "i2", "excluded", True), ("a", "old", "pruned", True), ("b", "s1", "", False)], "c string, id string, removal string, delete_pending boolean")
    limits = spark.createDataFrame([("a", 2, False), ("b", 5, True)], "c string, keep int, purge boolean")
    got = {(r.c, r.id): (r.place, r.action) for r in catalog.retention_actions(feed, known, new, limits, ["c"], "id").collect()}
    assert got == {
        ("a", "i1"): (0, "keep"), ("a", "i3"): (1, "keep"), ("a", "i4"): (2, "prune"), ("a", "n1"): (0, "admit"), ("a", "n2"): (3, "reject"),
        ("a", "i2"): (None, "finish"), ("a", "old"): (None, "finish"), ("b", "p1"): (0, "exclude"), ("b", "n3"): (0, "reject"), ("b", "s1"): (None, "exclude"),
    }


def test_timings_of_all_forms():
    text = "00:01.5 --> 00:03.25\nshort\n\n00:04,12-->1:00:05.1 align:start\nno blanks\n"
    assert cues.read_vtt(text) == [(1.5, 3.25, ["short"]), (4.12, 3605.1, ["no blanks"])]
    with pytest.raises(ValueError, match="malformed"):
        cues.read_vtt("00:01 --> 00:02\nx")


def test_quotes_by_index_equal_looking_in_all_cues(spark):
    rng = random.Random(4)
    words = ["the", "a", "cat", "concat", "sat", "on", "mat", "and", "ran", "it's"]
    said = [(k, float(i), " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for k in range(5) for i in range(60)]
    quotes = []
    for n in range(120):
        k, _, text = rng.choice(said)
        parts = text.split()
        a = rng.randrange(len(parts))
        quote = " ".join(parts[a : a + rng.randint(1, 9)])
        if rng.random() < 0.4:
            quote = quote[rng.randint(0, 2) :]  # begins within a word
        quotes.append((k, n, quote + rng.choice(["", "", " zzz", "!"]), rng.uniform(0, 60)))
    cue_rows, label_rows = spark.createDataFrame(said, "k int, start double, text string"), spark.createDataFrame(quotes, "k int, n int, quote string, at double")
    got = {r.n: r.found for r in cues.nearest_quotes(label_rows, cue_rows, ["k"], "n").collect()}
    plain = spark.createDataFrame([(t,) for _, _, t, _ in quotes] + [(t,) for _, _, t in said], "t string").select("t", F.array_join(F.slice(T.normal_words(F.col("t")), 1, 6), " ").alias("head"), F.array_join(T.normal_words(F.col("t")), " ").alias("all"))
    norm = {r.t: (r["head"], r["all"]) for r in plain.collect()}
    for k, n, quote, at in quotes:
        head = norm[quote][0]
        fits = [s for c, s, t in said if c == k and head and head in norm[t][1]]
        assert got[n] == min(fits, key=lambda s: (abs(s - at), s), default=None)


def test_the_index_of_quotes_holds_no_texts(spark):
    """A row for each run of words must not carry all words of its cue."""
    said = spark.createDataFrame([(1, 0.0, "a long cat sat on the mat again"), (1, 9.0, "cat sat on the mat")], "k int, start double, text string")
    quotes = spark.createDataFrame([(1, 0, "ong cat sat on the ma", 0.0), (1, 1, "at sat on the ma", 9.0), (1, 2, "og cat sat on", 0.0)], "k int, n int, quote string, at double")
    found = cues.nearest_quotes(quotes, said, ["k"], "n")
    assert {r.n: r.found for r in found.collect()} == {0: 0.0, 1: 9.0, 2: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_run#" in plan and not [line for line in plan.splitlines() if "_run#" in line and "_t#" in line]


def test_quotes_are_found_without_broadcasts(spark, tmp_path):
    """Spark takes the index of a small file for small, whatever comes of it; it must not be sent through the driver.  Direct and by index, quotes are found at the same places."""
    rng = random.Random(11)
    words = ["the", "a", "cat", "concat", "sat", "on", "mat", "", "!?"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    said = [(k, float(i), text(rng.randint(1, 14))) for k in range(4) for i in range(40)] + [(None, 1.0, "the cat"), (5, 1.0, None)]
    quotes = [(k, 100 * k + n, text(rng.randint(0, 9))[rng.randint(0, 1) :], rng.uniform(0, 40)) for k in range(4) for n in range(3 + 20 * k)]
    quotes += [(None, 1000, "the cat", 1.0), (5, 1001, "the", 1.0), (6, 1002, "the", 1.0), (5, 1003, None, 1.0)]
    spark.createDataFrame(said, "k int, start double, text string").write.parquet(f"{tmp_path}/said")
    spark.createDataFrame(quotes, "k int, n int, quote string, at double").write.parquet(f"{tmp_path}/quotes")
    asked = spark.read.parquet(f"{tmp_path}/quotes"), spark.read.parquet(f"{tmp_path}/said")
    found = cues.nearest_quotes(*asked, ["k"], "n")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    norm = lambda t: " ".join(t.replace("!", "").replace("?", "").split())
    plain = {}
    for k, n, quote, at in quotes:
        head = " ".join(norm(quote or "").split()[:6])
        fits = [s for c, s, t in said if c is not None and c == k and head and head in norm(t or "")]
        plain[n] = min(fits, key=lambda s: (abs(s - at), s), default=None)
    assert len({v for v in plain.values()}) > 20 and {r.n: r.found for r in found.collect()} == plain
    for few in (0, 30):
        assert {r.n: r.found for r in cues.nearest_quotes(*asked, ["k"], "n", few=few).collect()} == plain


def test_states_on_a_stream_equal_the_batch(spark, tmp_path):
    """Late events, events that come again, and batches that hold several of one episode."""
    rng = random.Random(2)
    events = []
    for e in range(12):
        used = 0
        for v in range(rng.randint(1, 9)):
            used += rng.randint(0, 50)
            events.append(("c", f"e{e}", v, rng.choice(["pending", "waiting", "rendered", "published"]), rng.choice(["", "pruned"]), used, used // 2))
    schema = "channel string, id string, version long, stage string, removal string, input long, output long"
    shuffled = events + rng.sample(events, 15)
    rng.shuffle(shuffled)
    for n in range(5):
        spark.createDataFrame(shuffled[n::5], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = states.follow(stream, ["channel", "id"], str(tmp_path / "out"), str(tmp_path / "log"))
    query.awaitTermination(180)
    assert query.exception() is None
    got = states.current(spark, ["channel", "id"], str(tmp_path / "out"))
    want = states.batch_states(spark.createDataFrame(events, schema), ["channel", "id"])
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert changes.select("epoch").distinct().count() > 1
    steps = {r.id: r.s for r in changes.groupBy("id").agg(F.sum("input_step").alias("s")).collect()}
    assert steps == {r.id: r.input for r in want.collect()}


def test_changes_of_states_need_no_python(spark):
    kind = "id string, version long, stage string, removal string, has_published boolean, input long, output long"
    before = spark.createDataFrame([("a", 1, "pending", "", False, 5, 1), ("b", 2, "published", None, True, 7, 7)], kind)
    after = spark.createDataFrame([("a", 3, "published", "", True, 9, 1), ("b", 2, "published", None, True, 7, 7), ("c", 1, "waiting", "", False, 4, 0)], kind)
    assert {r.id: (r.version, r.input_step, r.output_step) for r in states.changes(after, before, ["id"]).collect()} == {"a": (3, 4, 0), "c": (1, 4, 0)}
    assert {r.id: r.input_step for r in states.changes(after, None, ["id"]).collect()} == {"a": 9, "b": 7, "c": 4}
    assert "Pandas" not in states.states(after.drop("has_published"), ["id"])._jdf.queryExecution().analyzed().toString()
