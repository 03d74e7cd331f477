"""Removal of long passages that repeat across documents, found by recompression.

Every window of `window` words is assigned one anchor: among the symbols of the highest
recompression round that the window alone decides, the one with the smallest mixed name, with
half of the window's other words, on the side where it has more.  Equal windows have equal
anchors, and neighbouring windows mostly share theirs, so a document becomes
a few runs of windows (one for about 10 words) instead of one row for each word.

1.  Runs whose whole span repeats are settled together: a 96-bit hash of the span, and the
    smallest document that has it.
2.  Runs that are their span's first, but whose anchor (with all tokens that decide it) also
    stands in a different span, are the edges of repeats.  Only there single windows are
    compared, by 96-bit hashes.

Windows with no symbol of a high enough round (text of short periods) are runs of their own.
Every window takes part in 1 or 2, so the result is that of comparing all windows.

Cases: a null, empty or short text has no window and loses nothing.  Rows without a document id
neither lose words nor take any from others.  Rows that repeat an id are judged each by its own
text; a window in two rows of one id is no repeat, as neither id is smaller.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as kit
from .recompression import levels
from .shared import discard, each_batch, settle, small_batches

ROUNDS = 5
#: Symbols of rounds under this one are too common to be anchors.
LOWEST = 4
RUNS_EVERY = 3
#: A run's place: its first word times PLACE plus its number of windows.
PLACE = 1 << 16
_RUN_SCHEMA = "_id long, _text long, anchor long, span1 long, span2 int, place long"


def _anchors(words: kit.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of a window: does it fit, its anchor's key, and a number that changes where the anchor does."""
    ok = kit.within(words.ptr, window)
    n = len(ok)
    key = np.zeros(n, dtype=kit.U64)
    group = np.full(n, -1, dtype=np.int64)
    open_ = ok.copy()
    prefix = None
    found = levels(words.hashes, words.ptr, ROUNDS, RUNS_EVERY)
    for number in range(len(found) - 1, LOWEST - 1, -1):
        x = found[number]
        if not open_.any() or not len(x.name):
            continue
        # symbols first..last are decided by the window at each place; both bounds grow with the place
        first = np.searchsorted(x.lo, np.arange(n), side="left")
        last = np.searchsorted(x.hi, np.arange(window, n + window), side="right") - 1
        at = np.flatnonzero(open_ & (last >= first))
        if not len(at):
            continue
        rank = kit.splitmix(x.name, 500 + number)
        a, b = first[at], last[at]
        best, value = a.copy(), rank[a]
        for step in range(1, int((b - a).max()) + 1):
            k = np.minimum(a + step, b)
            less = rank[k] < value
            best = np.where(less, k, best)
            value = np.where(less, rank[k], value)
        if prefix is None:
            size = len(words.hashes)
            with np.errstate(over="ignore"):
                prefix = np.zeros(size + 1, dtype=kit.U64)
                np.cumsum(words.hashes * kit._powers(kit._STEP, size)[:size], out=prefix[1:])
        s, e = x.lo[best], x.hi[best]
        # windows that hold at least half of their other words before the anchor have these in
        # common as well, the others as many after it
        before = (window - (e - s) + 1) // 2
        leftward = at <= s - before
        s, e = np.where(leftward, s - before, s), np.where(leftward, e, e + window - (e - s) - before + 1)
        with np.errstate(over="ignore"):
            decided = (prefix[e] - prefix[s]) * kit._powers(kit._STEP_INVERSE, len(prefix))[s]
        key[at] = kit.combine(decided, x.name[best] + leftward.astype(kit.U64), number)
        group[at] = (best * (ROUNDS + 1) + number) * 2 + leftward
        open_[at] = False
    return ok, key, group


def _runs_of(batch: pa.RecordBatch, window: int):
    ids, texts = batch.column("_id").to_numpy(zero_copy_only=False), batch.column("_text").to_numpy()
    for words in kit.blocks(batch.column("text"), kit.BLANK_SPLIT):
        ok, key, group = _anchors(words, window)
        n = len(ok)
        if not ok.any():
            continue
        w1, w2 = kit.rolling(words.hashes, window, 1), kit.rolling(words.hashes, window, 2)
        alone = ok & (group < 0)
        key[alone] = w1[alone]
        new = ok.copy()
        new[1:] = ok[1:] & (~ok[:-1] | (group[1:] != group[:-1]) | alone[1:])
        start = np.flatnonzero(new)
        # a run ends before the next one or before a place where no window fits
        stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + 1
        size = stop - start
        doc = np.searchsorted(words.ptr, start, side="right") - 1
        row = doc + words.first
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[row]),
                pa.array(texts[row]),
                pa.array(key[start].view(np.int64)),
                pa.array(kit.combine(kit.combine(w1[start], w1[stop - 1], 1), size.astype(kit.U64), 2).view(np.int64)),
                pa.array((kit.combine(kit.combine(w2[start], w2[stop - 1], 3), size.astype(kit.U64), 4) >> kit.U64(32)).astype(np.uint32).view(np.int32)),
                pa.array((start - words.ptr[doc]) * PLACE + size),
            ],
            names=["_id", "_text", "anchor", "span1", "span2", "place"],
        )


def _windows_of(batch: pa.RecordBatch, window: int):
    """Single windows of the runs listed beside each text."""
    ids, texts = batch.column("_id").to_numpy(), batch.column("_text").to_numpy()
    lists = batch.column("runs")
    offsets = lists.offsets.to_numpy()
    starts, sizes = np.divmod(lists.values.to_numpy(), PLACE)
    for words in kit.blocks(batch.column("text"), kit.BLANK_SPLIT):
        lo, hi = offsets[words.first], offsets[words.first + words.docs]
        per = np.diff(offsets[words.first : words.first + words.docs + 1])
        doc = np.repeat(np.arange(words.docs), per)
        s, k = starts[lo:hi], sizes[lo:hi]
        at = np.repeat(s + words.ptr[doc] - np.cumsum(k) + k, k) + np.arange(k.sum())
        at = np.unique(at)
        if not len(at):
            continue
        d = np.searchsorted(words.ptr, at, side="right") - 1
        row = d + words.first
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[row]),
                pa.array(texts[row]),
                pa.array(kit.rolling(words.hashes, window, 1)[at].view(np.int64)),
                pa.array((kit.rolling(words.hashes, window, 2)[at] >> kit.U64(32)).astype(np.uint32).view(np.int32)),
                pa.array((at - words.ptr[d]).astype(np.int32)),
            ],
            names=["_id", "_text", "w1", "w2", "start"],
        )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Spans of words to remove: (_id, _text, spans array<struct<start, stop>>), _text a hash of the text.

    A word is in a span if a window that covers it also starts in a document with a smaller id.
    """
    small_batches(docs.sparkSession)
    texts = _identified(docs, id_col, text_col)
    runs = settle(each_batch(lambda b: _runs_of(b, window), _RUN_SCHEMA, texts))
    classes = settle(runs.groupBy("span1", "span2", "anchor").agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id")))
    mixed = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", F.lit(True).alias("mixed"))
    # spans of several documents, and the edges of repeats
    telling = settle(
        classes.join(mixed, "anchor", "left")
        .select("span1", "span2", "first_id", F.coalesce("mixed", F.lit(False)).alias("mixed"), (F.col("first_id") < F.col("last_id")).alias("repeated"))
        .where("mixed or repeated")
    )
    discard(classes)
    hits = settle(
        runs.join(telling, ["span1", "span2"]).where("first_id < _id or (mixed and first_id = _id)").select("_id", "_text", "place", (F.col("first_id") < F.col("_id")).alias("whole"))
    )
    discard(runs, telling)
    start, size = F.expr(f"place div {PLACE}"), F.col("place") % PLACE
    whole = hits.where("whole").select("_id", "_text", start.cast("int").alias("start"), (start + size + (window - 1)).cast("int").alias("stop"))
    # the first document of each span at an edge shows the single windows
    edges = hits.where("not whole").groupBy("_id", "_text").agg(F.collect_list("place").alias("runs"))
    single = settle(
        each_batch(
            lambda b: _windows_of(b, window),
            "_id long, _text long, w1 long, w2 int, start int",
            texts.join(edges.hint("shuffle_hash"), ["_id", "_text"]).select("_id", "_text", "text", "runs"),
        )
    )
    earliest = single.groupBy("w1", "w2").agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id")).where("first_id < last_id")
    edge = single.join(earliest, ["w1", "w2"]).where("first_id < _id").select("_id", "_text", "start", (F.col("start") + window).alias("stop"))
    found = settle(whole.unionByName(edge).groupBy("_id", "_text").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    discard(hits, single)
    return found


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_text"), F.col(text_col).alias("text")
    )


def _kept(batch: pa.RecordBatch, with_text: bool):
    """Counts, the SHA-256 of the kept words, and these words if asked for, of each row."""
    lists = batch.column("spans")
    has = lists.is_valid().to_numpy(zero_copy_only=False)
    counts, removed, digests, kept = [], [], [], []
    for i, text in enumerate(batch.column("text")):
        raw = text.as_buffer() if text.is_valid else None
        # bytes.split() parts at exactly \x09-\x0D and \x20
        words = raw.to_pybytes().split() if raw is not None else []
        n = len(words)
        if has[i] and n:
            spans = lists[i].values
            mark = np.zeros(n + 1, dtype=np.int64)
            np.add.at(mark, spans.field("start").to_numpy(), 1)
            np.add.at(mark, spans.field("stop").to_numpy(), -1)
            stay = np.flatnonzero(np.cumsum(mark[:n]) == 0)
            words = [words[j] for j in stay]
        joined = b" ".join(words)
        counts.append(n)
        removed.append(n - len(words))
        digests.append(hashlib.sha256(joined).hexdigest())
        if with_text:
            kept.append(joined)
    columns = [batch.column("_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
    names = ["_id", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
        names.append("kept_text")
    yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """One row for each document: its id, n_words, n_removed, kept_sha256, and with_text the kept
    words joined by blanks (kept_text).  The columns beside id and text are not carried."""
    spans = repeated_spans(docs, id_col, text_col, window)
    texts = _identified(docs, id_col, text_col)
    # rows without an id meet no spans; they stay in the plan beside the join
    nameless = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("_id"), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans")
    )
    both = texts.join(spans.hint("shuffle_hash"), ["_id", "_text"], "left").select("_id", "text", "spans").unionByName(nameless)
    out_id = id_col if id_col not in ("n_words", "n_removed", "kept_sha256", "kept_text") else f"_{id_col}"
    schema = "_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return each_batch(lambda b: _kept(b, with_text), schema, both).withColumnRenamed("_id", out_id)
