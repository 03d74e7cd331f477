"""Benchmark decontamination by spaced seeds.

A fixed mask reads some of the words under it and ignores the others, so a hash of the words read
survives substitutions at ignored places.  Each place of each text and of each benchmark item is
hashed under each mask; equal hashes of one mask are hits, and around a hit the text and the item
are compared word by word on every diagonal (place in the text minus place in the item) that a hit
lies on.  A stretch of a diagonal is an overlap if it holds enough equal words (`required`) and few
others; of several the one of most equal words counts.

The texts are read once.  While they are read, a Bloom filter of the benchmark's hashes (BITS_A_SEED bits
for each, up to MOST_BITS) passes over places that can't hit; from the others, stretches of word
hashes long enough to verify are cut out and joined to the benchmark's hashes.  The filter only
skips what the join would drop, so the result does not depend on its size.

A stretch and an item are joined once, by their distinct hashes, and the diagonals are found when the two are
compared: a text that repeats a word or a line for pages costs no pairs of places.

Words are letters and digits of the lower-cased text.  Which masks an item is read under depends on its
length: LIGHT masks help items of under LIGHT_UNDER words, TINY ones are for items of 5 to 7 words, and an
item of fewer words is evidence only where it is the whole text.

Cases: null texts and items hold no words.  Rows of the texts without an id are not reported.  Equal
items with different ids are each reported; rows that repeat an id are read each, and the better
overlap is reported.  Ties go to the shorter, then the earlier stretch.  Very long texts and items are
compared whole.  Without texts or items nothing is reported.  Columns beside id and text are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as kit
from .shared import bounded_broadcast, discard, each_batch, free_name, give_back, settle, small_batches

#: Fixed masks: 1 reads the word, 0 ignores it.  Each reads 8 words.
MASKS = ("11111111", "1110110111", "11011010111", "110100110111")
#: Fixed masks that read 5 words, for items of 8 to LIGHT_UNDER - 1 words.
LIGHT, LIGHT_UNDER = ("11111", "110111", "1101011"), 24
#: Fixed masks that read 4 words, for items of MIN_ITEM to 7 words; those of fewer are found only where they are whole texts.
TINY = ("1111", "11011", "10111", "11101")
MIN_ITEM, SPACED_ITEM = 5, 8
PENALTY = 3
#: An overlap holds so many equal words: MIN_SHARE of its item's, from LEAST_WORDS to MIN_WORDS (of an item of few
#: words IDENTITY); and the share IDENTITY of the words in itself.
LEAST_WORDS, MIN_WORDS, MIN_SHARE, IDENTITY = 8, 13, 0.6, 0.8
BITS_A_SEED, LEAST_BITS, MOST_BITS, PROBES = 64, 1 << 16, 1 << 27, 4
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Mask:
    """Which words are read, of items of which lengths; whole: at texts of the mask's length only."""

    reads: str
    number: int
    least: int
    most: int
    whole: bool = False


def masks_for(lengths) -> tuple[Mask, ...]:
    """The masks that items of these lengths are read under."""
    out = [Mask(m, i, SPACED_ITEM, 1 << 62) for i, m in enumerate(MASKS)]
    out += [Mask(m, 10 + i, SPACED_ITEM, LIGHT_UNDER - 1) for i, m in enumerate(LIGHT)]
    out += [Mask(m, 20 + i, MIN_ITEM, SPACED_ITEM - 1) for i, m in enumerate(TINY)]
    out += [Mask("1" * n, 30 + n, n, n, whole=True) for n in range(1, MIN_ITEM)]
    return tuple(m for m in out if any(m.least <= n <= m.most for n in lengths))


def required(item_words: int) -> int:
    """Equal words that an overlap with an item of so many words needs."""
    few = item_words if item_words < MIN_ITEM else min(LEAST_WORDS, int(np.ceil(IDENTITY * item_words)))
    return min(MIN_WORDS, max(few, int(np.ceil(MIN_SHARE * item_words))))


def seeds(words: kit.Words, mask: Mask) -> tuple[np.ndarray, np.ndarray]:
    """Places where the mask fits into a document, and the hashes there."""
    width = len(mask.reads)
    at = np.flatnonzero(kit.within(words.ptr, width))
    if mask.whole and len(at):
        doc = np.searchsorted(words.ptr, at, side="right") - 1
        at = at[np.diff(words.ptr)[doc] == width]
    n = len(words.hashes) - width + 1
    if n <= 0 or not len(at):
        return at[:0], np.zeros(0, dtype=kit.U64)
    total = np.zeros(n, dtype=kit.U64)
    with np.errstate(over="ignore"):
        for j, read in enumerate(mask.reads):
            if read == "1":
                total = total * kit.U64(kit._STEP) + words.hashes[j : j + n]
    return at, kit.splitmix(total[at], 600 + mask.number)


def _items(batch: pa.RecordBatch, masks: tuple[Mask, ...]):
    """The distinct seeds of each benchmark item of a block."""
    for words in kit.blocks(batch.column("text"), kit.ALNUM_SPLIT, fold=True):
        per = np.diff(words.ptr)
        for mask in masks:
            at, value = seeds(words, mask)
            doc = np.searchsorted(words.ptr, at, side="right") - 1
            keep = (per[doc] >= mask.least) & (per[doc] <= mask.most)
            pairs = np.unique(np.array([doc[keep], value[keep].view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(pairs[0] + words.first)), pa.array(pairs[1])], names=["item_id", "seed"])


def _item_words(batch: pa.RecordBatch):
    for words in kit.blocks(batch.column("text"), kit.ALNUM_SPLIT, fold=True):
        rows = pa.array(np.arange(words.first, words.first + words.docs))
        lists = pa.ListArray.from_arrays(pa.array(words.ptr.astype(np.int32)), pa.array(words.hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(rows), lists], names=["item_id", "item_words"])


def _probes(value: np.ndarray, bits: int, number: int) -> np.ndarray:
    return (value >> kit.U64(13 * number)) & kit.U64(bits - 1)


def _filter_words(batch: pa.RecordBatch, bits: int):
    """The words of the Bloom filter that hold bits of the seeds."""
    value = batch.column("seed").to_numpy().view(kit.U64)
    cell = np.concatenate([_probes(value, bits, j) for j in range(PROBES)])
    word, at = np.unique(cell >> kit.U64(6), return_inverse=True)
    held = np.zeros(len(word), dtype=kit.U64)
    np.bitwise_or.at(held, at, kit.U64(1) << (cell & kit.U64(63)))
    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(held.view(np.int64))], names=["word", "held"])


def bloom_filter(item_seeds: DataFrame, n_seeds: int) -> np.ndarray:
    """The filter of all seeds: a power of two of bits, MOST_BITS (16 MB) at most."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_A_SEED * n_seeds):
        bits *= 2
    parts = each_batch(lambda b: _filter_words(b, bits), "word int, held long", item_seeds.select("seed"))
    # at most MOST_BITS / 64 rows, whatever the benchmark
    got = parts.groupBy("word").agg(F.bit_or("held").alias("held")).toPandas()
    out = np.zeros(bits // 64, dtype=kit.U64)
    out[got["word"].to_numpy()] = got["held"].to_numpy().astype(np.int64).view(kit.U64)
    return out


def passing(value: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Places of the hashes that are in the filter."""
    some = np.arange(len(value))
    for j in range(PROBES):
        cell = _probes(value[some], 64 * len(held), j)
        some = some[((held[(cell >> kit.U64(6)).astype(np.int64)] >> (cell & kit.U64(63))) & kit.U64(1)).astype(bool)]
    return some


def _stretches(batch: pa.RecordBatch, masks: tuple[Mask, ...], held: np.ndarray, reach: int):
    """Stretches of texts around places that may hit, with the distinct hashes there."""
    for words in kit.blocks(batch.column("text"), kit.ALNUM_SPLIT, fold=True):
        found_at, found_seed = [], []
        for mask in masks:
            at, value = seeds(words, mask)
            some = passing(value, held)
            found_at.append(at[some])
            found_seed.append(value[some])
        at, seed = np.concatenate(found_at), np.concatenate(found_seed)
        if not len(at):
            continue
        order = np.argsort(at, kind="stable")
        at, seed = at[order], seed[order]
        doc = np.searchsorted(words.ptr, at, side="right") - 1
        new = np.ones(len(at), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        d = doc[first]
        begin, end = np.maximum(at[first] - reach, words.ptr[d]), np.minimum(at[last] + reach, words.ptr[d + 1])
        size = end - begin
        inside = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        number, value = np.unique(np.array([np.cumsum(new) - 1, seed.view(np.int64)]), axis=1)
        ends = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id").take(pa.array(d + words.first)),
                batch.column("_text").take(pa.array(d + words.first)),
                pa.array((begin - words.ptr[d]).astype(np.int32)),
                pa.ListArray.from_arrays(ends(size), pa.array(words.hashes[inside].view(np.int64))),
                pa.ListArray.from_arrays(ends(np.bincount(number, minlength=len(first))), pa.array(value)),
            ],
            names=["_id", "_text", "begin", "words", "seeds"],
        )


def _one(words: np.ndarray) -> kit.Words:
    nothing = np.zeros(0, dtype=np.int64)
    return kit.Words(nothing, nothing, nothing, np.array([0, len(words)]), words.view(kit.U64), 0)


def seeds_of(words: np.ndarray, masks: tuple[Mask, ...]) -> dict[Mask, tuple[np.ndarray, np.ndarray]]:
    """Under each mask, the hashes of a word list in order and the places where they stand."""
    out = {}
    for mask in masks:
        at, value = seeds(_one(words), mask)
        order = np.argsort(value, kind="stable")
        out[mask] = value[order], at[order]
    return out


def hit_diagonals(text: dict, item: dict, n_text: int, n_item: int) -> np.ndarray:
    """The diagonals that hits of the seeds of two word lists (and of their lengths) lie on, ascending."""
    found = np.zeros(n_text + n_item, dtype=bool)  # diagonal + n_item
    for mask, (known, place) in item.items():
        value, at = text[mask]
        # each seed of the item, once, and its run of places on both sides
        first = np.flatnonzero(np.append(True, known[1:] != known[:-1])) if len(known) else np.zeros(0, dtype=np.int64)
        low, high = (np.searchsorted(value, known[first], side=side) for side in ("left", "right"))
        stop = np.append(first[1:], len(known))
        times = (high - low) * (stop - first)
        once = times == 1
        found[at[low[once]] - place[first[once]] + n_item] = True
        for i in np.flatnonzero(times > 1):
            p, q = at[low[i] : high[i]], place[first[i] : stop[i]]
            if len(p) * len(q) <= 1 << 20:
                found[np.subtract.outer(p, q).ravel() + n_item] = True
            else:
                # which differences there are, by a convolution: a hash that repeats has too many pairs to list
                n = 1 << int(len(found) + n_item).bit_length()
                a, b = np.zeros(n), np.zeros(n)
                a[p], b[n_item - q] = 1, 1
                found |= (np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), n) > 0.5)[: len(found)]
    return np.flatnonzero(found) - n_item


def best_overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(start in the text, length, equal words) of the best stretch on a diagonal (text place - item place)."""
    a, b = max(0, diagonal), min(len(text), diagonal + len(item))
    if a >= b:
        return a, 0, 0
    equal = text[a:b] == item[a - diagonal : b - diagonal]
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    gain = total - np.minimum.accumulate(total)
    stop = int(np.argmax(gain))
    start = int(np.argmin(total[: stop + 1]))
    return a + start, stop - start, int(equal[start:stop].sum())


def is_overlap(length: int, equal: int, item_words: int) -> bool:
    return equal > 0 and equal >= IDENTITY * length and equal >= required(item_words)


def widest_overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(start in the text, length, equal words) of the stretch of most equal words of those that hold IDENTITY of them."""
    a, b = max(0, diagonal), min(len(text), diagonal + len(item))
    if a >= b:
        return a, 0, 0
    equal = text[a:b] == item[a - diagonal : b - diagonal]
    # a stretch holds the share if its total is not negative; for each end, the first start that allows it
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -round(IDENTITY / (1 - IDENTITY))))])
    starts = np.searchsorted(-np.minimum.accumulate(total), -total)
    count = np.concatenate([[0], np.cumsum(equal)])
    stop = int(np.argmax(count - count[starts]))
    start = int(starts[stop])
    inside = np.flatnonzero(equal[start:stop])
    if not len(inside):
        return a, 0, 0
    # words at the ends that are not equal don't belong to it
    return a + start + int(inside[0]), int(inside[-1] - inside[0]) + 1, len(inside)


def overlap(text: np.ndarray, item: np.ndarray, diagonals) -> tuple[int, int, int] | None:
    """The overlap of most equal words on the diagonals: of each the best stretch, or else the widest.

    Diagonals that share more words with the item come first, and none is tried that shares fewer than are found equal.
    """
    diagonals = np.sort(np.asarray(diagonals, dtype=np.int64))
    shared = np.minimum(len(text), diagonals + len(item)) - np.maximum(0, diagonals)
    rank = lambda x: (x[2], -x[1], -x[0])
    least, best = required(len(item)), None
    for i in np.argsort(-shared, kind="stable"):
        if shared[i] < (best[2] if best else least) or best and best[1] == best[2] == len(item):
            break
        d = int(diagonals[i])
        for way in (best_overlap, widest_overlap):
            x = way(text, item, d)
            if is_overlap(x[1], x[2], len(item)):
                best = x if best is None or rank(x) > rank(best) else best
                break
    return best


#: Words of the texts, and of the items, whose seeds a task keeps at a time.
KEPT_WORDS = 1 << 17


class _Kept:
    """Word lists with their seeds by name, forgotten when there are KEPT_WORDS of them."""

    def __init__(self):
        self.held: dict = {}
        self.words = 0

    def get(self, name, words: np.ndarray, masks) -> tuple[np.ndarray, dict]:
        """masks: those for the length of the list."""
        known = self.held.get(name)
        if known is None or not np.array_equal(known[0], words):  # a name may stand for several lists
            if self.words > KEPT_WORDS:
                self.held.clear()
                self.words = 0
            known = self.held[name] = words, seeds_of(words, masks(len(words)))
            self.words += len(words)
        return known


def _verified(batches, masks: tuple[Mask, ...]):
    """The best overlap of each pair.  A text that meets many items is hashed once, as is an item that many texts meet."""
    texts, items = _Kept(), _Kept()
    of_item = lambda n: tuple(m for m in masks if m.least <= n <= m.most)
    for batch in batches:
        rows = []
        where = list(zip(batch.column("_id").to_pylist(), batch.column("begin").to_pylist(), strict=True))
        names, left, right = batch.column("item_id").to_pylist(), batch.column("words"), batch.column("item_words")
        for i, name in enumerate(names):
            text, of_text = texts.get(where[i], left[i].values.to_numpy(), lambda n: masks)
            item, of_this = items.get(name, right[i].values.to_numpy(), of_item)
            best = overlap(text, item, hit_diagonals(of_text, of_this, len(text), len(item)))
            rows.append((*best, len(item)) if best else (-1, 0, 0, 0))
        start, length, equal, size = np.array(rows, dtype=np.int64).reshape(-1, 4).T
        out = pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("item_id"), pa.array(start + batch.column("begin").to_numpy()), pa.array(length), pa.array(equal), pa.array(size)],
            names=["_id", "item_id", "start_word", "n_words", "n_equal", "item_words"],
        )
        yield out.filter(pa.array(start >= 0))
    give_back()


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that overlap: id, item_id, start_word, n_words, n_equal, item_words.

    A stretch is reported by its best diagonal, a document and item by the best stretch (most equal words, first).
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.lower(item_text_col).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    id_type = dict(items.dtypes)["item_id"]
    item_words = settle(each_batch(_item_words, f"item_id {id_type}, item_words array<long>", items).where(F.size("item_words") > 0))
    # a row for each length up to LIGHT_UNDER
    n_words = F.least(F.size("item_words"), F.lit(LIGHT_UNDER))
    lengths = [r.n for r in item_words.groupBy(n_words.alias("n")).agg(F.count(F.lit(1))).collect()]
    known = item_words.agg(F.max(F.size("item_words")).alias("longest"), F.sum(F.size("item_words")).alias("words")).first()
    masks = masks_for(lengths)
    item_seeds = settle(each_batch(lambda b: _items(b, masks), f"item_id {id_type}, seed long", items).distinct())
    n_seeds = item_seeds.count()
    shared = spark.sparkContext.broadcast(bloom_filter(item_seeds, n_seeds))
    reach = max([known.longest or 0, *(len(m.reads) for m in masks)])
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_text"), F.lower(text_col).alias("text"))
    fields = "_id long, _text long, begin int, words array<long>, seeds array<long>"
    stretches = settle(each_batch(lambda b: _stretches(b, masks, shared.value, reach) if masks else (), fields, texts))
    key = ["_id", "_text", "begin"]
    hits = stretches.select(*key, F.explode("seeds").alias("seed")).join(bounded_broadcast(item_seeds, n_seeds, BROADCAST_ROWS), "seed")
    pairs = hits.select(*key, "item_id").distinct()
    sides = pairs.join(stretches.select(*key, "words").dropDuplicates(key), key).join(bounded_broadcast(item_words, (known.words or 0) // 16, BROADCAST_ROWS), "item_id")
    found = sides.select("_id", "item_id", "begin", "words", "item_words").mapInArrow(
        lambda b: _verified(b, masks), f"_id long, item_id {id_type}, start_word long, n_words long, n_equal long, item_words long"
    )
    rank = F.struct(F.col("n_equal"), -F.col("n_words"), -F.col("start_word"))
    best = settle(found.groupBy("_id", "item_id").agg(F.max_by(F.struct("start_word", "n_words", "n_equal", "item_words"), rank).alias("x")))
    discard(stretches, item_words, item_seeds)
    shared.destroy()
    return best.select(F.col("_id").alias(id_col), "item_id", "x.start_word", "x.n_words", "x.n_equal", "x.item_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that overlap no item, columns as they were; documents without an id stay."""
    bad = free_name(docs, "_bad")
    found = contaminations(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col(id_col).alias(bad)).distinct()
    return docs.join(found, docs[id_col].cast("long") == found[bad], "left_anti")
