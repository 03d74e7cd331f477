"""Mixing sources to target weights, block by block.

1.  Targets.  Sources in code-point order (null last) get weights by turns; together they are to
    give `share` of all words.  A source whose part would exceed `repeats` times its words gives
    just that, and the excess is dealt again by weight among the others.
2.  Packing.  The documents of a source stand in a pseudorandom order and their words are packed
    into blocks of `block` words.  Places in that order are prefix sums over chunks of documents, so
    no task holds a whole source.
3.  Drawing.  A source gives as many slots as its target needs, and the slots of all sources are dealt to output shards of
    equal size.  Each shard draws its counts of the sources from a multinomial of its own, with the sources' parts of all slots as
    chances: first the counts of groups of GROUP sources, then those within each group.  The draws of a source then sum up to
    its slots but for chance; where they are more, slots of it drawn at random are given up, and those places, in pseudorandom
    order, go to the sources that were drawn too seldom.  So every source gives just what it is to give.
4.  Slot j of a source is block P(j mod blocks) of its pass j div blocks, P a keyed Feistel
    permutation of the source's whole blocks (a shorter last block comes last in each pass); the last slot of all takes
    the words that the target still lacks.  Slots and documents are joined by block number.

Sources, slots and documents are all tables: nothing of them is gathered in the driver, and a source of
any size is dealt to all tasks.  Everything is a function of the rows and the seed: reruns agree, whatever the partitions.

Cases: a null or empty text has size 0 and nothing is taken from it.  A source without words has
target 0, a source of few words meets its target as the others do, to the word.  No rows give no rows.
Rows that are equal in all columns used share their fate up to their order.  Very long texts are cut into their blocks.
Columns beside id, text and source are kept by mixed_documents and not carried by mixture_counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from . import textkit as kit
from .shared import bounded_broadcast, discard, settle

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, REPEATS = 1.5, 2
BLOCK = 64
SHARDS = 64
#: Documents that share a chunk of the order, on average; over many documents the root of their number, so that
#: neither a chunk nor the list of chunks grows as they do.
CHUNK_DOCS = 512
#: Slots that are listed from one row, and sources whose counts are drawn together.
SLOT_RUN, GROUP = 1 << 14, 4096
#: Sources up to which their table is broadcast.
BROADCAST_ROWS = 50_000
FEISTEL_ROUNDS = 6


def size_of(text: Column) -> Column:
    """Words of a text: maximal runs of bytes other than blanks; null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(spaced, r"[\x20\x09-\x0D]+", "")).cast("long")


def numbered(df: DataFrame, order: list[str], sums: dict[str, str], kept: list[DataFrame] | None = None) -> DataFrame:
    """df with `place`, its place in the order from 0, and a sum over all rows before it for each name and column of `sums`.

    Rows are dealt to tasks by ranges of the order; then each task needs only the totals of those before it.  The table that the
    result reads is added to `kept`.
    """
    held = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    if kept is not None:
        kept.append(held)
    totals = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    # a row for each task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select("_part", zero(F.sum("_n").over(before)).alias("_n"), *[zero(F.sum(f"_{k}").over(before)).alias(f"_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order)
    out = held.withColumn("place", F.row_number().over(own) - 1)
    for k, c in sums.items():
        out = out.withColumn(k, zero(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1))))
    out = out.join(F.broadcast(totals), "_part").withColumn("place", F.col("place") + F.col("_n"))
    for k in sums:
        out = out.withColumn(k, F.col(k) + F.col(f"_{k}"))
    return out.drop("_part", "_n", *[f"_{k}" for k in sums])


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS, kept: list[DataFrame] | None = None) -> DataFrame:
    """sources (_source and its words n) with their weight by turns and their target words; tables that the result reads are
    added to `kept`.

    Sources in the order of words to weight are the order in which they fill up.  The first that does not, with all
    that are fuller taken away, tells what a unit of weight gives.
    """
    kept = [] if kept is None else kept
    by_name = numbered(sources.withColumn("_last", F.col("_source") == ""), ["_last", "_source"], {}, kept)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = settle(by_name.select("_source", "n", weight.alias("weight")))
    kept.append(weighted)
    all_ = weighted.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not all_.n:
        return weighted.withColumn("target", F.lit(0.0))
    filling = numbered(weighted.withColumn("fill", F.col("n") / F.col("weight")), ["fill", "_source"], {"n_before": "n", "weight_before": "weight"}, kept)
    unit = (F.lit(share * all_.n) - repeats * F.col("n_before")) / (F.lit(all_.weight) - F.col("weight_before"))
    open_ = filling.where(unit * F.col("weight") <= repeats * F.col("n")).agg(F.min_by(unit, "place").alias("unit")).first().unit
    target = F.lit(repeats) * F.col("n") if open_ is None else F.least(F.lit(repeats) * F.col("n"), F.lit(open_) * F.col("weight"))
    return weighted.withColumn("target", target.cast("double"))


def _random(key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int(key) & (2**64 - 1)))


def draw(slots: int, parts: np.ndarray, key: int) -> np.ndarray:
    """How many of the slots each part gets, with chances as the parts' sizes."""
    chances = np.asarray(parts, dtype=np.float64)
    return _random(key).multinomial(slots, chances / chances.sum())


def give_up(counts: np.ndarray, slots: int, key: int) -> np.ndarray:
    """How many of some slots, drawn at random, each count loses."""
    return _random(key).multivariate_hypergeometric(np.asarray(counts, dtype=np.int64), slots, method="marginals")


def permuted(values: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutations: values[i] within 0..size[i]-1, by a Feistel network over the next power of four."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.int64)
    # log2 of large sizes may round down
    half = np.where((np.int64(1) << (2 * half)) < size, half + 1, half)
    mask = ((np.int64(1) << half) - 1).astype(kit.U64)
    shift = half.astype(kit.U64)
    out = values.astype(kit.U64)
    walking = np.ones(len(out), dtype=bool)
    limit = size.astype(kit.U64)
    while walking.any():
        x, m, s, k = out[walking], mask[walking], shift[walking], key[walking]
        left, right = x >> s, x & m
        for r in range(FEISTEL_ROUNDS):
            left, right = right, left ^ (kit.combine(k, right, 900 + r) & m)
        out[walking] = (left << s) | right
        walking = out >= limit
    return out.astype(np.int64)


@dataclass
class Mixture:
    docs: DataFrame  #: each document's _source, _id, _hash (of its text), size, first (place of its first word in the source, null without words)
    slots: DataFrame  #: _source, shard, slot, pass, block, take (words of the block, null: all)
    sources: DataFrame  #: _source, source_size, target, blocks
    block: int


def _source(source_col: str) -> Column:
    """Sources as non-null text: all but null have a mark in front."""
    return F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))


@F.pandas_udf(ArrayType(LongType()))
def _draws(total: pd.Series, parts: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([draw(n, p, k) for n, p, k in zip(total, parts, key, strict=True)])


@F.pandas_udf(ArrayType(LongType()))
def _losses(counts: pd.Series, total: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([give_up(c, n, k) for c, n, k in zip(counts, total, key, strict=True)])


def _listed(rows: DataFrame, first: str, count: str, name: str) -> DataFrame:
    """A row for each number from `first` on, `count` of them; runs of numbers are dealt to all tasks before they are listed."""
    runs = rows.where(F.col(count) > 0).withColumn("_run", F.explode(F.sequence(F.lit(0), F.expr(f"({count} - 1) div {SLOT_RUN}")))).repartition(first, "_run")
    return runs.withColumn(name, F.explode(F.sequence(F.expr(f"{first} + _run * {SLOT_RUN}"), F.expr(f"{first} + least({count}, (_run + 1) * {SLOT_RUN}) - 1")))).drop("_run")


def drawn_counts(sources: DataFrame, shards: int, seed: int, kept: list[DataFrame]) -> DataFrame:
    """(_source, shard, here) of sources (_source, n): each shard's multinomial draw, trued up to n slots of each source.

    Tables that the result reads are added to `kept`.
    """
    total = sources.agg(F.sum("n")).first()[0] or 0
    member = F.struct("place", "_source", "n")
    grouped = numbered(sources.select("_source", "n"), ["_source"], {}, kept).withColumn("group", F.expr(f"place div {GROUP}"))
    groups = settle(grouped.groupBy("group").agg(F.array_sort(F.collect_list(member)).alias("members"), F.sum("n").alias("n")))
    kept.append(groups)
    # a row with an entry for GROUP sources, and one for each shard
    tops = groups.agg(F.array_sort(F.collect_list(F.struct("group", "n"))).alias("tops")).where(F.size("tops") > 0)
    size = F.expr(f"{total} div {shards}") + (F.col("shard") < total % shards).cast("long")
    by_group = tops.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("here", _draws(size, F.col("tops.n"), F.xxhash64(F.lit("groups"), "shard", F.lit(seed))))
    by_group = by_group.select("shard", F.inline(F.arrays_zip(F.col("tops.group").alias("group"), "here"))).where("here > 0")
    within = by_group.join(groups.drop("n"), "group").withColumn("counts", _draws("here", F.col("members.n"), F.xxhash64("group", "shard", F.lit(seed))))
    first = within.select("shard", F.inline(F.arrays_zip(F.col("members._source").alias("_source"), "counts"))).where("counts > 0")
    by_source = first.groupBy("_source").agg(F.array_sort(F.collect_list(F.struct("shard", F.col("counts").alias("here")))).alias("held"))
    over = F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + h["here"]) - F.col("n")
    judged = sources.select("_source", "n").join(by_source, "_source", "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<shard:int,here:long>>")))
    judged = judged.withColumn("over", over)
    lost = _losses(F.col("held.here"), F.greatest("over", F.lit(0)), F.xxhash64("_source", F.lit(seed + 1)))
    trimmed = settle(judged.withColumn("lost", lost))
    kept.append(trimmed)
    parts = trimmed.select("_source", F.inline(F.arrays_zip(F.col("held.shard").alias("shard"), F.col("held.here").alias("here"), "lost")))
    # the free places of the shards, in pseudorandom order, and what the other sources lack, in order
    free = parts.groupBy("shard").agg(F.sum("lost").alias("n")).where("n > 0")
    free = free.withColumn("at", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))  # a row for each shard
    places = trimmed.agg(F.sum(F.greatest("over", F.lit(0)))).first()[0] or 0
    lacking = numbered(trimmed.where("over < 0").select("_source", (-F.col("over")).alias("lack")), ["_source"], {"at": "lack"}, kept)
    seats = _listed(free, "at", "n", "seat").withColumn("number", _permute("seat", F.lit(places), F.lit(seed))).select("shard", "number")
    wants = _listed(lacking, "at", "lack", "number").select("_source", "number")
    gained = wants.join(seats, "number").groupBy("_source", "shard").agg(F.count(F.lit(1)).alias("here"))
    held = parts.select("_source", "shard", (F.col("here") - F.col("lost")).alias("here"))
    return held.unionByName(gained).groupBy("_source", "shard").agg(F.sum("here").alias("here")).where("here > 0")


@F.pandas_udf(LongType())
def _permute(value: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    # a place past the whole blocks stays
    value, size = value.to_numpy(), size.to_numpy()
    whole = value < size
    out = value.copy()
    out[whole] = permuted(value[whole], size[whole], key.to_numpy().astype(np.int64).view(kit.U64)[whole])
    return pd.Series(out)


def slots_of(sources: DataFrame, block: int, shards: int, seed: int, kept: list[DataFrame] | None = None) -> DataFrame:
    """The slots of sources (_source, source_size, target, blocks); tables that the result reads are added to `kept`."""
    kept = [] if kept is None else kept
    words = F.round("target").cast("long")
    aim = sources.where("source_size > 0").withColumn("passes", F.floor(words / F.col("source_size")).cast("long"))
    aim = aim.withColumn("rest", words - F.col("passes") * F.col("source_size"))
    aim = aim.withColumn("n", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).where("n > 0")
    key = F.xxhash64("_source", F.lit(seed))
    # settled: the plan of the draw and that of the slots are large enough alone for the driver
    counts = settle(drawn_counts(aim, shards, seed, kept))
    kept.append(counts)
    shares = aim.select("_source", "source_size", "blocks", "n", "rest").join(counts, "_source")
    shares = shares.withColumn("start", F.sum("here").over(Window.partitionBy("_source").orderBy("shard")) - F.col("here"))
    # runs of slots are dealt to all tasks before they are listed
    runs = shares.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(here - 1) div {SLOT_RUN}")))).repartition("_source", "shard", "run")
    listed = runs.withColumn("slot", F.explode(F.sequence(F.expr(f"start + run * {SLOT_RUN}"), F.expr(f"start + least(here, (run + 1) * {SLOT_RUN}) - 1"))))
    last = (F.col("slot") == F.col("n") - 1) & (F.col("rest") > 0)
    return listed.select(
        "_source",
        "shard",
        "slot",
        F.expr("slot div blocks").alias("pass"),
        _permute(F.col("slot") % F.col("blocks"), F.expr(f"source_size div {block}"), key).alias("block"),
        F.when(last, F.col("rest") - (F.ceil(F.col("rest") / block) - 1) * block).alias("take"),
    )


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share=SHARE, repeats=REPEATS, block=BLOCK, shards=SHARDS, seed=7) -> Mixture:
    rows = settle(docs.select(_source(source_col).alias("_source"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), size_of(F.col(text_col)).alias("size")))
    sizes = settle(rows.groupBy("_source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")))
    kept: list[DataFrame] = []
    aims = with_targets(sizes.select("_source", "n"), weights, share, repeats, kept)
    sources = settle(aims.select("_source", F.col("n").alias("source_size"), "target", F.ceil(F.col("n") / block).alias("blocks")))
    # places: prefix sums over chunks, then within each chunk; documents without words have none
    n_docs = sizes.agg(F.sum("docs")).first()[0] or 0
    chunks = max(1, n_docs // max(CHUNK_DOCS, math.isqrt(n_docs)))
    by = F.xxhash64(F.col("_id").cast("string"), F.col("_hash"), F.lit(seed))
    hashed = rows.where("size > 0").withColumn("h", by).withColumn("chunk", F.pmod(F.col("h"), F.lit(chunks)))
    totals = hashed.groupBy("_source", "chunk").agg(F.sum("size").alias("n"))
    ahead = totals.select("_source", "chunk", (F.sum("n").over(Window.partitionBy("_source").orderBy("chunk")) - F.col("n")).alias("ahead"))
    inner = Window.partitionBy("_source", "chunk").orderBy("h", "_id", "_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hashed.withColumn("upto", F.sum("size").over(inner)).join(ahead, ["_source", "chunk"])
    placed = placed.select("_source", "_id", "_hash", "size", (F.col("ahead") + F.col("upto") - F.col("size")).alias("first"))
    wordless = rows.where("size = 0").withColumn("first", F.lit(None).cast("long"))
    # slots are made from a short list, which Spark would take for small: settled, they have their size
    out = Mixture(settle(placed.unionByName(wordless)), settle(slots_of(sources, block, shards, seed, kept)), sources, block)
    discard(rows, sizes, *kept)
    return out


def _cut(docs: DataFrame, b: int) -> DataFrame:
    """docs (with size and first) by the blocks that they touch: block, and the document's words start..stop in it."""
    cut = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {b}"), F.expr(f"(first + size - 1) div {b}"))))
    start = F.greatest(F.lit(0), F.col("block") * b - F.col("first"))
    stop = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("first"))
    return cut.withColumn("start", start).withColumn("stop", stop)


def _taken(b: int) -> Column:
    """Words of a document's part in a block, start..stop, that are taken when `take` words of the block are."""
    upto = F.least(F.col("stop"), F.col("block") * b + F.col("take") - F.col("first"))
    return F.greatest(F.lit(0), F.coalesce(upto, F.col("stop")) - F.col("start"))


def pieces(mixture: Mixture) -> DataFrame:
    """The mixture itself: each slot's parts of documents, with _source, shard, slot, pass, block, _id, _hash,
    first, size, start and stop."""
    parts = _cut(mixture.docs, mixture.block).join(mixture.slots.hint("merge"), ["_source", "block"])
    return parts.withColumn("stop", F.col("start") + _taken(mixture.block)).where("start < stop")


def mixture_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row for each document: id, size, source_size, target (of its source), taken (words, repeats counted)."""
    mixture = plan_mixture(docs, id_col, text_col, source_col, **options)
    # slots are counted by block first, so a document's part meets one row; one slot of a source at most takes a part of its block
    times = mixture.slots.groupBy("_source", "block").agg(F.count_if(F.col("take").isNull()).alias("times"), F.max("take").alias("take"))
    part = F.when(F.col("take").isNull(), F.lit(0)).otherwise(_taken(mixture.block))
    taken = (
        _cut(mixture.docs, mixture.block)
        .join(times.hint("merge"), ["_source", "block"])
        .groupBy("_source", "first")
        .agg(F.sum((F.col("stop") - F.col("start")) * F.col("times") + part).alias("taken"))
    )
    # places within a source tell documents with words apart; those without words have none
    n_sources = mixture.sources.count()
    out = mixture.docs.join(taken, ["_source", "first"], "left").join(bounded_broadcast(mixture.sources, n_sources, BROADCAST_ROWS), "_source")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **options) -> DataFrame:
    """The mixture as documents, columns as in docs: for each pass over a document one row, with the
    words taken in that pass joined by blanks (the text as it is if that is all of them).
    Documents without words are not taken.  length_col, if there, gets the new text's characters."""
    mixture = plan_mixture(docs, id_col, text_col, source_col, **options)
    # rows of one source, id and text are numbered, here and there: which is which does not matter
    copies = mixture.docs.where("size > 0").withColumn("n", F.row_number().over(Window.partitionBy("_source", "_id", "_hash").orderBy("first")))
    spans = (
        pieces(Mixture(copies, mixture.slots, mixture.sources, mixture.block))
        .groupBy("_source", "_id", "_hash", "n", "size", "pass")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")))).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("words"))
        .select(*[F.col(c).alias(f"_mix{c}") for c in ("_source", "_id", "_hash", "n", "size", "spans", "words")])
    )
    keyed = docs.withColumn("_key_source", _source(source_col)).withColumn("_key_hash", F.xxhash64(text_col))
    keyed = keyed.withColumn("_key_n", F.row_number().over(Window.partitionBy("_key_source", id_col, "_key_hash").orderBy("_key_hash")))
    match = (F.col("_key_source") == F.col("_mix_source")) & F.col(id_col).eqNullSafe(F.col("_mix_id")) & (F.col("_key_hash") == F.col("_mix_hash")) & (F.col("_key_n") == F.col("_mixn"))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the words are split once, as the argument of an outer transform, and not for each span
    cut = lambda w: F.array_join(F.flatten(F.transform("_mixspans", lambda s: F.slice(w, s["start"] + 1, s["stop"] - s["start"]))), " ")
    chosen = F.get(F.transform(F.array(words), cut), 0)
    out = keyed.join(spans, match).withColumn(text_col, F.when(F.col("_mixwords") == F.col("_mixsize"), F.col(text_col)).otherwise(chosen))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
