"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are runs of five words of the lower-cased text (a shorter text is one shingle).  A shingle's weight is its count
in the text times its idf, 1 + IDF_SHARE * ln(1 + documents / d) / ln(1 + RARE) with d the documents that hold it, but no
fewer than one in RARE: common shingles count for less, but not so much that members of a large family grow unlike.
Document counts cover the whole corpus and are kept in a table of fixed size, hashed.  What a cell holds on average is
taken off each cell: over many documents rare shingles fill all cells evenly and only common ones stand out, over few
documents a cell holds one shingle, so idf means the same at every size.  Weights are rounded to steps
of 1/16 in the logarithm, in samples and in verification alike.

Improved consistent weighted sampling draws for each shingle and sample r, c ~ Gamma(2, 1) and
beta ~ U(0, 1) from the shingle's hash, t = floor(ln(w) / r + beta), and takes the shingle with the
smallest ln(c) - r (t - beta + 1); two texts agree on (shingle, t) with their weighted Jaccard
similarity as probability.  `BANDS` bands of `ROWS` samples are the buckets: a pair at 0.8 meets
in one with probability 0.9996.

Links are sought without listing the pairs of a bucket, so that the work stays linear in a large
family of copies.  A text's centrality is the number of texts in its buckets, summed: the original of
many copies shares buckets with most of them.  The LEADERS most central texts of each bucket are
compared with its other members, each text with the COMPARED most central of the leaders that it meets, in
ROUNDS: with the first, then, as far as they are not of its class yet, with the next.  Classes are the components
of the links.  A bucket of up to LEADERS + 1 texts is thus compared in full (while its texts meet no
more than COMPARED leaders).  In the other buckets that still hold several classes, the members are
dealt into chunks and each pair of chunks is compared: every pair of texts of different classes, in the first
bucket that they share.  So two texts that share a bucket and are alike are always of one class.  Members of
one class are not compared again, and a class that fills a chunk has chunks of its own, which
don't meet each other.  Every link used is verified by the exact weighted Jaccard
similarity of the two texts' shingles; before, pairs are dropped whose similarity can't reach the
threshold, by an upper bound from the weights summed in SUMS cells.

Cases: copies of a text are one node.  A null text is a class of its own, as is a text without
words unless an equal text exists.  Rows without an id get a null class.  Rows of one id form one
document.  Ties of centrality go to the smaller id.  Very long texts are read whole.  No rows give no rows.  Extra
columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as kit
from .shared import discard, each_batch, settle, small_batches

SHINGLE = 5
BANDS, ROWS = 20, 5
#: Cells of the table of document counts, and the chunks it travels in.
CELLS, CHUNKS = 1 << 18, 256
IDF_SHARE, RARE = 0.25, 512
#: Weight levels: 16 to a factor of e; level LEVEL_ONE is weight 1.
LEVEL_STEPS, LEVEL_ONE, LEVELS = 16.0, 64, 256
_PAIRS_R, _CUTS_C = 1 << 12, 1 << 18
_SHINGLE_BITS = 48
#: Leaders of a bucket, leaders that a text is compared with, and the last rank of each round.
LEADERS, COMPARED, ROUNDS = 4, 24, (1, 6, 24)
#: Texts of a chunk, and their packed bytes, on average.
CHUNK, CHUNK_BYTES = 128, 1 << 22
#: Cells of a text's weight sums, and their unit; a sum is rounded up, and SUM_LIMIT stands for more.
SUMS, SUM_UNIT, SUM_LIMIT = 256, 1 / 16, 0xFFFF


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For (level, draw): the part of ln(a) that r and beta give, and t; ln(c) for each draw of c."""
    rng = np.random.RandomState(20240101)
    r = -np.log(rng.uniform(1e-12, 1, _PAIRS_R) * rng.uniform(1e-12, 1, _PAIRS_R))
    beta = rng.uniform(0, 1, _PAIRS_R)
    ln_w = (np.arange(LEVELS) - LEVEL_ONE) / LEVEL_STEPS
    t = np.floor(ln_w[:, None] / r[None, :] + beta[None, :])
    part = (-r[None, :] * (t - beta[None, :] + 1)).astype(np.float32)
    ln_c = np.log(-np.log(rng.uniform(1e-12, 1, _CUTS_C) * rng.uniform(1e-12, 1, _CUTS_C))).astype(np.float32)
    return part.ravel(), t.astype(np.int64).ravel(), ln_c


_TABLES: list = []


def _tables():
    if not _TABLES:
        _TABLES.append(_draws())
    return _TABLES[0]


def shingles(words: kit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a block: document, 48-bit shingle, count; by document and shingle."""
    per = np.diff(words.ptr)
    h = kit.rolling(words.hashes, SHINGLE, 21)
    ok = kit.within(words.ptr, SHINGLE)
    at = np.flatnonzero(ok)
    doc, value = np.searchsorted(words.ptr, at, side="right") - 1, h[at]
    short = np.flatnonzero((per > 0) & (per < SHINGLE))
    if len(short):
        whole = np.empty(len(short), dtype=kit.U64)
        for i, d in enumerate(short):
            part = words.hashes[words.ptr[d] : words.ptr[d + 1]]
            whole[i] = kit.rolling(part, len(part), 22)[0]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, whole])
    if words.docs >= 1 << (64 - _SHINGLE_BITS):
        raise ValueError("a block holds too many documents")
    key = (doc.astype(kit.U64) << kit.U64(_SHINGLE_BITS)) | (value >> kit.U64(64 - _SHINGLE_BITS))
    key.sort()
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> kit.U64(_SHINGLE_BITS)).astype(np.int64), key & kit.U64((1 << _SHINGLE_BITS) - 1), count


def _cell(shingle: np.ndarray) -> np.ndarray:
    return (kit.splitmix(shingle, 31) & kit.U64(CELLS - 1)).astype(np.int64)


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with a shingle of each cell, and all documents."""

    def partial(batches):
        counts, docs = np.zeros(CELLS, dtype=np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for words in kit.blocks(batch.column("text"), kit.BLANK_SPLIT, fold=True):
                _, shingle, _ = shingles(words)
                counts += np.bincount(_cell(shingle), minlength=CELLS)
        if docs:
            chunk = counts.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(CHUNKS + 1)), pa.array([x.astype(np.int64).tobytes() for x in chunk] + [np.int64(docs).tobytes()])], names=["chunk", "counts"]
            )

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in pdf["counts"])
        return pd.DataFrame({"salt": [0], "chunk": [pdf["chunk"].iloc[0]], "counts": [total.tobytes()]})

    schema = "salt long, chunk long, counts binary"
    parts = texts.mapInArrow(partial, "chunk long, counts binary").withColumn("salt", F.spark_partition_id() % 64)
    sums = parts.groupBy("salt", "chunk").applyInPandas(added, schema).groupBy("chunk").applyInPandas(added, schema)
    # CHUNKS + 1 rows of fixed size, whatever the input
    found = {r.chunk: np.frombuffer(r.counts, dtype=np.int64) for r in sums.collect()}
    if not found:
        return np.zeros(CELLS, dtype=np.int64), 0
    return np.concatenate([found[i] for i in range(CHUNKS)]), int(found[CHUNKS][0])


def idf_table(counts: np.ndarray, docs: int) -> np.ndarray:
    others = (counts.sum() - counts) / (CELLS - 1)
    own = np.maximum(counts - others, max(1, docs / RARE))
    return 1 + IDF_SHARE * np.log1p(docs / own) / np.log1p(max(1, min(docs, RARE)))


def weight_levels(shingle: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    level = np.rint(LEVEL_STEPS * np.log(count * idf[_cell(shingle)])).astype(np.int64) + LEVEL_ONE
    return np.clip(level, 0, LEVELS - 1)


def band_keys(doc: np.ndarray, shingle: np.ndarray, level: np.ndarray, docs: int) -> np.ndarray:
    """The band keys of each document that has shingles; rows of other documents are 0."""
    part, ts, ln_c = _tables()
    keys = np.zeros((docs, BANDS), dtype=kit.U64)
    if not len(doc):
        return keys
    has, first = np.unique(doc, return_index=True)
    size = np.diff(np.append(first, len(doc)))
    base = level * _PAIRS_R
    place = np.arange(len(doc))
    made = np.zeros((len(has), BANDS), dtype=kit.U64)
    for k in range(0, BANDS * ROWS, 2):
        bits = kit.splitmix(shingle, 100 + k)
        for sample in (k, k + 1):
            low = (bits & kit.U64(0xFFFFFFFF)).astype(np.int64)
            cell = base + (low & (_PAIRS_R - 1))
            value = part[cell] + ln_c[low >> 14]
            least = np.minimum.reduceat(value, first)
            at = np.flatnonzero(value == np.repeat(least, size))
            at = at[np.searchsorted(at, first)]
            chosen = kit.combine(shingle[at], ts[cell[at]].view(kit.U64), sample)
            band = sample // ROWS
            made[:, band] = kit.combine(made[:, band], chosen, band)
            bits = bits >> kit.U64(32)
    keys[has] = made
    return keys


def _signatures(batch: pa.RecordBatch, idf: np.ndarray):
    for words in kit.blocks(batch.column("text"), kit.BLANK_SPLIT, fold=True):
        doc, shingle, count = shingles(words)
        keys = band_keys(doc, shingle, weight_levels(shingle, count, idf), words.docs)
        some = np.flatnonzero(np.diff(words.ptr) > 0)
        row = pa.array(some + words.first)
        flat = pa.array(keys[some].ravel().view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id").take(row), batch.column("digest").take(row), pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(some) + 1, BANDS, dtype=np.int32)), flat)],
            names=["_id", "digest", "keys"],
        )


def _weighted(batch: pa.RecordBatch, idf: np.ndarray):
    """The shingles and weight levels of each text, packed: 6 bytes and 1 byte each; and its weight and the sums by cell."""
    for words in kit.blocks(batch.column("text"), kit.BLANK_SPLIT, fold=True):
        doc, shingle, count = shingles(words)
        level = weight_levels(shingle, count, idf).astype(np.uint8)
        cut = np.searchsorted(doc, np.arange(words.docs + 1))
        low, high = shingle.astype(np.uint32), (shingle >> kit.U64(32)).astype(np.uint16)
        packed = [low[a:b].tobytes() + high[a:b].tobytes() + level[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        weight = _WEIGHT[level]
        cell = doc * SUMS + (kit.splitmix(shingle, 71) & kit.U64(SUMS - 1)).astype(np.int64)
        cells = np.bincount(cell, weights=weight, minlength=words.docs * SUMS).reshape(words.docs, SUMS)
        cells = np.minimum(np.ceil(cells / SUM_UNIT), SUM_LIMIT).astype(np.uint16)
        total = np.bincount(doc, weights=weight, minlength=words.docs)
        sums = [t.tobytes() + c.tobytes() for t, c in zip(total, cells, strict=True)]
        rows = pa.array(np.arange(words.first, words.first + words.docs))
        yield pa.RecordBatch.from_arrays([batch.column("_id").take(rows), pa.array(packed, pa.binary()), pa.array(sums, pa.binary())], names=["_id", "packed", "sums"])


_WEIGHT = np.exp((np.arange(LEVELS) - LEVEL_ONE) / LEVEL_STEPS)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 7
    low, high = np.frombuffer(packed, dtype=np.uint32, count=n), np.frombuffer(packed, dtype=np.uint16, count=n, offset=4 * n)
    return low.astype(kit.U64) | (high.astype(kit.U64) << kit.U64(32)), _WEIGHT[np.frombuffer(packed, dtype=np.uint8, offset=6 * n)]


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Sum of smaller weights over sum of larger weights; both lists are sorted by shingle."""
    (x, wx), (y, wy) = _unpack(a), _unpack(b)
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = x[at] == y
    least = np.minimum(wx[at[both]], wy[both]).sum()
    total = wx.sum() + wy.sum() - least
    return float(least / total)


def greatest_similarity(a: bytes, b: bytes) -> float:
    """No less than the weighted Jaccard similarity of two texts, from their sums."""
    x, y = np.frombuffer(a, dtype=np.uint16, offset=8), np.frombuffer(b, dtype=np.uint16, offset=8)
    least = np.minimum(x, y)
    if (least == SUM_LIMIT).any():
        return 1.0
    total = np.frombuffer(a, dtype=np.float64, count=1)[0] + np.frombuffer(b, dtype=np.float64, count=1)[0]
    both = min(least.sum(dtype=np.int64) * SUM_UNIT, total / 2)
    return float(both / (total - both)) if total else 0.0


def _sums_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cell sums of a column of sums, which are all of one length."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
    return np.ascontiguousarray(raw[:, :8]).view(np.float64).ravel(), np.ascontiguousarray(raw[:, 8:]).view(np.uint16)


def greatest_similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """greatest_similarity of each pair of two columns of sums."""
    if not len(a):
        return np.zeros(0)
    (x, cells_x), (y, cells_y) = _sums_of(a), _sums_of(b)
    least, total = np.minimum(cells_x, cells_y), x + y
    both = np.minimum(least.sum(axis=1, dtype=np.int64) * SUM_UNIT, total / 2)
    found = np.divide(both, total - both, out=np.zeros(len(total)), where=total > 0)
    return np.where((least == SUM_LIMIT).any(axis=1), 1.0, found)


def _possible(batch: pa.RecordBatch, threshold: float):
    keep = greatest_similarities(batch.column("sums_a"), batch.column("sums_b")) >= threshold - 1e-9
    yield batch.select(["a", "b"]).filter(pa.array(keep))


def _linked(batch: pa.RecordBatch, threshold: float):
    a, b = batch.column("packed_a"), batch.column("packed_b")
    keep = [weighted_jaccard(x.as_py(), y.as_py()) >= threshold for x, y in zip(a, b, strict=True)]
    yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _joined(bucket: int, left: list, right: list | None, threshold: float):
    """Links that join the classes of two chunks of a bucket (right None: of one chunk) as far as any pair's similarity does."""
    rows = left + (right or [])
    sums = np.stack([np.frombuffer(r["sums"], dtype=np.uint16, offset=8) for r in rows])
    totals = np.array([np.frombuffer(r["sums"], dtype=np.float64, count=1)[0] for r in rows])
    keys = np.array([r["keys"] for r in rows], dtype=np.int64)
    root = np.unique(np.array([r["class"] for r in rows], dtype=np.int64), return_inverse=True)[1]
    for i in range(len(left)):
        others = np.arange(i + 1 if right is None else len(left), len(rows))
        others = others[root[others] != root[i]]
        # a pair is compared in the first bucket that it shares
        same = keys[others] == keys[i]
        others = others[keys[others, same.argmax(axis=1)] == bucket] if len(others) else others
        if not len(others):
            continue
        least = np.minimum(sums[others], sums[i])
        total = totals[others] + totals[i]
        both = np.minimum(least.sum(axis=1, dtype=np.int64) * SUM_UNIT, total / 2)
        possible = (both >= (threshold - 1e-9) * (total - both)) | (least == SUM_LIMIT).any(axis=1)
        for j in others[possible]:
            if root[i] != root[j] and weighted_jaccard(rows[i]["packed"], rows[j]["packed"]) >= threshold:
                root[root == root[j]] = root[i]
                yield rows[i]["node"], rows[j]["node"]


def _finished(batches, threshold: float):
    """Links of pairs of chunks; the rows of each are consecutive."""

    def links(held):
        left, right = ([r for r in held if r["second"] == x] for x in (False, True))
        found = list(_joined(held[0]["bucket"], left, None if held[0]["alone"] else right, threshold))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[c] != held[0][c] for c in ("bucket", "ca", "cb")):
                yield links(held)
                held = []
            held.append(row)
    if held:
        yield links(held)


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links, root the smallest node that it is connected to.

    Alternates large stars and small stars until the links form stars around the roots; each
    round is a min per node and a join, written to the shared folder.
    """
    edges, before = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_least.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        edges = settle(small)
        if before is not None:
            discard(before)
        before = edges
        # stars: a node hangs on one root only, and no root hangs on another
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("root")).unionByName(
            edges.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("root"))
        )
        if ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("root").alias("root")).where("hangs + root > 1").isEmpty():
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._tidemark_path = edges._tidemark_path
            return out


def _rest(members: DataFrame, classes: DataFrame, drawn: DataFrame, nodes: DataFrame, weighed: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different classes in the buckets that the rounds did not compare in full, settled."""
    capped = drawn.where(F.col("n") > COMPARED).select(F.col("b").alias("node"), F.lit(1).alias("capped"))
    sizes = weighed.select(F.col("_id").alias("node"), F.length("packed").alias("bytes"))
    known = classes.select("node", "root").join(capped, "node", "full_outer")
    placed = settle(
        members.select("bucket", "node").join(known, "node", "left").join(sizes, "node").select("bucket", "node", F.coalesce("root", "node").alias("class"), F.coalesce("capped", F.lit(0)).alias("capped"), "bytes")
    )
    groups = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("texts"), F.sum("bytes").alias("bytes"), F.max("capped").alias("capped"))
    unsettled = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("texts").alias("all"), F.max("capped").alias("any_capped"))
    unsettled = unsettled.where((F.col("classes") > 1) & ((F.col("all") > LEADERS + 1) | (F.col("any_capped") > 0))).select("bucket")
    # classes that fill a chunk are units of their own, the others of a bucket one unit
    big = F.col("texts") >= CHUNK
    grouped = settle(groups.join(unsettled, "bucket").select("bucket", "class", "texts", "bytes", F.struct(big.alias("big"), F.when(big, F.col("class")).otherwise(0).alias("of")).alias("unit")))
    parts = F.ceil(F.greatest(F.sum("texts") / CHUNK, F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("parts")
    units = settle(grouped.groupBy("bucket", "unit").agg(parts))
    chunks = units.select("bucket", "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("bucket", F.struct("unit", "part").alias("chunk"))
    other = chunks.select("bucket", F.col("chunk").alias("cb"))
    pairs = chunks.withColumnRenamed("chunk", "ca").join(other, "bucket").where("ca <= cb and not (ca.unit.big and ca.unit = cb.unit)")
    ends = pairs.select("bucket", "ca", "cb", (F.col("ca") == F.col("cb")).alias("alone"), F.explode(F.array_distinct(F.array("ca", "cb"))).alias("chunk"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    dealt = placed.join(grouped.select("bucket", "class", "unit"), ["bucket", "class"]).join(units, ["bucket", "unit"]).select("bucket", F.struct("unit", part).alias("chunk"), "node", "class")
    texts = weighed.select(F.col("_id").alias("node"), "packed", "sums").join(nodes.select("node", "keys"), "node")
    rows = ends.join(dealt, ["bucket", "chunk"]).join(texts, "node").select("bucket", "ca", "cb", "alone", (F.col("chunk") != F.col("ca")).alias("second"), "node", "class", "packed", "sums", "keys")
    rows = rows.repartition("bucket", "ca", "cb").sortWithinPartitions("bucket", "ca", "cb")
    found = settle(rows.mapInArrow(lambda batches: _finished(batches, threshold), "a long, b long"))
    discard(placed, grouped, units)
    return found


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, class_id): one row for each row of docs; class_id is the smallest id of the class."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("digest"), F.lower(text_col).alias("text")
    )
    counts, n_docs = document_counts(texts.select("text"))
    idf = spark.sparkContext.broadcast(idf_table(counts, n_docs))
    signed = each_batch(lambda b: _signatures(b, idf.value), "_id long, digest binary, keys array<long>", texts)
    nodes = settle(signed.groupBy("digest").agg(F.min("_id").alias("node"), F.first("keys").alias("keys")))
    entries = nodes.select("node", F.explode("keys").alias("bucket"))
    # buckets with more than one text, and how central their texts are
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("p"), F.max("node").alias("q")).where("p < q").select("bucket", "texts")
    entries = settle(entries.join(shared, "bucket").select("bucket", "node", "texts"))
    central = entries.groupBy("node").agg(F.sum("texts").alias("central"))
    members = settle(entries.join(central, "node").select("bucket", "node", "central"))
    discard(entries)
    needed = members.select("node").distinct().join(nodes.select("node", "digest"), "node")
    weighed = settle(
        each_batch(
            lambda b: _weighted(b, idf.value),
            "_id long, packed binary, sums binary",
            texts.join(needed.withColumnRenamed("node", "_id").hint("shuffle_hash"), ["_id", "digest"]).dropDuplicates(["_id", "digest"]).select("_id", "text"),
        )
    )

    def sides(pairs: DataFrame, column: str) -> DataFrame:
        side = lambda c: weighed.select(F.col("_id").alias(c), F.col(column).alias(f"{column}_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", f"{column}_a", f"{column}_b")

    def verified(pairs: DataFrame) -> DataFrame:
        possible = each_batch(lambda x: _possible(x, threshold), "a long, b long", sides(pairs, "sums"))
        return settle(each_batch(lambda x: _linked(x, threshold), "a long, b long", sides(possible, "packed")))

    first = Window.partitionBy("bucket").orderBy(F.desc("central"), "node")
    leaders = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= LEADERS).select("bucket", F.col("node").alias("leader"), F.col("central").alias("c"))
    met = members.select("bucket", "node").join(leaders, "bucket").where("node <> leader").groupBy("node", "leader").agg(F.max("c").alias("c"))
    rank = Window.partitionBy("node").orderBy(F.desc("c"), "leader")
    drawn = settle(met.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= COMPARED + 1).select(F.col("leader").alias("a"), F.col("node").alias("b"), "n"))
    idf.destroy()
    done, classes = 0, None

    def joined(more: DataFrame) -> DataFrame:
        """The classes with more links; those so far are stars already and stand for their links."""
        if classes is None:
            return connected(more)
        out = connected(more.unionByName(classes.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(classes)
        return out

    for last in ROUNDS:
        pairs = drawn.where((F.col("n") > done) & (F.col("n") <= last)).select("a", "b")
        if classes is not None:
            la, lb = classes.select(F.col("node").alias("a"), F.col("root").alias("la")), classes.select(F.col("node").alias("b"), F.col("root").alias("lb"))
            pairs = pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        done, more = last, verified(pairs)
        if classes is None or not more.isEmpty():
            classes = joined(more)
        discard(more)
    more = _rest(members, classes, drawn, nodes, weighed, threshold)
    if not more.isEmpty():
        classes = joined(more)
    discard(more)
    by_text = settle(nodes.select("digest", "node").join(classes, "node", "left").select("digest", F.coalesce("root", "node").alias("class_id")))
    discard(members, weighed, drawn, nodes, classes)
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("digest"))
    # texts without words have no signature: equal ones are one class still
    bare = keyed.where(F.col("_id").isNotNull() & F.col("digest").isNotNull()).groupBy("digest").agg(F.min("_id").alias("least_id"))
    return (
        keyed.join(by_text.join(bare, "digest", "full_outer"), "digest", "left")
        .select(F.col("_id").alias(id_col), F.when(F.col("_id").isNotNull(), F.coalesce("class_id", "least_id", "_id")).alias("class_id"))
    )
