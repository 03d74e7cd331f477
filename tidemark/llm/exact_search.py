"""Exact top-k search by inner product, with candidates eliminated by a table of pivots.

Vectors are lifted so that larger inner products are smaller distances: a candidate x becomes
(x, sqrt(M - |x|^2)) with M the largest squared length, a query q becomes (q, 0); then
|q - x|^2 = |q|^2 + M - 2 qx.  Every candidate's distances to the pivots are computed once per
block; the largest |d(q, p) - d(x, p)| over the pivots p is a lower bound of d(q, x).  Candidates
are evaluated in the order of their bounds, STEP at a time and then more, until the bound passes the k-th best
distance: the rest can't be among the k best, and no candidate beyond is scored.  The k-th best starts at a score
that k rows of a sample reach, so each block reports few rows.  Distances to pivots are kept as 16-bit whole steps and bounds are
loosened by more than that rounding; scores are integers and exact.

The candidates and the queries are dealt into blocks of BLOCK_ROWS and QUERY_BLOCK rows by their
hashes, and one join brings each pair of blocks together in a task; nothing but a sample of SAMPLE rows, the pivots among
them, passes through the driver.  Partial lists are merged by rank.

Cases: vectors that are null or that hold null or non-finite components take no part; nor do rows without an id.
A vector that is shorter than others counts as filled up with zeros, an empty one as all zeros.  Rows that repeat an
id are candidates each (never of their own id's queries); a query id that repeats is answered for its first vector (by
components).  Ties go to the smaller id.  No rows, or no queries among them, give no rows.  Extra columns are not
carried.  Scores beyond 2**53 are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship

QUERY_BLOCK, BLOCK_ROWS = 8192, 8192
PIVOTS = 256
#: Rows of the sample that pivots and first thresholds come from.
SAMPLE = 2048
STEP = 512
#: Candidates whose bounds, and queries whose first limits, are found at a time.
TILE = 1024


def scaled(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component, x as double; null for vectors that take no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * factor).cast("double")))


def choose_pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next pivot is the row farthest from those chosen."""
    chosen = [int(np.argmax((rows**2).sum(axis=1)))]
    far = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(rows)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(largest - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, pivots: np.ndarray, largest: float, k: int):
    """For each query: its number, the ids and scores of its k best in the block that reach `least`, a score that k rows
    are known to reach, and how many candidates were scored."""
    to_pivots = _distances(lifted(x, largest), pivots).T
    from_query = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots)
    lengths = (q**2).sum(axis=1)
    # whole steps of a length: a difference of two is at most one more than that of the distances
    steps = 32000 / max(float(to_pivots.max(initial=0)), float(from_query.max(initial=0)), 1e-9)
    to_pivots = np.ascontiguousarray(to_pivots * steps, dtype=np.int16)
    from_query = (from_query * steps).astype(np.int16)

    def reach(i: int, score: float) -> float:
        # d^2 = |q|^2 + M - 2 score: a bound above this distance can't reach the score
        return (float(np.sqrt(max(0.0, lengths[i] + largest - 2 * score))) * (1 + 1e-9) + 1e-6) * steps + 2

    # whole numbers, kept narrow: rows are picked one by one.  No sum of their products is larger than the largest squared length
    widest = float(np.abs(x).max(initial=0))
    x = x.astype(next((t for t, most in ((np.int8, 127), (np.int16, 32767)) if widest <= most), np.float64))
    kind = np.float32 if largest < 2**24 else np.float64
    q = q.astype(kind)
    bound = np.empty(len(ids), dtype=np.int16)
    gap = np.empty((len(pivots), TILE), dtype=np.int16)
    for i in range(len(q)):
        own = from_query[i][:, None]
        for at in range(0, len(ids), TILE):
            tile = to_pivots[:, at : at + TILE]
            far = gap[:, : tile.shape[1]]
            np.subtract(tile, own, out=far)
            np.abs(far, out=far).max(axis=0, out=bound[at : at + TILE])
        floor_score, scored = float(least[i]), 0
        limit = reach(i, floor_score)
        best_ids, best_scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        # the candidates with the smallest bounds first, STEP of them, then twice as many each time
        order = np.argsort(bound, kind="stable")
        ranked = bound[order]
        size = STEP
        while scored < len(order) and ranked[scored] <= limit:
            stop = min(scored + size, int(np.searchsorted(ranked, min(limit, 32767), side="right")))
            rows = order[scored:stop]
            scores = np.take(x, rows, axis=0).astype(kind) @ q[i]
            keep = np.flatnonzero(scores >= floor_score)
            keep = keep[ids[rows[keep]] != query_ids[i]]
            best_ids, best_scores = np.append(best_ids, ids[rows[keep]]), np.append(best_scores, scores[keep].astype(np.float64))
            if len(best_ids) > k:
                top = np.lexsort((best_ids, -best_scores))[:k]
                best_ids, best_scores = best_ids[top], best_scores[top]
            if len(best_ids) == k:
                floor_score = max(floor_score, float(best_scores.min()))
                limit = reach(i, floor_score)
            scored, size = stop, 2 * size
        yield i, best_ids, best_scores, scored


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (the first two columns), shorter ones filled up with zeros."""
    lists = table.column(1).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return table.column(0).to_numpy(), out


def _dealt(rows: DataFrame, blocks: int, seed: int) -> DataFrame:
    return rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_x", F.lit(seed)), F.lit(blocks)).cast("int"))


def searched(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 64.0) -> DataFrame | None:
    """(query_id, _id, score, scored): for each query the best of each block; scored: candidates of the block that were
    evaluated for it (on one row of the block, which has no _id).  None if there are no queries."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), queries.alias("_asked"), scaled(F.col(vector_col), factor).alias("_x")).where("_x is not null")
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("_asked").alias("asked"),
        F.max(F.size("_x")).alias("width"),
        F.max(F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v)).alias("largest"),
    ).first()
    if not facts.asked:
        return None
    if facts.largest >= 2**53:
        raise ValueError("components are too large for exact scores")
    largest, width = float(facts.largest), max(1, facts.width)
    # a sample of bounded size: the smallest hashes
    drawn = rows.select("_id", "_x").orderBy(F.xxhash64("_id", F.lit(3)), "_id", "_x").limit(SAMPLE).toArrow()
    sample_ids, sample = _matrix(drawn, width)
    pivots = choose_pivots(lifted(sample, largest), PIVOTS)
    shared = spark.sparkContext.broadcast((sample_ids, sample, pivots))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        sample_ids, sample, pivots = shared.value
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            (ids, x), (query_ids, q) = _matrix(left, width), _matrix(right, width)
            least = np.full(len(q), -(2.0**53))
            for at in range(0, len(q) if len(sample) >= k else 0, TILE):
                scores = sample @ q[at : at + TILE].T
                scores[sample_ids[:, None] == query_ids[None, at : at + TILE]] = -np.inf
                least[at : at + TILE] = np.maximum(least[at : at + TILE], np.partition(scores, len(sample) - k, axis=0)[len(sample) - k])
            total = np.zeros(len(q), dtype=np.int64)
            for i, b, s, total[i] in search_block(ids, x, query_ids, q, least, pivots, largest, k):
                out[0].append(np.full(len(b), query_ids[i]))
                out[1].append(b)
                out[2].append(s.astype(np.int64))
            column = lambda parts, more: pa.array(np.concatenate([*parts, more]))
            found = sum(map(len, out[1]))
            blank = np.arange(found + len(q)) >= found
            zeros = np.zeros(len(q), dtype=np.int64)
            return pa.table(
                {
                    "query_id": column(out[0], query_ids),
                    "_id": pa.array(np.concatenate([*out[1], zeros]), mask=blank),
                    "score": pa.array(np.concatenate([*out[2], zeros]), mask=blank),
                    "scored": pa.array(np.concatenate([np.zeros(found, dtype=np.int64), total]), mask=~blank),
                }
            )
        return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "_id", "score", "scored")})

    n_query, n_rows = (-(-n // size) for n, size in ((facts.asked, QUERY_BLOCK // 2), (facts.rows, BLOCK_ROWS // 2)))
    asked = rows.where("_asked").groupBy("_id").agg(F.min("_x").alias("_x"))
    left = _dealt(rows.select("_id", "_x"), n_rows, 11).withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    right = _dealt(asked, n_query, 13).select(F.col("_id").alias("_qid"), F.col("_x").alias("_qx"), F.col("_block").alias("_qof"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("_qblock"))
    pairs = left.groupBy("_block", "_of").cogroup(right.groupBy("_qblock", "_qof"))
    return pairs.applyInArrow(scan, "query_id long, _id long, score long, scored long")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 64.0) -> DataFrame:
    """(query_id, rank, <id_col>, score): for each row with the condition `queries`, its k best other rows."""
    found = searched(vectors, queries, k, id_col, vector_col, factor)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    ranked = found.where("_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")
