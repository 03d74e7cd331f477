"""Exact centroid clustering of whole-number vectors with exponion search.

Rounds of Lloyd's method: every vector is assigned to its nearest centroid, then every centroid that has vectors
moves to the floor of their mean.  Between rounds a vector carries its cluster, an upper bound of the distance to that
centroid and a lower bound of the distance to any other; when centroids move, the bounds are moved with them.

* A vector whose upper bound is less than its lower bound, or than half the distance from its centroid to the next
  one, keeps its cluster without a distance being computed.
* Else its own distance is computed, and if that settles nothing, the centroids in a ball around its centroid are
  scanned: those not farther from it than twice the distance plus the distance to the centroid's nearest neighbour, read
  off the sorted list of the centroid's distances to the others.  The ball holds the nearest centroid and the second
  one, so both bounds are exact after a scan; its rim belongs to it, and bounds that are equal settle nothing, so a tie
  is always seen and goes to the smaller number.

Distances that decide are squared whole numbers; bounds are floating, and loosened by more than their rounding.

Each round is one pass over a settled table of (id, components as packed bytes, cluster, bounds): a task reads it batch by
batch, writes the next table, and adds for each centroid what its movers bring and take (their number and the sums of
their components), as rows of the same table.  Only these rows, centroids times components for each task, are
summed in Spark and reach the driver, with the centroids; no vector is shuffled.  The table before is deleted.

Cases: vectors that are null, of another length, or that hold null or non-finite components take no part.  A null id stays
and is never a seed.  Rows that repeat are vectors each; of seeds that repeat an id the one with the lesser components
comes first, so two centroids may be equal (the first gets all).  Fewer vectors than clusters give fewer centroids, none
no rows.  Extra columns are not carried.  Vectors so long that a squared distance could pass 2**53 are refused with an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import discard, settle

#: Loosens floating bounds: far more than rounding adds in a hundred rounds, for distances under 2**27.
SLACK = 1e-6
_SCHEMA = "_id long, x binary, cluster int, upper double, lower double, moved int, n long, sums array<long>"


def whole(vector: Column, width: int, factor: float) -> Column:
    """floor(factor * x) of each component, x as double; null for vectors that take no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(vector) == width) & ~bad, F.transform(x, lambda v: F.floor(v * factor).cast("double")))


class Centroids:
    """The centroids of a round, how far each one moved to get there, and its neighbours by distance."""

    def __init__(self, places: np.ndarray, before: np.ndarray | None = None):
        self.places = places
        k = len(places)
        apart = np.sqrt(((places[:, None, :] - places[None, :, :]) ** 2).sum(axis=2, dtype=np.float64))
        np.fill_diagonal(apart, -1.0)
        #: each centroid itself, then the others by distance
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.apart[:, 0] = 0.0
        self.next = self.apart[:, 1] if k > 1 else np.full(k, np.inf)
        moves = np.zeros(k) if before is None else np.sqrt(((places - before) ** 2).sum(axis=1, dtype=np.float64))
        self.moves = moves
        # of all centroids but one, the farthest move
        farthest = int(np.argmax(moves))
        self.other_moves = np.full(k, moves[farthest])
        self.other_moves[farthest] = np.delete(moves, farthest).max(initial=0.0)


def _squared(x: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Exact squared distances of some rows to a centroid each."""
    gap = x[rows] - places
    return np.einsum("ij,ij->i", gap, gap)


def nearest_of_all(x: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and both bounds of each vector by a scan of all centroids."""
    best, second = np.full(len(x), np.inf), np.full(len(x), np.inf)
    cluster = np.zeros(len(x), dtype=np.int32)
    rows = np.arange(len(x))
    for c, place in enumerate(at.places):
        _better(best, second, cluster, rows, _squared(x, rows, place), np.full(len(x), c, dtype=np.int32))
    return cluster, np.sqrt(best), np.sqrt(second)


def _better(best: np.ndarray, second: np.ndarray, cluster: np.ndarray, rows: np.ndarray, squared: np.ndarray, number: np.ndarray) -> None:
    """Take a candidate's squared distance into the two least of each row; equal ones go to the smaller number."""
    first = (squared < best[rows]) | ((squared == best[rows]) & (number < cluster[rows]))
    second[rows] = np.where(first, best[rows], np.minimum(second[rows], squared))
    best[rows] = np.where(first, squared, best[rows])
    cluster[rows] = np.where(first, number, cluster[rows])


def reassigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds after the centroids moved, and how many distances were computed."""
    cluster, upper, lower = cluster.copy(), upper + at.moves[cluster], lower - at.other_moves[cluster]
    enough = np.maximum(lower, at.next[cluster] / 2)
    rows = np.flatnonzero(upper >= enough - SLACK)
    own = _squared(x, rows, at.places[cluster[rows]])
    upper[rows] = np.sqrt(own)
    computed = len(rows)
    open_ = upper[rows] >= enough[rows] - SLACK
    rows, own = rows[open_], own[open_]
    if len(rows):
        start = cluster[rows]
        radius = 2 * upper[rows] + at.next[start] + SLACK
        best, second, found = own.copy(), np.full(len(rows), np.inf), start.copy()
        left = np.arange(len(rows))
        for step in range(1, len(at.places)):
            left = left[at.apart[start[left], step] <= radius[left]]
            if not len(left):
                break
            number = at.order[start[left], step].astype(np.int32)
            _better(best, second, found, left, _squared(x, rows[left], at.places[number]), number)
            computed += len(left)
        cluster[rows], upper[rows] = found, np.sqrt(best)
        # a centroid outside the ball is farther than the nearest neighbour of the centroid that the scan began with
        lower[rows] = np.sqrt(second)
    return cluster, upper, lower, computed


def _packed(batch_x: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(batch_x)
    step = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def _unpacked(column: pa.Array, width: int, kind: np.dtype) -> np.ndarray:
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(kind).reshape(len(column), width).astype(np.float64)


def _changes(x: np.ndarray, was: np.ndarray, now: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
    """Add to each cluster's count and component sums what the movers bring and take."""
    movers = np.flatnonzero(was != now)
    moved = x[movers].astype(np.int64)
    for clusters, sign in ((now[movers], 1), (was[movers], -1)):
        for c in np.unique(clusters[clusters >= 0]):
            rows = clusters == c
            count[c] += sign * int(rows.sum())
            sums[c] += sign * moved[rows].sum(axis=0)


def _table(ids, x, cluster, upper, lower, moved, n, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, x, cluster, upper, lower, moved, n, sums], names=["_id", "x", "cluster", "upper", "lower", "moved", "n", "sums"])


def _pass(rows: DataFrame, centroids: Centroids, width: int, kind: np.dtype, first: bool) -> DataFrame:
    """One round over the table of the round before, or over (_id, components) at first."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        at = shared.value
        count, sums = np.zeros(len(at.places), dtype=np.int64), np.zeros(at.places.shape, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                values = batch.column("x").flatten().to_numpy()
                x, was = values.reshape(batch.num_rows, width), np.full(batch.num_rows, -1, dtype=np.int32)
                cluster, upper, lower = nearest_of_all(x, at)
                packed = _packed(x.astype(kind))
            else:
                packed = batch.column("x")
                x = _unpacked(packed, width, kind)
                was, upper, lower = (batch.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
                cluster, upper, lower, _ = reassigned(x, was, upper, lower, at)
            _changes(x, was, cluster, count, sums)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield _table(batch.column("_id"), packed, pa.array(cluster), pa.array(upper), pa.array(lower), none.cast(pa.int32()), none, pa.nulls(batch.num_rows, pa.list_(pa.int64())))
        changed = np.flatnonzero((sums != 0).any(axis=1) | (count != 0)).tolist()
        if changed:
            m = len(changed)
            yield _table(
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()),
                pa.array(changed, pa.int32()), pa.array(count[changed]), pa.array(sums[changed].tolist(), pa.list_(pa.int64())),
            )

    return rows.mapInArrow(run, _SCHEMA)


def _take_changes(rows: DataFrame, count: list[int], sums: list[list[int]]) -> None:
    """The tasks' changes, summed in Spark, into the totals: exact whole numbers."""
    found = (
        rows.where("moved is not null")
        .select("moved", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("moved", "place")
        .agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
        .collect()
    )
    for r in found:
        sums[r.moved][r.place] += r.part
        if r.place == 0:
            count[r.moved] += r.n


def clustered(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    width: int = 64,
    factor: float = 1024.0,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that takes part.

    Centroids start as the k vectors whose `<seed>:<id>` has the least SHA-256.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), whole(F.col(vector_col), width, factor).alias("x")).where("x is not null")
    facts = rows.agg(
        F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("longest"),
        F.max(F.aggregate("x", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))).alias("widest"),
    ).first()
    if facts.longest is None:
        return spark.createDataFrame([], schema)
    if facts.longest >= 2**50:
        raise ValueError("components are too large for exact distances")
    kind = np.dtype(np.int16 if facts.widest < 2**15 else np.int32)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    starts = rows.where("_id is not null").orderBy(name, "x").limit(k).select("x").collect()
    if not starts:
        raise ValueError("no vector has an id to start from")
    places = np.array([r.x for r in starts], dtype=np.float64)
    count, sums = [0] * len(places), [[0] * width for _ in places]
    at = Centroids(places)
    held = settle(_pass(rows, at, width, kind, first=True))
    for number in range(rounds):
        _take_changes(held, count, sums)
        moved = np.array([[s // n for s in total] if n else place for n, total, place in zip(count, sums, at.places.tolist(), strict=True)], dtype=np.float64)
        at = Centroids(moved, at.places)
        following = settle(_pass(held.where("x is not null"), at, width, kind, first=False))
        discard(held)
        held = following

    shared = spark.sparkContext.broadcast(at.places)

    def measured(batches):
        for batch in batches:
            if batch.num_rows:
                x, cluster = _unpacked(batch.column("x"), width, kind), batch.column("cluster")
                distance = _squared(x, np.arange(len(x)), shared.value[cluster.to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column("_id"), cluster, pa.array(distance.astype(np.int64))], names=["_id", "cluster", "distance"])

    found = held.where("x is not null").select("_id", "x", "cluster").mapInArrow(measured, "_id long, cluster int, distance long")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(str(int(v)) for v in place).encode()).hexdigest() for place in at.places]
    facts = spark.createDataFrame([(c, inertia[c], sum(inertia.values()), digests[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster")  # a row for each of the k clusters
    return out.select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
