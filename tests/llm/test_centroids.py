"""Exponion search against plain rounds of assignment and means."""

import collections
import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import centroids


def plain(rows, k, rounds, width, factor, seed=3):
    kept = [(i, [math.floor(factor * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    places = [v for _, _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(places)) for _, v in kept]

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), (_, c) in zip(kept, assigned(), strict=True):
            groups[c].append(v)
        places = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if groups[c] else p for c, p in enumerate(places)]
    found = assigned()
    inertia = collections.Counter()
    for d, c in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    return collections.Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True))


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "k", "spread"), [(1, 8, 3), (2, 5, 2), (3, 12, 40)])
def test_ties_and_repeats_equal_plain_rounds(spark, seed, k, spread):
    """Few distinct whole vectors: many ties, equal seeds and centroids without vectors."""
    rng = np.random.RandomState(seed)
    rows = [(i if i % 17 else 7, [float(x) for x in rng.randint(-spread, spread + 1, 3)]) for i in range(400)]
    rows += [(None, [1.0, 1.0, 0.0]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [float("inf"), 1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    assert counted(centroids.clustered(table, k=k, rounds=6, width=3, factor=1.0)) == plain(rows, k, 6, 3, 1.0)


def test_production_shape_equals_plain_rounds(spark):
    rng = np.random.RandomState(9)
    middles = rng.normal(size=(11, 64))
    rows = [(i, [float(x) for x in (middles[rng.randint(11)] + rng.normal(size=64) * 0.3).astype(np.float32)]) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert counted(centroids.clustered(table)) == plain(rows, 8, 10, 64, 1024.0)


def test_few_vectors_none_and_too_long_ones(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [0.5, -0.5]), (2, [0.25, 3.0])]
    assert counted(centroids.clustered(spark.createDataFrame(rows, schema), width=2)) == plain(rows, 8, 10, 2, 1024.0)
    assert centroids.clustered(spark.createDataFrame([], schema), width=2).count() == 0
    assert centroids.clustered(spark.createDataFrame([(1, [1.0])], schema), width=2).collect() == []
    with pytest.raises(ValueError, match="too large"):
        centroids.clustered(spark.createDataFrame([(1, [1e9, 0.0])], schema), width=2)


def test_the_ball_spares_most_distances():
    rng = np.random.RandomState(4)
    middles = rng.uniform(-5000, 5000, size=(60, 2)).round()
    x = (middles[rng.randint(60, size=20_000)] + rng.normal(size=(20_000, 2)) * 60).round()
    before = centroids.Centroids(middles + 20)
    cluster, upper, lower = centroids.nearest_of_all(x, before)
    at = centroids.Centroids(middles, before.places)
    got, _, _, computed = centroids.reassigned(x, cluster, upper, lower, at)
    want = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (got == want).all()
    assert computed < 0.1 * x.shape[0] * len(middles)
