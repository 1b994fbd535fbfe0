"""Centroid clusters against plain loops: tree search with many ties, whole rounds, and every edge case."""

import hashlib
import math

import numpy as np
import pytest

from scorewright.llm.centroids import VantageTree, clustered


@pytest.mark.parametrize("seed,spread,n", [(1, 2, 16), (2, 3, 1), (3, 1, 40), (4, 1000, 16), (5, 1 << 27, 9)])
def test_tree_equals_scan(seed, spread, n):
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-spread, spread + 1, (n, 4))
    x = np.concatenate([rng.integers(-spread, spread + 1, (500, 4)), centroids])
    squared = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    own, best = VantageTree(centroids).nearest(x)
    assert (own == squared.argmin(1)).all() and (best == squared.min(1)).all()


def brute(rows, clusters, rounds):
    """The same by lists of exact integers: (vec_id, cluster, distance) sorted, and the centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]]
    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            held = [v for (_, v), o in zip(kept, own) if o == k]
            if held:
                centroids[k] = [sum(x) // len(held) for x in zip(*held)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), centroids


SCHEMA = "vec_id long, embedding array<float>, distance int, cluster string, v int"


def test_equals_brute_force_on_edges(spark):
    rng = np.random.default_rng(7)
    # few distinct values, so that distances tie and centroids coincide or run empty
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 64) / 64 * (i % 3)]) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (None, [0.5] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [float("nan")] * 64), (206, [float("-inf")] + [0.0] * 63), (207, [0.0] * 64)]
    out = clustered(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(5)).collect()
    want, centroids = brute(rows, 16, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=str) == want
    for r in out:
        assert r.centroid == centroids[r.cluster] and r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)


def test_few_none_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    assert clustered(spark.createDataFrame([], schema)).collect() == []
    assert clustered(spark.createDataFrame([(1, None)], schema)).collect() == []
    out = clustered(spark.createDataFrame([(1, [0.1] * 64), (2, [0.1] * 64)], schema)).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == [(1, 0, 0), (2, 0, 0)]
    out = clustered(spark.createDataFrame([(1, [1e308] * 64), (2, [-1e308] * 64), (3, [1e300] * 64)], schema)).collect()
    assert {r.vec_id: r.distance for r in out} == {1: 0, 2: 0, 3: 0}
