"""Clusters of integer vectors around moving centroids, searched through a vantage-point tree that is rebuilt and broadcast each round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorewright.llm.tables import saved

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
BOUND = 1 << 27  # components are held to this, so that 64 squared differences fit a long
_BLOCK = 8_192


class VantageTree:
    """A vantage-point tree over centroids.

    A node holds one centroid; the others below it fall, by their distance to it, in a near and a far half. Each half knows the least and
    greatest of these distances, which bound the distance of a query to all in it.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.number: list[int] = []  # centroid of the node
        self.halves: list[list[tuple[int, float, float]]] = []  # child node, least and greatest distance to the node's centroid
        self._build(list(range(len(centroids))))

    def _build(self, members: list[int]) -> int:
        node, own = len(self.number), members[0]
        self.number.append(own)
        self.halves.append([])
        rest = np.asarray(members[1:], np.int64)
        if len(rest):
            squared = ((self.centroids[rest] - self.centroids[own]) ** 2).sum(1)
            order = np.argsort(squared, kind="stable")
            middle = (len(rest) + 1) // 2
            for part in (order[:middle], order[middle:]):
                if len(part):
                    reach = np.sqrt(squared[part].astype(np.float64))
                    self.halves[node].append((self._build(rest[part].tolist()), float(reach.min()), float(reach.max())))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row, ties to the smaller number.

        Every row walks the tree best first: of its open nodes the one with the least bound is next, and a row is done when that bound lies beyond
        its best distance. A bound equal to the best distance stays open, with an allowance for the rounding of roots, so all ties are met; leaf
        distances are exact integers. Rows take their steps side by side.
        """
        best = np.full(len(x), np.iinfo(np.int64).max)
        found = np.full(len(x), len(self.centroids), np.int64)
        opened = np.full((len(x), len(self.number)), np.inf)
        opened[:, 0] = 0.0
        numbers = np.asarray(self.number)
        left = np.arange(len(x))
        while len(left):
            node = opened[left].argmin(1)
            bound = opened[left, node]
            radius = np.sqrt(best[left].astype(np.float64))
            going = bound <= radius * (1 + 1e-12) + 1e-9
            going &= np.isfinite(bound)
            left, node, bound = left[going], node[going], bound[going]
            if not len(left):
                break
            opened[left, node] = np.inf
            own = numbers[node]
            squared = ((x[left] - self.centroids[own]) ** 2).sum(1)
            better = (squared < best[left]) | ((squared == best[left]) & (own < found[left]))
            best[left[better]], found[left[better]] = squared[better], own[better]
            reach = np.sqrt(squared.astype(np.float64))
            for i in np.unique(node):
                here = node == i
                for child, low, high in self.halves[i]:
                    opened[left[here], child] = np.maximum(bound[here], np.maximum(reach[here] - high, low - reach[here]) - 1e-9 * (1 + high))
        return found, best


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def clustered(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE, dim: int = DIMENSIONS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of each vector with ``dim`` finite components.

    A component counts as floor(scale * x). The first centroids are the vectors with the smallest sha256 of ``seed:vec_id``, in that order; each round
    assigns every vector to its nearest centroid and moves the centroid to floor(sum / count) of its vectors; an empty one stays. All sums are exact.
    Distances are squared; an inertia is their sum, null beyond a long. Equal hashes (repeated ids) go by their components. Other vectors give no
    row: null, of another length, with null or non-finite components. Rows without an id take part, under an empty text as id; repeated rows are each a
    vector; with fewer vectors than ``clusters`` there are as many centroids. Components beyond 2^27 in size count as 2^27. Other columns are not read.

    Only ``clusters`` x ``dim`` sums reach the driver in a round, and only the tree over the centroids is broadcast.
    """
    spark = vectors.sparkSession
    v = F.col(embedding).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == dim).where(good)
    rows = saved(rows.select("vec_id", whole.alias("v")))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(mark, "v").limit(clusters).select("v").collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64)

    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))

        def summed(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(tree.value.centroids), np.int64), np.zeros_like(tree.value.centroids)
            for _, x in _blocks(batches, dim):
                own, _ = tree.value.nearest(x)
                n += np.bincount(own, minlength=len(n))
                for c in np.unique(own):
                    total[c] += x[own == c].sum(0)
            held = np.flatnonzero(n)
            cluster, place = np.repeat(held, dim), np.tile(np.arange(dim), len(held))
            yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(np.repeat(n[held], dim)), pa.array(total[held].ravel())], ["cluster", "place", "n", "total"])

        sums = rows.mapInArrow(summed, "cluster int, place int, n long, total long").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        moved = centroids.copy()
        for r in sums.collect():  # clusters x dim rows
            moved[r["cluster"], r["place"]] = r["total"] // r["n"]
        tree.unpersist()
        centroids = moved

    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim):
            own, squared = tree.value.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(squared)], ["vec_id", "cluster", "distance"])

    near = saved(rows.mapInArrow(assigned, "vec_id long, cluster int, distance long"))
    by = {r["cluster"]: int(r["s"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    found = [(c, long(s), long(sum(by.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist()) for c, s in by.items()]
    about = spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
    return near.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
