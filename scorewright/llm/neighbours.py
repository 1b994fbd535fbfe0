"""Nearest vectors by multi-index hashing over learned rotated binary codes, reranked on the original floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from scorewright.llm.tables import saved
from scorewright.llm.toxicity import hash_share

SAMPLE = 4_096  # vectors, by a hash share, on which the rotation and the radius are learned
PART_BITS = 8
MAX_BITS = 64
BLOCK_ROWS = 20_000
QUERY_ROWS = 2_000
SURE = 0.98  # share of the sample's true neighbours that the radius takes in


class Codes:
    """Signs of centred vectors after a learned rotation (iterative quantisation over the principal axes)."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray):
        self.centre, self.axes = centre, axes

    @property
    def parts(self) -> int:
        return self.axes.shape[1] // PART_BITS

    @staticmethod
    def fit(x: np.ndarray, rounds: int = 40, seed: int = 3) -> Codes:
        centre = x.mean(0)
        bits = min(MAX_BITS, max(PART_BITS, x.shape[1] // PART_BITS * PART_BITS))
        _, _, right = np.linalg.svd(x - centre, full_matrices=False)
        rng = np.random.Generator(np.random.PCG64(seed))
        axes = np.zeros((x.shape[1], bits))
        axes[:, : min(bits, len(right))] = right[:bits].T
        flat = (x - centre) @ axes
        turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (a @ b).T
        return Codes(centre, axes @ turn)

    def of(self, x: np.ndarray) -> np.ndarray:
        """One byte per part."""
        return np.packbits((x - self.centre) @ self.axes >= 0, axis=1)

    def radius(self, x: np.ndarray, nearest: int) -> int:
        """Bits within which lies the share SURE of the true neighbours of some sample vectors; neighbours in all rows are nearer still."""
        codes, found = self.of(x), []
        for i in range(0, len(x), max(1, len(x) // 256)):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            top = np.argsort(d, kind="stable")[: min(nearest, len(x) - 1)]
            found.append(np.bitwise_count(codes[top] ^ codes[i]).sum(1))
        return int(np.quantile(np.concatenate(found), SURE)) if len(x) > 1 else 0


_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Block:
    """Rows of one index block: for each code part the rows sorted by its value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        self.rows = [np.argsort(codes[:, k], kind="stable") for k in range(codes.shape[1])]
        self.ends = [np.searchsorted(codes[r, k], np.arange(257)) for k, r in enumerate(self.rows)]

    def search(self, own: int, q: np.ndarray, code: np.ndarray, radius: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest rows whose code is within ``radius`` bits: by the pigeonhole principle one part differs in radius // parts bits at most."""
        step = radius // len(self.rows)
        seen = np.zeros(len(self.ids), bool)
        for k, rows in enumerate(self.rows):
            ends = self.ends[k]
            for v in np.flatnonzero(_NEAR[code[k]] <= step):
                seen[rows[ends[v] : ends[v + 1]]] = True
        at = np.flatnonzero(seen)
        at = at[(np.bitwise_count(self.codes[at] ^ code).sum(1) <= radius) & (self.ids[at] != own)]
        d = np.sqrt(((self.x[at] - q) ** 2).sum(1))
        best = np.lexsort((self.ids[at], d))[:nearest]
        return self.ids[at[best]], d[best]


def nearest_vectors(vectors: DataFrame, queries: DataFrame | None = None, vec_id: str = "vec_id", embedding: str = "embedding", nearest: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``nearest`` rows found by Euclidean distance, ties to the smaller id.

    Queries are the rows of ``queries`` (ids and vectors under the same names), by default those whose id is divisible by ``every``; a query's own
    id is no candidate. Null, zero and non-finite vectors, null ids and lengths other than the commonest take no part. Codes are learned on a
    sample of SAMPLE rows, all rows are indexed. The index is cut into blocks of bounded size by a hash of the id, so one frequent vector or
    code fills no task, and every block answers queries in batches. Of equal vectors only the ``nearest`` + 1 smallest ids can be results, so
    the others are left out of the index. Queries with too few results search again with a wider radius, up to every row. Repeated rows are one.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(embedding).cast("array<double>")
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(good)

    rows = clean(vectors)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim, n = lengths["d"], lengths["count"]
    rows = rows.where(F.size("v") == dim)
    drawn = rows.where(hash_share("id", SAMPLE / n, 8)).orderBy("id").toArrow()
    if not len(drawn):
        drawn = rows.orderBy("id").limit(SAMPLE).toArrow()
    sample = _matrix(drawn["v"], dim)
    codes = Codes.fit(sample)
    radius = codes.radius(sample, nearest)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = codes.of(_matrix(batch.column(1), dim))
            yield batch.append_column("code", pa.array([r.tobytes() for r in c], pa.binary()))

    alike = Window.partitionBy("v").orderBy("id")
    index = rows.distinct().withColumn("place", F.row_number().over(alike)).where(F.col("place") <= nearest + 1).drop("place")
    index = index.mapInArrow(coded, "id long, v array<double>, code binary")
    blocks = max(1, -(-n // BLOCK_ROWS))
    index = saved(index.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    indexed = index.count()
    asked = rows.where(F.col("id") % every == 0) if queries is None else clean(queries).where(F.size("v") == dim)
    asked = asked.distinct().mapInArrow(coded, "id long, v array<double>, code binary")
    batches_ = max(1, -(-asked.count() // QUERY_ROWS))
    asked = saved(asked.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(batches_)).cast("int")))

    def searched(radius: int, left: DataFrame) -> DataFrame:
        def run(block: pa.Table, batch: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if len(block) and len(batch):
                as_codes = lambda t: np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(t), -1)
                held = Block(block["id"].to_numpy(), _matrix(block["v"], dim), as_codes(block))
                ids, qs, cs = batch["id"].to_numpy(), _matrix(batch["v"], dim), as_codes(batch)
                for own, q, c in zip(ids, qs, cs):
                    found, d = held.search(own, q, c, radius, nearest)
                    out.append((np.full(len(found), own), found, d))
            parts = [np.concatenate(p) if out else np.zeros(0) for p in (zip(*out) if out else ((), (), ()))]
            return pa.table({"query_id": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)), "score": pa.array(parts[2].astype(np.float64))})

        own = index.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches_ - 1))))
        other = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = own.groupBy("block", "batch").cogroup(other.groupBy("block", "batch")).applyInArrow(run, schema)
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return saved(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest))

    done: DataFrame | None = None
    left = asked
    while True:
        radius = min((radius // codes.parts + 1) * codes.parts - 1, codes.axes.shape[1])
        found = searched(radius, left)
        # ids that have all they can get: equal rows beyond nearest + 1 are never missed, so the index size bounds what is there
        full = found.groupBy("query_id").count().where(F.col("count") >= min(nearest, indexed - 1)).select("query_id")
        over = radius >= codes.axes.shape[1]
        kept = found if over else found.join(full, "query_id", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        left = left.join(full.withColumnRenamed("query_id", "id"), "id", "left_anti")
        if over or left.isEmpty():
            return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        left = saved(left)
        radius += codes.parts
