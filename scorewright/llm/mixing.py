"""Mixing sources to target weights by pivotal dependent rounding of copy counts, combined through a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm.tables import saved

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
MOST_COPIES = 3
LEAF_ROWS = 20_000  # documents a leaf of the tree holds on average
FAN_IN = 64
DRAWS = 32  # at the root of the tree


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> list[float]:
    """Words for each source: shares of the sum by weight, none above ``most`` times its size, the excess shared again by weight."""
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float | None] = [None] * len(sizes)
    left = float(sum(sizes))
    while True:
        free = [i for i, t in enumerate(out) if t is None]
        total = sum(share[i] for i in free)
        over = [i for i in free if left * share[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * share[i] / total
            return [float(t) for t in out]
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)


def pivot(size: np.ndarray, part: np.ndarray, seed: list[int], last: bool) -> np.ndarray:
    """Fractional copies after pairing: all 0 or 1 but one at most, and with ``last`` that one too.

    Two documents trade words until one of them has a whole number of copies; which way is drawn so that each keeps its expected copies. The sum
    of size times copies stays as it is, so a source misses its target by less than the last document's size.
    """
    draws = np.random.Generator(np.random.PCG64(seed)).random(len(size) + 1)
    out = part.astype(np.float64).copy()
    held = -1
    for j in range(len(size)):
        if out[j] <= 0.0 or out[j] >= 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up_i, up_j = (1 - out[i]) * size[i], (1 - out[j]) * size[j]
        down_i, down_j = out[i] * size[i], out[j] * size[j]
        to_i, to_j = min(up_i, down_j), min(down_i, up_j)
        if draws[j] * (to_i + to_j) < to_j:
            out[i] = 1.0 if to_i == up_i else out[i] + to_i / size[i]
            out[j] = 0.0 if to_i == down_j else out[j] - to_i / size[j]
        else:
            out[i] = 0.0 if to_j == down_i else out[i] - to_j / size[i]
            out[j] = 1.0 if to_j == up_j else out[j] + to_j / size[j]
        open_i, open_j = 0.0 < out[i] < 1.0, 0.0 < out[j] < 1.0
        held = i if open_i else j if open_j else -1
    if last and held >= 0:
        out[held] = float(draws[-1] < out[held])
    return out


def _level(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """One level of the tree: every (source, bucket) is rounded in its own task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # large documents first, so the one left over is small
        group = group.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
        place = [seed, level, int(group["source_no"].iloc[0]), int(group["bucket"].iloc[0])]
        size, part = group["size"].to_numpy(np.float64), group["part"].to_numpy()
        best, off = None, np.inf
        # the last document rounded may be a large one: of a few draws the one nearest to the words wanted is taken
        for turn in range(DRAWS if last else 1):
            out = pivot(size, part, [*place, turn], last)
            miss = abs(float(((out - part) * size).sum()))
            if miss < off:
                best, off = out, miss
            if off * 1000 <= float((part * size).sum()):
                break
        group["part"] = best
        return group

    return rows.groupBy("source_no", "bucket").applyInPandas(run, rows.schema)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, key), one row per row of ``docs``; key is a hash of the id and the text.

    size is the number of words, 0 for a null text. A source's documents all have target / source_size expected copies; the whole part is taken, the
    rest is rounded by pairing, first within buckets of a source, then among what the buckets leave over. Copies are at most MOST_COPIES.
    A null source is a source of its own, the last. A source without words has target 0. Draws depend on ids, sizes and the seed alone,
    so reruns agree; equal rows are drawn one by one. One row per source passes the driver, no documents.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.xxhash64(F.col(doc_id), whole).alias("key"), F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
    rows = saved(rows)
    known = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    wanted = targets([r["size"] for r in known]) if known else []
    plan = [(r["source"], i, r["size"], t, t / r["size"] if r["size"] else 0.0, max(1, -(-r["n"] // LEAF_ROWS))) for i, (r, t) in enumerate(zip(known, wanted))]
    kind = docs.schema[source].dataType.simpleString()
    plan_rows = spark.createDataFrame(plan, f"source {kind}, source_no int, source_size long, target double, ratio double, buckets int")
    # one row per source
    rows = rows.join(F.broadcast(plan_rows.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    floor = F.floor("ratio")
    rows = rows.select("id", "key", "size", "source_no", "source_size", "target", floor.cast("int").alias("whole"), (F.col("ratio") - floor).alias("part"),
                       F.pmod(F.xxhash64("key", F.lit(seed)), F.col("buckets")).cast("int").alias("bucket"), F.xxhash64("key", F.lit(seed + 1)).alias("tie"))
    is_open: Column = (F.col("part") > 0) & (F.col("part") < 1) & (F.col("size") > 0)
    done = [rows.where(~is_open).withColumn("part", F.lit(0.0))]
    left = rows.where(is_open)
    most = max([p[5] for p in plan], default=1)
    level = 0
    while True:
        last = most == 1
        out = saved(_level(left, seed, level, last))
        if last:
            done.append(out)
            break
        done.append(out.where(~is_open))
        left = out.where(is_open).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int"))
        most, level = -(-most // FAN_IN), level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    copies = (F.col("whole") + F.col("part").cast("int")).cast("long")
    return result.select(F.col("id").alias(doc_id), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")
