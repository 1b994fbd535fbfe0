"""Joins of result tables: prediction x answer, first match, one of many, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from scorewright.operators.skew import dealt, salted_join, unit_hash


def lookup(facts: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Facts with dimension columns; hot fact keys are spread, and Spark broadcasts the dimension when its size allows."""
    return salted_join(facts, dimension, on, how)


def one_of_many(df: DataFrame, choices: DataFrame, on: str, tie: str, seed: str = "0") -> DataFrame:
    """Each row with one hashed choice among the rows of its key; rows without a choice pass through.

    The pick is a minimum per key, so a key with many choices is reduced before the shuffle.
    """
    rest = [c for c in choices.columns if c != on]
    pick = F.min(F.struct(unit_hash(F.col(on), F.col(tie), seed=seed).alias("_h"), *rest)).alias("_p")
    chosen = choices.groupBy(on).agg(pick).select(on, *[F.col(f"_p.{c}").alias(c) for c in rest])
    return df.join(chosen, on, "left")


def first_match(wanted: DataFrame, found: DataFrame, key: str, order: str, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their first holder by ``order``, wanted keys held nowhere); ``tasks`` deals both tables to so many tasks by key."""
    wanted, found = dealt(wanted, [key], tasks), dealt(found, [key], tasks)
    rest = [c for c in found.columns if c != key]
    first = found.groupBy(key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_f")).select(key, *[F.col(f"_f.{c}").alias(c) for c in rest])
    return wanted.join(first, key), wanted.select(key).join(found.select(key), key, "left_anti")


def map_labels(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Rename values through a small rule table; others stay."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(names.items()), f"{column} string, _new string")
    return df.join(F.broadcast(table), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def missing_pairs(left: DataFrame, a: str, right: DataFrame, b: str, done: DataFrame, chunk: int = 4096) -> DataFrame:
    """All (a, b) without a row in ``done``.

    The second list is cut into numbered chunks of about ``chunk`` values by a hash. A left value meets a chunk, not a value, and lists
    what the chunk holds and ``done`` lacks, so the pairs that come out are the only ones formed.
    """
    names = right.select(b).where(F.col(b).isNotNull()).distinct()
    # one number passes the driver
    chunks = max(1, -(-names.count() // chunk))
    number = F.pmod(F.xxhash64(b), F.lit(chunks)).cast("int").alias("_chunk")
    every = names.groupBy(number).agg(F.sort_array(F.collect_list(b)).alias("_all"))
    have = done.select(a, b).where(F.col(b).isNotNull()).distinct().groupBy(a, number).agg(F.collect_list(b).alias("_have"))
    keys = left.select(a).distinct().select(a, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"))
    rows = keys.join(every, "_chunk").join(have, [a, "_chunk"], "left")
    empty = F.array().cast(f"array<{names.schema[0].dataType.simpleString()}>")
    return rows.select(a, F.explode(F.array_except("_all", F.coalesce("_have", empty))).alias(b))
