"""Dictionary coding of arrays: every element replaced by its entry of a dictionary table, without shuffling the elements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# A dictionary of at most so many entries and bytes goes to every task.
SENT_ENTRIES, SENT_BYTES = 100_000, 16_000_000


def _bounded(codes: DataFrame) -> bool:
    size = F.octet_length(F.col("v").cast("string")) + F.coalesce(F.octet_length(F.col("code").cast("string")), F.lit(0))
    got = codes.limit(SENT_ENTRIES + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return got["n"] <= SENT_ENTRIES and got["bytes"] <= SENT_BYTES


def _looked_up(values: pa.Array, entries: pa.Array, default: pa.Array) -> pa.Array:
    """The code of every element of ``values`` among the ``entries`` (v, code) of the batch: one dictionary, so rows agree on it."""
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    known, code = entries.flatten().flatten()
    at = pc.index_in(values.flatten(), value_set=known, skip_nulls=True)
    found = pc.coalesce(code.take(at), default.take(pa.array(np.repeat(np.arange(len(values)), lengths))))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, found, mask=pc.is_null(values))


def coded(df: DataFrame, key: str, values: str, dictionary: DataFrame, source: str, target: str, default: Column, output: str, keep: bool = False) -> DataFrame:
    """(key, output): the arrays of ``values`` with each element replaced by its dictionary entry, ``default`` where there is none.

    ``key`` names a row; two rows of one key are an error. A row sends its distinct elements to the dictionary once, gets back those that have a code and looks its elements up
    in place, so a repeated element is not shuffled again. Rows are dealt by key before they are taken apart: a dictionary that is broadcast (its
    bounds are checked) then leaves every element where its row is. With a larger one an element that many rows hold is there once a row; its join
    partition is split adaptively. Of equal dictionary entries the least code counts. A null array stays null, a null element gets the default; an
    empty array stays empty. ``keep`` returns the arrays of ``values`` beside the output.
    """
    codes = dictionary.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("v")).agg(F.min(target).alias("code"))
    kinds = dict(codes.dtypes)
    kind, small = kinds["v"], _bounded(codes)
    once = F.array_compact(F.array_distinct(F.coalesce("_values", F.array().cast(f"array<{kind}>"))))
    rows = df.select(F.col(key).alias("_key"), F.col(values).cast(f"array<{kind}>").alias("_values")).repartition("_key").withColumn("_once", once)
    # the mark carries the row; its value is a hash, so marks spread like other elements
    mark = F.struct(F.xxhash64("_key").cast(kind).alias("v"), F.lit(True).alias("mark"), F.col("_values").alias("row"))
    element = lambda v: F.struct(v.alias("v"), F.lit(False).alias("mark"), F.lit(None).cast(f"array<{kind}>").alias("row"))
    found = rows.select("_key", F.inline(F.concat(F.array(mark), F.transform("_once", element)))).join(F.broadcast(codes) if small else codes, "v", "left")
    found = found.where("mark or code is not null")
    entry = F.when(~F.col("mark"), F.struct("v", "code"))
    packed = (found if small else found.repartition("_key")).groupBy("_key").agg(F.collect_list(entry).alias("_known"), F.first("row", ignorenulls=True).alias("_row"), F.count_if("mark").alias("_rows"))
    packed = packed.withColumn("_values", F.when(F.col("_rows") > 1, F.raise_error(F.lit(f"two rows have the same {key}"))).otherwise(F.col("_row")))
    look = F.arrow_udf(_looked_up, f"array<{kinds['code']}>")
    given = [F.col("_values").alias(values)] if keep else []
    return packed.select(F.col("_key").alias(key), *given, look("_values", "_known", default.cast(kinds["code"])).alias(output))
