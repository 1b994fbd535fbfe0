"""Structured Streaming forms of scoring, frame buffering, running metrics and corpus preparation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from scorewright.functions.text import one_line, random_crop


def read_files(spark: SparkSession, folder: str, schema, fmt: str = "parquet", pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def once_per_index(rows: DataFrame, index: str | Sequence[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each index (one column or several) once; an index is forgotten ``delay`` after it was seen, so the state has an end.

    Time is the row's event time, or the start of the batch that brings the row for tables without one.
    """
    timed = rows if event_time else rows.withColumn("_arrived", F.current_timestamp())
    once = timed.withWatermark(event_time or "_arrived", delay).dropDuplicatesWithinWatermark([index] if isinstance(index, str) else list(index))
    return once.drop("_arrived")


def stream_score(rows: DataFrame, index: str | Sequence[str], score: Column, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    return once_per_index(rows, index, event_time, delay).withColumn("score", score)


def append_batches(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch to its own ``batch=<id>`` folder: a batch repeated after a failure overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest_frame(frames: DataFrame, scene: str, order: list[str], score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Newest frame per scene, scored; the state holds one frame per scene."""
    rest = [c for c in frames.columns if c not in (scene, *order)]
    newest = frames.groupBy(scene).agg(F.max(F.struct(*order, *rest)).alias("_f")).select(scene, *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]])
    return score(newest) if score else newest


def snapshot_batches(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode result of every micro-batch in its own folder; the last folder is the current state."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the finished ``name=<number>`` folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    done = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in done or [])


def _newest(spark: SparkSession, target: str, keys: Sequence[str], upto: int | None = None) -> DataFrame | None:
    """Newest row of each key: the last compacted table and the changes after it, ``upto`` a batch."""
    kept = [n for n in _numbers(spark, f"{target}/compacted", "upto") if upto is None or n < upto]
    base = kept[-1] if kept else -1
    changes = [n for n in _numbers(spark, f"{target}/changes", "batch") if n > base and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{target}/compacted/upto={base}").withColumn("_batch", F.lit(base))] if kept else []
    if changes:
        read = spark.read.option("basePath", f"{target}/changes").parquet(*[f"{target}/changes/batch={n}" for n in changes])
        parts.append(read.withColumn("_batch", F.col("batch").cast("int")).drop("batch"))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns if c != "_batch"])


def changed_batches(rows: DataFrame, keys: Sequence[str], target: str, checkpoint: str, compact_every: int = 32) -> StreamingQuery:
    """Write what every micro-batch changed: only the keys it met, in ``changes/batch=<id>``.

    Every ``compact_every`` batches the newest rows go into ``compacted/upto=<id>``; folders up to that number are not read again and may be
    deleted. A batch repeated after a failure overwrites its own folders, which hold the same rows.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/changes/batch={number}")
        if number % compact_every == compact_every - 1:
            _newest(batch.sparkSession, target, keys, number).write.mode("overwrite").parquet(f"{target}/compacted/upto={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key of a stream written by ``changed_batches``."""
    rows = _newest(spark, target, keys)
    if rows is None:
        raise ValueError(f"no finished batch in {target}")
    return rows


def stream_running_metrics(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Running count and means per key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def stream_corpus_prepare(rows: DataFrame, text: str, key: str, max_length: int, keep: Column | None = None, seed: str = "0") -> DataFrame:
    """Stateless cleaning of arriving rows: one line, kept by the filter, cropped to the length."""
    kept = rows.filter(keep) if keep is not None else rows
    return kept.withColumn(text, random_crop(one_line(F.col(text)), max_length, F.col(key), seed))


def latest_batch(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the newest ``batch`` folder."""
    every = spark.read.parquet(target)
    return every.filter(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")
