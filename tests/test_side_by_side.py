from pathlib import Path

from pyspark.sql import functions as F

from scorewright.operators.skew import side_by_side
from scorewright.plans import load_all
from scorewright.plans.catalog import QUERIES


def test_frames_of_alike_videos_are_written_side_by_side(spark, tmp_path):
    load_all()
    events = spark.range(12_000, numPartitions=1).select(F.col("id").alias("event_id"), (F.col("id") * 7919 % 1_200).alias("user_id"))
    events.write.parquet(f"{tmp_path}/in/events.parquet")
    QUERIES["i07_sample_frames"](spark, f"{tmp_path}/in").write.parquet(f"{tmp_path}/out")
    written = sum(f.stat().st_size for f in Path(tmp_path, "out").rglob("*.parquet"))
    # in the order of the events they took 144 bytes a row
    assert written < 60 * 12_000
    got = {r.idx: (r.spaced, r.at_rate) for r in spark.read.parquet(f"{tmp_path}/out").where("idx % 97 = 0").collect()}
    for idx in range(0, 12_000, 97):
        total = (idx * 7919 % 1_200) * 7 + 3
        spaced = ",".join(str(int(i * (total / 9))) for i in range(1, 9))
        assert got[idx] == (spaced, ",".join(str(int(i * 12.5)) for i in range(int(total / 25 * 2))))


def test_side_by_side_keeps_all_rows_and_cuts_one_frequent_value(spark):
    rows = [(7, i) for i in range(4_000)] + [(None, -1), (None, -1), (3, None), (9, 1), (9, 1)]
    df = side_by_side(spark.createDataFrame(rows, "v int, k int"), ["v", "k"], rows=500)
    assert sorted(map(str, df.collect())) == sorted(map(str, spark.createDataFrame(rows, "v int, k int").collect()))
    sizes = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 1_500
