"""Streams over several batches: changed keys only, compaction, repeated batches, and each index once with a state that ends."""

import random

from pyspark.sql import functions as F

from scorewright.plans import load_all
from scorewright.plans.catalog import QUERIES
from scorewright.streaming import stream as N


def _files(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_running_metrics_write_changed_keys_and_compact(spark, tmp_path):
    draw = random.Random(6)
    schema, folder = "k string, v double", str(tmp_path)
    parts = [[(k, float(draw.randrange(9))) for k in draw.sample("abcdef", 2)] for _ in range(5)]
    _files(spark, folder, parts, schema)
    rows = N.stream_running_metrics(N.read_files(spark, f"{folder}/in", schema, files_per_batch=1), ["k"], ["v"])
    N.changed_batches(rows, ["k"], f"{folder}/out", f"{folder}/state", compact_every=2).awaitTermination()
    for n in range(5):
        assert spark.read.parquet(f"{folder}/out/changes/batch={n}").count() == 2
    assert N._numbers(spark, f"{folder}/out/compacted", "upto") == [1, 3]
    every = [r for p in parts for r in p]
    want = {k: (sum(1 for x in every if x[0] == k), sum(x[1] for x in every if x[0] == k) / sum(1 for x in every if x[0] == k)) for k, _ in every}
    assert {r.k: (r.n, r.mean_v) for r in N.current_rows(spark, f"{folder}/out", ["k"]).collect()} == want


def test_an_index_is_scored_once_over_batches(spark, tmp_path):
    schema, folder = "i int, j int, s string", str(tmp_path)
    _files(spark, folder, [[(1, 1, "a"), (1, 2, "b")], [(1, 1, "a"), (2, 1, "b")], [(1, 2, "b")]], schema)
    rows = N.read_files(spark, f"{folder}/in", schema, files_per_batch=1)
    scored = N.stream_score(rows, ["i", "j"], F.when(F.col("s") == "a", 1.0).otherwise(0.0))
    N.append_batches(scored, f"{folder}/out", f"{folder}/state").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").select("i", "j", "score").collect()))
    assert got == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0)]


def test_a_table_is_one_file_or_a_folder_of_files(spark, tmp_path):
    load_all()
    turns = [(i, 0, "user" if i % 2 else "assistant", "t") for i in range(20)]
    texts = [(i, "de", f"text {i}") for i in range(20)]
    for files in (1, 4):
        folder = str(tmp_path / str(files))
        for name, rows, schema in (("conversations", turns, "conv_id int, turn int, role string, text string"), ("documents", texts, "doc_id int, lang string, text string")):
            table = spark.createDataFrame(rows, schema)
            if files > 1:
                table.repartition(files).write.parquet(f"{folder}/{name}.parquet")
            else:
                (tmp_path / "1").mkdir(exist_ok=True)
                table.toPandas().to_parquet(f"{folder}/{name}.parquet")
        assert sorted(map(tuple, QUERIES["n01_stream_score"](spark, folder).collect())) == [(i, 0, float(i % 2)) for i in range(20)]
        assert sorted(map(tuple, QUERIES["n04_stream_corpus_prepare"](spark, folder).collect())) == [(i, f"text {i}") for i in range(20)]
