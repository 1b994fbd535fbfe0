"""Image files are written by several tasks, whatever the row groups of their table."""

import pytest
from pyspark.sql import functions as F

from scorewright.sources import archives


def test_rows_of_one_task_are_written_by_several(spark, tmp_path):
    # enough bytes that the shuffle is not put back into one task
    df = spark.range(400).coalesce(1).select(F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".jpg")).alias("image_path"),
                                             F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat_ws("-", "id", i), 512)), "").cast("binary").alias("image"))
    archives.write_files(df, f"{tmp_path}/f")
    assert len([d for d in (tmp_path / "f").iterdir() if d.name.startswith("part-")]) > 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/f").select(F.regexp_extract("path", r"(a/[^/]+)$", 1).alias("image_path"), F.col("content").alias("image"))
    assert files.count() == 400 and files.exceptAll(df).isEmpty()


def test_equal_names_of_different_tasks_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([("x.jpg", b"1")], "image_path string, image binary")
    with pytest.raises(Exception, match="file name 'x.jpg'"):
        archives.write_files(df.unionByName(df), f"{tmp_path}/f")


def test_files_are_listed_by_the_tasks_that_read_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BATCH_FILES", 7)
    names = [f"part-{i % 3}/{'deep/' * (i % 2)}é {i}.jpg" for i in range(90)] + ["loose.jpg", "part-0/empty.jpg"]
    hidden = [".x/a.jpg", "_temporary/a.jpg", "part-1/_b.jpg", "part-1/.c.jpg", "_SUCCESS"]
    for name in names + hidden:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else name.encode())
    # what the driver plans has a part a folder and names no file
    parts = archives._FolderReader(str(tmp_path)).partitions()
    assert len(parts) == 4 and not any(".jpg" in str(p) for p in parts)
    got = {r.path.removeprefix(f"{tmp_path}/"): bytes(r.content) for r in archives.read_files(spark, f"file://{tmp_path}").collect()}
    assert got == {n: n.encode() for n in names if "empty" not in n}


def test_the_image_file_query_lists_no_files_on_the_driver(spark, tmp_path):
    from scorewright.plans import load_all
    from scorewright.plans.catalog import QUERIES

    load_all()
    spark.createDataFrame([(i, f"text {i}" if i else "") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["a12_image_files"](spark, str(tmp_path))
    assert "binaryFile" not in df._jdf.queryExecution().toString() and not df.inputFiles()
    # an empty file is no row, as it was with binaryFile
    assert {r.name: r.size for r in df.collect()} == {f"src/{i}.jpg": len(f"text {i}") for i in range(1, 50)}


def test_read_files_gives_what_binary_file_gives(spark, tmp_path):
    df = spark.createDataFrame([(f"a/{i}.jpg", None if i % 5 == 0 else b"" if i % 5 == 1 else b"x" * i) for i in range(40)], "image_path string, image binary")
    archives.write_files(df, f"{tmp_path}/f")
    old = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/f")
    rows = lambda files: sorted((r.path.removeprefix("file:"), bytes(r.content)) for r in files.select("path", "content").collect())
    assert rows(archives.read_files(spark, f"{tmp_path}/f")) == rows(old) and old.count() == 24
