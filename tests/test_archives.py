"""Archive shards and image files: round trips, compressed archives, and tasks that fail and run again."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from scorewright.sources import archives


def test_shards_round_trip(spark, tmp_path):
    rows = [("a.tar", 2, "x/2.jpg", b"two"), ("a.tar", 1, "x/1.jpg", b""), ("b.tar", 1, "é" * 200 + ".txt", b"long name"), ("b.tar", 5, "n", None)]
    folder = f"{tmp_path}/s"
    archives.write_shards(spark.createDataFrame(rows, archives.MEMBERS), folder)
    got = sorted((r.url, r.position, r.fname, bytes(r.data)) for r in archives.read_shards(spark, folder).collect())
    assert got == [("a.tar", 0, "x/1.jpg", b""), ("a.tar", 1, "x/2.jpg", b"two"), ("b.tar", 0, "é" * 200 + ".txt", b"long name"), ("b.tar", 1, "n", b"")]
    assert not (tmp_path / "s" / "_temporary").exists() or not any((tmp_path / "s" / "_temporary").iterdir())


def test_compressed_shard_and_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert archives.read_shards(spark, f"{tmp_path}/in").count() == 0
    with tarfile.open(tmp_path / "in" / "z.tar.gz", "w:gz") as out:
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        out.addfile(folder)
        member = tarfile.TarInfo("d/f.txt")
        member.size = 3
        out.addfile(member, io.BytesIO(b"abc"))
    got = archives.read_shards(spark, f"file:{tmp_path}/in", ".tar.gz").collect()
    assert [(r.url, r.position, r.fname, bytes(r.data)) for r in got] == [("z.tar.gz", 0, "d/f.txt", b"abc")]


def test_files_round_trip_and_abort(spark, tmp_path):
    df = spark.range(50, numPartitions=4).select(F.concat(F.lit("k/"), F.col("id").cast("string"), F.lit(".jpg")).alias("image_path"), F.col("id").cast("string").cast("binary").alias("image"))
    archives.write_files(df, f"{tmp_path}/f")
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/f")
    assert sorted(int(bytes(r.content)) for r in back.select("content").collect()) == list(range(50))
    for bad in ("../out", "/abs", None):
        with pytest.raises(Exception):
            archives.write_files(spark.createDataFrame([("ok", b"1"), (bad, b"2")], "image_path string, image binary").coalesce(1), f"{tmp_path}/g")
    assert not [p for p in (tmp_path / "g").rglob("*") if p.is_file()]


def test_an_attempt_that_is_not_committed_leaves_nothing(tmp_path):
    writer = archives._FileWriter(f"{tmp_path}/h", False)
    rows = [{"name": "a.gz", "content": b"1"}]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert lost.folder != kept.folder
    writer.commit([kept])
    assert [p.name for p in (tmp_path / "h").rglob("*") if p.is_file() and p.name != "_SUCCESS"] == ["a.gz"]
    assert next((tmp_path / "h").rglob("a.gz")).read_bytes() == b"1"
