"""Archive shards and image files as Spark data sources: a streamed reader, and writers that commit whole tasks."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MEMBERS = "url STRING, position BIGINT, fname STRING, data BINARY"
FILES = "name STRING, content BINARY"
BATCH_FILES, BATCH_BYTES = 1_000, 8_000_000  # files and bytes a reading task holds at once


def _store(path: str):
    """File system of a path and the path within it; a path without a scheme or with ``file:`` is a shared folder."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/")
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def _options(options) -> str:
    if not options.get("path"):
        raise ValueError("a path is needed")
    return options["path"]


@dataclass
class _Shard(InputPartition):
    path: str


class _ShardReader(DataSourceReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def partitions(self):
        from pyarrow import fs
        store, inner = _store(self.root)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [_Shard(inner)]
        found = store.get_file_info(fs.FileSelector(inner, recursive=True))
        hidden = lambda p: any(part[:1] in "._" for part in p[len(inner):].split("/") if part)
        return [_Shard(p) for p in sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not hidden(f.path))]

    def read(self, partition: _Shard | None) -> Iterator[tuple]:
        # Spark asks once without a partition when there is no shard
        if partition is None:
            return
        store, _ = _store(self.root)
        # one pass: headers are met as the bytes arrive, one member is held at a time
        with store.open_input_stream(partition.path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
            position = 0
            for member in archive:
                # what was read is forgotten, so memory does not grow with the number of members
                archive.members = []
                if member.isfile():
                    yield partition.path.rsplit("/", 1)[-1], position, member.name, archive.extractfile(member).read()
                    position += 1


def _hidden(name: str) -> bool:
    return name[:1] in ("", ".", "_")


@dataclass
class _Folder(InputPartition):
    path: str
    deep: bool


class _FolderReader(DataSourceReader):
    """The driver lists the folders right below the path, one task each; files are listed where they are read, so the driver holds none of their names."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        from pyarrow import fs
        store, inner = _store(self.root)
        found = store.get_file_info(fs.FileSelector(inner))
        # files that lie beside the folders are one task's work
        return [_Folder(inner, False), *(_Folder(p, True) for p in sorted(f.path for f in found if f.type == fs.FileType.Directory and not _hidden(f.base_name)))]

    def read(self, partition: _Folder | None) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        if partition is None:
            return
        store, _ = _store(self.root)
        below, names, contents, held = [partition.path], [], [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

        while below:
            found = sorted((f for f in store.get_file_info(fs.FileSelector(below.pop())) if not _hidden(f.base_name)), key=lambda f: f.path)
            below += [f.path for f in found if partition.deep and f.type == fs.FileType.Directory]
            for file in found:
                if file.type != fs.FileType.File or not file.size:
                    continue
                with store.open_input_stream(file.path, compression=None) as stream:
                    contents.append(stream.read())
                names.append(file.path)
                held += len(contents[-1])
                if len(names) >= BATCH_FILES or held >= BATCH_BYTES:
                    yield packed()
                    names, contents, held = [], [], 0
        if names:
            yield packed()


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    rows: int


class _TaskWriter(DataSourceWriter):
    """Tasks write into folders of their own; the commit moves one folder a task, so a repeated or lost task leaves nothing."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.job, self.overwrite = root, uuid.uuid4().hex, overwrite

    def _attempt(self) -> tuple:
        store, inner = _store(self.root)
        folder = f"{inner}/_temporary/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        return store, folder

    def commit(self, messages) -> None:
        store, inner = _store(self.root)
        for n, message in enumerate(m for m in messages if m and m.rows):
            store.move(message.folder, f"{inner}/part-{self.job}-{n:05d}")
        self._clean()
        with store.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs
        store, inner = _store(self.root)
        if store.get_file_info(f"{inner}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/_temporary/{self.job}")


class _FileWriter(_TaskWriter):
    def write(self, iterator) -> _Written:
        store, folder = self._attempt()
        written: set[str] = set()
        made: set[str] = {""}
        for row in iterator:
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a file name inside the folder: {name!r}")
            if name in written:
                raise ValueError(f"two rows of one task have the file name {name!r}")
            written.add(name)
            below = os.path.dirname(name)
            if below not in made:
                store.create_dir(f"{folder}/{below}", recursive=True)
                made.add(below)
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(row["content"] or b"")
        return _Written(folder, len(written))


class _ShardWriter(_TaskWriter):
    def write(self, iterator) -> _Written:
        store, folder = self._attempt()
        archive = stream = shard = None
        written: set[str] = set()
        try:
            for row in iterator:
                if row["url"] != shard:
                    if archive:
                        archive.close()
                        stream.close()
                    shard = row["url"]
                    if shard in written:
                        raise ValueError(f"the rows of shard {shard!r} do not come together")
                    written.add(shard)
                    stream = store.open_output_stream(f"{folder}/{shard}", compression=None)
                    archive = tarfile.open(fileobj=stream, mode="w|", format=tarfile.PAX_FORMAT)
                member = tarfile.TarInfo(row["fname"])
                member.size = len(row["data"] or b"")
                archive.addfile(member, io.BytesIO(row["data"] or b""))
        finally:
            if archive:
                archive.close()
                stream.close()
        return _Written(folder, len(written))


class TarShards(DataSource):
    """``tar_shards``: members of the archives under a path (one task a shard), or rows (url, position, fname, data) written as shards."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema):
        return _ShardReader(_options(self.options), self.options.get("suffix", ".tar"))

    def writer(self, schema, overwrite):
        return _ShardWriter(_options(self.options), overwrite)


class NamedFiles(DataSource):
    """``named_files``: every row (name, content) becomes one file, and files under a path are rows with their whole path as name."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema):
        return _FolderReader(_options(self.options))

    def writer(self, schema, overwrite):
        return _FileWriter(_options(self.options), overwrite)


def read_shards(spark: SparkSession, folder: str, suffix: str = ".tar") -> DataFrame:
    """(url, position, fname, data) of all members of the archives (also compressed ones) under a folder, or of one archive.

    A shard is read by one task in one pass that holds one member; a folder without archives gives no rows.
    """
    spark.dataSource.register(TarShards)
    return spark.read.format("tar_shards").option("suffix", suffix).load(folder)


def write_shards(df: DataFrame, folder: str, url: str = "url", position: str = "position", name: str = "fname", data: str = "data") -> None:
    """Rows as members of archives named by ``url``, in order of position; an archive is one file and so the work of one task."""
    df.sparkSession.dataSource.register(TarShards)
    rows = df.selectExpr(f"`{url}` AS url", f"CAST(`{position}` AS BIGINT) AS position", f"`{name}` AS fname", f"CAST(`{data}` AS BINARY) AS data")
    rows.repartition("url").sortWithinPartitions("url", "position").write.format("tar_shards").mode("append").save(folder)


def write_files(df: DataFrame, folder: str, name: str = "image_path", content: str = "image") -> None:
    """One file a row, in a folder for each task: read back with ``read_files``, or with ``binaryFile`` and a recursive look-up, which lists all files on the driver. A null content is an empty file.

    File names stay inside the folder. Rows are dealt by file name, so the work does not stay with the few tasks that a table of few row groups has,
    and equal names meet in one task, where they are an error.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    df.selectExpr(f"`{name}` AS name", f"CAST(`{content}` AS BINARY) AS content").repartition("name").write.format("named_files").mode("append").save(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all files under a folder, as ``write_files`` leaves them: a task lists and reads one of the folders right below it.

    Empty files and names that begin with a dot or an underscore are left out, as Spark's readers do.
    """
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").load(folder).withColumnRenamed("name", "path")
