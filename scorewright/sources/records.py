"""Record files: csv, tsv, json, json lines, parquet, id lists and conversation files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scorewright.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written tables inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _format(path: str, fmt: str | None) -> str:
    return fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_records(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Load csv, tsv, json or jsonl, by suffix; give a schema to skip the inference pass.

    ``multi_line`` lets quoted csv fields hold line breaks; such files cannot be split, so it is off by default.
    """
    fmt = _format(path, fmt)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt in ("csv", "tsv"):
        options = {"header": True, "sep": "\t" if fmt == "tsv" else ",", "multiLine": multi_line, "escape": '"', "inferSchema": schema is None}
        return reader.options(**options).csv(path)
    if fmt in ("json", "jsonl"):
        return reader.option("multiLine", fmt == "json").json(path)
    raise ValueError(f"no reader for {fmt}")


def write_records(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Write csv or tsv with every field quoted, or one json object per line."""
    fmt = _format(path, fmt)
    if fmt in ("csv", "tsv"):
        df.write.mode("overwrite").options(header=True, quoteAll=True, sep="\t" if fmt == "tsv" else ",", escape='"').csv(path)
    elif fmt in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no writer for {fmt}")


def parquet_to_tsv(spark: SparkSession, source: str, target: str) -> None:
    write_records(spark.read.parquet(source), target, "tsv")


def read_corpus(spark: SparkSession, glob: str, column: str = "content") -> DataFrame:
    """One column of the matching parquet files; nothing else is read."""
    return spark.read.parquet(glob).select(column)


def conversations_only(df: DataFrame) -> DataFrame:
    """Items that have both an image and conversations."""
    return df.filter(F.col("image").isNotNull() & F.col("conversations").isNotNull())


CONVERSATIONS = "image STRING, conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>"


def read_conversations(spark: SparkSession, path: str, fmt: str = "json", schema: str = CONVERSATIONS) -> DataFrame:
    return conversations_only(read_records(spark, path, fmt, schema))


def id_list(text: Column) -> Column:
    """Ids of one file: a JSON array, else the lines that are not blank; an id is the last path segment."""
    array = F.from_json(text, "array<string>")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    given = F.when(F.trim(text).startswith("["), F.coalesce(array, lines)).otherwise(lines)
    return F.transform(given, lambda x: F.element_at(F.split(F.rtrim(x), "/"), -1))


def read_id_list(spark: SparkSession, path: str, whole: bool | None = None) -> DataFrame:
    """Ids of list files. Files are read line by line, a line being an id or a JSON array.

    A JSON array over several lines needs the ``whole`` file in one row, which is the default for a path that ends in .json.
    """
    whole = path.rstrip("/").endswith(".json") if whole is None else whole
    return spark.read.text(path, wholetext=whole).select(F.explode(id_list(F.col("value"))).alias("id"))
