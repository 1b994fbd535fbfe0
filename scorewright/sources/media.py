"""Archive members, image folders, image cells and question files as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scorewright.functions.text import strip_space
from scorewright.operators.skew import ordered, ranked


def expand_shards(df: DataFrame, pattern: str, output: str = "shard") -> DataFrame:
    """One row per shard name of a ``prefix{000..199}suffix`` pattern; a plain name passes through."""
    p, rule = F.col(pattern), r"^(.*)\{(\d+)\.\.(\d+)\}(.*)$"
    part = lambda i: F.regexp_extract(p, rule, i)
    numbers = F.sequence(part(2).try_cast("int"), part(3).try_cast("int"))
    names = F.transform(numbers, lambda n: F.concat(part(1), F.lpad(n.cast("string"), F.length(part(2)), F.lit("0")), part(4)))
    return df.withColumn(output, F.explode(F.when(p.rlike(rule), names).otherwise(F.array(p))))


def split_member(fname: Column) -> tuple[Column, Column]:
    """Key (path up to the first dot of the file name) and lower-case suffix; null for names without one."""
    rule = r"^((?:.*/|)[^.]+)[.]([^/]*)$"
    key = F.regexp_extract(fname, rule, 1)
    return F.when(key != "", key), F.when(key != "", F.lower(F.regexp_extract(fname, rule, 2)))


def group_members(files: DataFrame, url: str = "url", position: str = "position", name: str = "fname", data: str = "data") -> DataFrame:
    """Archive members in order to samples: url, key, sample number in its run and a suffix -> data map.

    A new sample starts when the key changes or a suffix comes again. Runs of equal keys are found with range-bucketed
    running sums, so one large archive does not end in one task; only the members of one run are gathered.
    """
    key, suffix = split_member(F.col(name))
    named = files.select(F.col(url).alias("url"), F.col(position).alias("_pos"), key.alias("key"), suffix.alias("_suffix"), F.col(data).alias("_data")).filter("key is not null")
    ends = ordered(named, ["_pos"], ["url"], following={"_next": "key"}).withColumn("_end", F.when(F.col("_next").eqNullSafe(F.col("key")), 0).otherwise(1)).drop("_next")
    runs = ordered(ends, ["_pos"], ["url"], sums={"_ends": "_end"}).withColumn("_run", F.col("_ends") - F.col("_end"))
    member = F.struct("_pos", F.col("_suffix").alias("s"), F.col("_data").alias("d"))
    packed = runs.groupBy("url", "_run", "key").agg(F.sort_array(F.collect_list(member)).alias("m"))

    def number(acc: Column, item: Column) -> Column:
        again = F.array_contains(acc["seen"], item["s"])
        no = F.when(again, acc["no"] + 1).otherwise(acc["no"])
        seen = F.when(again, F.array(item["s"])).otherwise(F.concat(acc["seen"], F.array(item["s"])))
        return F.struct(no.alias("no"), seen.alias("seen"), F.concat(acc["out"], F.array(no)).alias("out"))

    start = F.struct(F.lit(0).alias("no"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("out"))
    numbered = packed.withColumn("n", F.aggregate("m", start, number, lambda acc: acc["out"]))
    samples = numbered.withColumn("sample", F.explode(F.sequence(F.lit(0), F.element_at("n", -1))))
    own = F.filter("m", lambda x, i: F.get("n", i) == F.col("sample"))
    entries = F.transform(own, lambda x: F.struct(x["s"].alias("key"), x["d"].alias("value")))
    return samples.select("url", "key", F.element_at(own, 1)["_pos"].alias("first_position"), F.map_from_entries(entries).alias("members"))


def triplets(files: DataFrame) -> DataFrame:
    """(path, content) files to one row per base name with a jpg; captions default to '' and are trimmed."""
    base = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    kind = F.regexp_extract("path", r"\.([^./]*)$", 1)
    pick = lambda k: F.max(F.when(kind == k, F.col("content")))
    text = lambda k: strip_space(F.coalesce(pick(k).cast("string"), F.lit("")))
    rows = files.withColumn("base", base).groupBy("base").agg(pick("jpg").alias("image"), text("caption").alias("caption"), text("shortcaption").alias("short_caption"))
    return rows.filter(F.col("image").isNotNull())


def read_image_triplets(spark: SparkSession, folder: str) -> DataFrame:
    return triplets(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content"))


IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


def label_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id: description`` lines to (label, description)."""
    return lines.select(F.trim(F.split_part(column, F.lit(":"), F.lit(1))).alias("label"), F.trim(F.regexp_replace(column, r"^[^:]*:", "")).alias("description")).filter("label <> ''")


def labelled_files(files: DataFrame, labels: DataFrame, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Files of allowed kinds with the class of their folder and its description; empty files are left out."""
    tagged = files.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("_kind", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    return tagged.filter(F.col("_kind").isin(*suffixes) & (F.length("content") > 0)).drop("_kind").join(labels, "label", "left")


def read_labelled_folders(spark: SparkSession, root: str, mapping: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    return labelled_files(files, label_lines(spark.read.text(mapping)))


def resolve_image_reference(df: DataFrame, index: str = "idx", image: str = "image") -> DataFrame:
    """Cells of up to 64 characters name the row that holds the image; followed once."""
    holders = df.filter(F.length(image) > 64).select(F.col(index).cast("string").alias("_ref"), F.col(image).alias("_held"))
    pointer = F.when(F.length(image) <= 64, F.col(image))
    return df.withColumn("_ref", pointer).join(holders, "_ref", "left").withColumn(image, F.coalesce("_held", image)).drop("_ref", "_held")


def decode_images(df: DataFrame, images: str, path: str) -> DataFrame:
    """Base64 cells (an array per row) to one binary row each; the i-th of several gets ``_i`` before the suffix."""
    flat = df.withColumn("_n", F.size(images)).select("*", F.posexplode(images).alias("_i", "_b64"))
    stem, kind = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)?$", 0)
    name = F.when(F.col("_n") > 1, F.concat(stem, F.lit("_"), F.col("_i").cast("string"), kind)).otherwise(F.col(path))
    return flat.select(*[c for c in df.columns if c not in (images, path)], name.alias("image_path"), F.unbase64("_b64").alias("image"))


def checksum(df: DataFrame, key: str, content: str, expected: DataFrame | None = None) -> DataFrame:
    """md5 of every row's content; with (key, expected) also whether it matches."""
    out = df.select(key, F.md5(F.col(content)).alias("md5"))
    if expected is None:
        return out
    return out.join(expected, key, "left").withColumn("matches", F.coalesce(F.col("md5") == F.col("expected"), F.lit(False)))


def concat_datasets(tables: Mapping[str, DataFrame], index: str = "idx") -> DataFrame:
    """Named tables under each other with SUB_DATASET, original_index and a new dense index in table and index order."""
    tagged = [df.withColumn("SUB_DATASET", F.lit(n)).withColumn("_table", F.lit(i)) for i, (n, df) in enumerate(tables.items())]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).withColumnRenamed(index, "original_index")
    placed = ranked(every, ["original_index"], ["_table"], name="_rank")
    sizes = every.groupBy("_table").agg(F.count(F.lit(1)).alias("_size"))
    # one row per named table
    earlier = Window.partitionBy(F.lit(0)).orderBy("_table").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_table", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    return placed.join(F.broadcast(shifts), "_table").withColumn(index, F.col("_rank") + F.col("_shift")).drop("_table", "_rank", "_shift")


def split_dataset(df: DataFrame, name: str, index: str = "idx") -> DataFrame:
    """The rows of one named table with their own index, for scoring."""
    return df.filter(F.col("SUB_DATASET") == name).drop(index, "SUB_DATASET").withColumnRenamed("original_index", index)


def submission(df: DataFrame, key: str, prediction: str, options: Column, is_choice: Column) -> DataFrame:
    """id -> inferred letter for choice rows, raw text for open rows."""
    from scorewright.functions.extract import infer
    return df.select(key, F.when(is_choice, infer(F.col(prediction), options)).otherwise(F.col(prediction)).alias("answer"))


QUESTION_FILE = "imageName STRING, questions MAP<STRING, STRUCT<questionId: STRING, answerTexts: ARRAY<STRING>, correctAnswer: INT, abcLabel: BOOLEAN>>"


def explode_question_files(files: DataFrame, text: str, test_ids: DataFrame) -> DataFrame:
    """One JSON text per image to choice rows: idx = main * 100 + sub, options A-D, the right position as a letter.

    Images outside ``test_ids`` (column id) are left out.
    """
    parsed = files.select(F.from_json(text, QUESTION_FILE).alias("f")).select(F.split_part("f.imageName", F.lit("."), F.lit(1)).alias("id"), "f.questions")
    kept = parsed.join(test_ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    flat = kept.select("id", F.explode("questions").alias("question", "q"))
    number = F.split_part("q.questionId", F.lit(".png-"), F.lit(1)).cast("bigint") * 100 + F.split_part("q.questionId", F.lit(".png-"), F.lit(2)).cast("bigint")
    answer = F.get(F.array(*[F.lit(x) for x in "ABCD"]), F.col("q.correctAnswer"))
    return flat.select(number.alias("idx"), "question", *[F.get("q.answerTexts", F.lit(i)).alias(x) for i, x in enumerate("ABCD")], answer.alias("answer"), F.col("q.abcLabel").alias("abc_label"))
