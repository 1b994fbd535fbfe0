"""Deletion of repeated runs of lines: winnowing over line hashes, positions joined, matches extended both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.llm.tables import saved

MIN_WORDS = 50
_KEY = ["id", "key"]


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per distinct (id, text): hashes, word counts and line numbers of its lines with words."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    line = F.transform(F.split(whole, "\n", -1), lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"), i.alias("i")))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id), whole).alias("key"), F.filter(line, lambda x: x.w > 0).alias("lines"))
    return rows.groupBy(*_KEY).agg(F.first("lines").alias("lines"))


def _fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """(print, id, key, at): the least line hash of every window, and its place.

    A window is the fewest whole lines from a line on, or up to a line, that hold ``min_words`` words. The print joins the minimum with the lines of
    the window that chose it, in their order, so that a line common to many contexts does not bring those contexts together and equal prints are
    equal windows. A window has ``min_words`` lines at most.
    """
    rows = lines.select(*_KEY, F.posexplode("lines").alias("p", "x")).select(*_KEY, "p", "x.h", "x.w")
    whole = Window.partitionBy(*_KEY)
    rows = rows.withColumn("to", F.sum("w").over(whole.orderBy("p"))).withColumn("from", F.col("to") - F.col("w"))
    def chosen(side: str, frame) -> Column:
        low = F.min(F.struct("h", "p")).over(frame)
        return F.struct(F.lit(side).alias("side"), low.alias("low"), F.xxhash64(F.collect_list("h").over(frame)).alias("digest"), F.sum("w").over(frame).alias("words"))

    # word offsets grow by at least one a line, so a range of them is a run of lines
    ahead = chosen("f", whole.orderBy("from").rangeBetween(0, min_words - 1))
    behind = chosen("b", whole.orderBy("to").rangeBetween(-(min_words - 1), 0))
    windows = rows.select(*_KEY, ahead.alias("f"), behind.alias("b")).select(*_KEY, F.explode(F.array("f", "b")).alias("v")).where(F.col("v.words") >= min_words)
    return windows.select(*_KEY, F.xxhash64("v.side", "v.low.h", "v.digest").alias("print"), F.col("v.low.p").alias("at"))


def _diagonals(prints: DataFrame) -> DataFrame:
    """(id, key, src_id, src_key, shift): where the lines of a document may repeat earlier ones, ``shift`` places before.

    The first document with a print is the source of the others; places in one document refer to the place before.
    """
    own = saved(prints.groupBy("print", *_KEY).agg(F.array_sort(F.collect_set("at")).alias("places")))
    first = F.min(F.struct("id", "key", F.col("places")[0].alias("at")))
    first = own.groupBy("print").agg(first.alias("s"), F.sum(F.size("places")).alias("uses")).where("uses > 1").select("print", "s")
    met = own.join(first, "print")
    other = met.where(~(F.col("id").eqNullSafe(F.col("s.id")) & (F.col("key") == F.col("s.key"))))
    other = other.select(*_KEY, F.col("s.id").alias("src_id"), F.col("s.key").alias("src_key"), (F.col("places")[0] - F.col("s.at")).alias("shift"))
    steps = F.array_distinct(F.zip_with(F.slice("places", 2, F.size("places") - 1), F.slice("places", 1, F.size("places") - 1), lambda a, b: a - b))
    same = met.where(F.size("places") > 1).select(*_KEY, F.col("id").alias("src_id"), F.col("key").alias("src_key"), F.explode(steps).alias("shift"))
    return other.unionByName(same).distinct()


def _repeats(lines: DataFrame, diagonals: DataFrame, min_words: int) -> DataFrame:
    """(id, key, gone): the line numbers of each document in runs of at least ``min_words`` words that repeat earlier ones."""
    source = lines.select(F.col("id").alias("src_id"), F.col("key").alias("src_key"), F.transform("lines", lambda x: x.h).alias("src"))
    both = diagonals.join(lines.withColumnRenamed("id", "own_id"), F.col("id").eqNullSafe(F.col("own_id")) & (diagonals["key"] == lines["key"]))
    both = both.select("id", diagonals["key"], "src_id", "src_key", "shift", "lines")
    both = both.join(source.withColumnRenamed("src_id", "s_id").withColumnRenamed("src_key", "s_key"), F.col("src_id").eqNullSafe(F.col("s_id")) & (F.col("src_key") == F.col("s_key")))
    low = F.greatest(F.col("shift"), F.lit(0))
    high = F.least(F.size("lines"), F.size("src") + F.col("shift")) - 1
    # try_element_at counts from 1, so place i is element i + 1
    span = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    equal = F.filter(span, lambda i: F.element_at("lines", (i + 1).cast("int")).h == F.element_at("src", (i - F.col("shift") + 1).cast("int")))
    # matching places in a row keep the same distance to their rank
    hits = both.withColumn("equal", equal).select("id", "key", "src_id", "src_key", "shift", "lines", F.posexplode("equal").alias("rank", "p"))
    hits = hits.select("id", "key", "src_id", "src_key", "shift", (F.col("p") - F.col("rank")).alias("run"), F.element_at("lines", (F.col("p") + 1).cast("int")).alias("x"))
    runs = hits.groupBy("id", "key", "src_id", "src_key", "shift", "run").agg(F.sum("x.w").alias("words"), F.collect_list("x.i").alias("i")).where(F.col("words") >= min_words)
    return runs.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_list("i"))).alias("gone"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated runs of lines: the text holds what is left, and n_lines, n_removed (long) are added.

    A line goes when it lies in a run of lines, at least ``min_words`` words in all, that is equal to a run that starts earlier: in a document with a
    smaller id, or further up in the same one. So the first copy of every run stays. Lines end at line feeds; lines without words are passed over in the
    comparison and always stay. Every such run holds a window on both sides, so none is missed. A null text has no lines and stays null; rows with
    a null id come first, equal rows are one document, rows that share an id but not the text follow by a hash of it. Columns of ``docs`` named like an added one are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = saved(_lines(docs, doc_id, text))
    gone = _repeats(lines, _diagonals(_fingerprints(lines, min_words)), min_words)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = gone.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    joined = docs.select(*kept).withColumn("__own", F.xxhash64(F.col(doc_id), whole))
    joined = joined.join(found, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    parts = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__gone")
    cut = F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n")
    columns = [F.when(F.col("__gone").isNull(), F.col(text)).otherwise(cut).alias(text) if c == text else F.col(c) for c in kept]
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long")
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
