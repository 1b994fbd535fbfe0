"""Corpus preparation as a list of stages, each a DataFrame step over the documents that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.llm.decontaminate import contaminated, text_key
from scorewright.llm.line_dedup import line_dedup
from scorewright.llm.mixing import mixed
from scorewright.llm.near_duplicates import near_duplicates, row_key
from scorewright.llm.tables import saved, table
from scorewright.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; a document goes only when every word of it was a repeat."""
    cut = line_dedup(docs)
    cut = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; equal rows are one."""
    stay = near_duplicates(docs).where("stays").select(F.col("row_key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    return keyed.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumn("__own", text_key("text"))
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken: ``copy`` counts from 1. Equal rows are taken together."""
    taken = mixed(docs).groupBy(F.col("key").alias("__key")).agg(F.sum("copies").alias("__copies")).where("__copies > 0")
    keyed = docs.withColumn("__key", row_key("doc_id", "text")).join(taken, "__key").dropDuplicates(["__key"])
    copy = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy")
    return keyed.select(*[c for c in docs.columns if c != "copy"], copy)


STAGES = [("toxicity", drop_toxic), ("line dedup", cut_repeated_lines), ("near duplicates", keep_one_of_each), ("decontamination", drop_contaminated), ("mixing", mix)]

# Learned scores and drawn copies have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
