"""Rows of few row groups are dealt to all cores, and parts of a text are worked out once for several rules."""

from pyspark.sql import functions as F

from scorewright.functions import score as S
from scorewright.operators.constraints import rules_held
from scorewright.operators.skew import spread


def _most(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    rows = 4_000
    spark.range(rows).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(str(tmp_path / "one"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    cores = spark.sparkContext.defaultParallelism
    try:
        for n in names:
            spark.conf.set(n, "8k")
        df = spark.read.parquet(str(tmp_path / "one"))
        assert df.rdd.getNumPartitions() >= cores and _most(df) == rows
        dealt = spread(df)
        assert _most(dealt) < 2 * rows / cores
        assert dealt.distinct().count() == rows
        # rows that are spread already stay where they are
        wide = spark.range(rows).repartition(cores)
        assert spread(wide) is wide
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_rules_share_the_parts_of_a_text(spark):
    texts = ["One. Two! 'Three?' Four", " A b.\r\n\r\n  A c. \n \n\tD \r e.", "\r", "", " ", None, "a \r b.  \x0b\n x", "A.\n\n\nB.\"  C)", "a \x85   b. c"]
    rules = {"p": ("paragraph_count", 1, 2), "s": ("sentence_count", 2, 3), "w": ("word_count", 2, 4), "e": ("sentences_end_with", "."), "b": ("paragraphs_begin_with", "A"), "l": ("sentences_per_listed_paragraph", [[1, 2], [1, 2]])}
    df = spark.createDataFrame(list(enumerate(texts)), "idx int, text string")
    held = rules_held(df, "text", rules)
    # the last rule trims each paragraph anew, the others share one trimmed text
    flat = rules_held(df, "text", {n: rule for n, rule in rules.items() if n != "l"})
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("(?m)") == 1
    one = df.select("idx", "text", *[S.text_constraint(r, F.col("text"), *p).alias(n) for n, (r, *p) in rules.items()])
    assert sorted(held.collect(), key=lambda r: r.idx) == sorted(one.collect(), key=lambda r: r.idx)


def test_blanks_are_trimmed_as_by_the_plain_pattern(spark):
    texts = ["a \r b", " \r\n x \r", "a   b \x85\t c", "  \r \r\n\r \n  x\t\x0b \n", "\r", "x \r\r y", "", " ", " \n \n x \x85 \n", "  a   "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"(?m)^[^\S\n]+|[^\S\n]+$", ""), r"^\s+|\s+$", "")
    assert df.where(plain != S.lines_trimmed(F.col("text"))).count() == 0
