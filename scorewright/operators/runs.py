"""Tables of results: what is left to do, merging, failure scans and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.extract import FAILED


def failed(text: Column) -> Column:
    return text.isNull() | text.contains(FAILED)


def resume_todo(rows: DataFrame, results: DataFrame, index: str, result: str, ignore_failed: bool = False) -> DataFrame:
    """Rows without a result; failed results are tried again unless ``ignore_failed``."""
    done = results if ignore_failed else results.filter(~failed(F.col(result)))
    return rows.join(done.select(index), index, "left_anti")


def merge_partial_results(parts: Sequence[DataFrame], index: str, order: str) -> DataFrame:
    """Union of partial result tables; the latest row of an index (by ``order``, then part) wins."""
    every = None
    for n, part in enumerate(parts):
        tagged = part.withColumn("_part", F.lit(n))
        every = tagged if every is None else every.unionByName(tagged)
    rest = [c for c in every.columns if c not in (index, "_part", order)]
    # a maximum per index combines before the shuffle
    last = every.groupBy(index).agg(F.max(F.struct(order, "_part", *rest)).alias("_m"))
    return last.select(index, F.col(f"_m.{order}").alias(order), *[F.col(f"_m.{c}").alias(c) for c in rest])


def missing_results(rows: DataFrame, results: DataFrame, index: str) -> DataFrame:
    """Indices without any result; must be empty before scoring."""
    return rows.select(index).join(results.select(index), index, "left_anti")


def failure_scan(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Count and share (%) of failures per key and rule (a rule is a boolean column)."""
    flags = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(r, F.lit(False)).alias("bad")) for n, r in rules.items()]))
    flat = df.select(*keys, flags.alias("f"))
    out = flat.groupBy(*keys, "f.rule").agg(F.count_if(F.col("f.bad")).alias("failed"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("share", F.col("failed") / F.col("total") * 100)


def summary_table(scores: DataFrame, headline: Mapping[str, str]) -> DataFrame:
    """Models as rows, the headline metric of each benchmark as a column; (model, benchmark, metric, value) rows in."""
    wanted = F.array(*[F.lit(f"{b}|{m}") for b, m in headline.items()])
    kept = scores.filter(F.array_contains(wanted, F.concat_ws("|", "benchmark", "metric")))
    return kept.groupBy("model").pivot("benchmark", list(headline)).agg(F.first("value"))


def multi_experiment_summary(df: DataFrame, datasets: Sequence[str], weighted: bool = False) -> DataFrame:
    """(metric, experiment, dataset, value, n) to one row per metric and experiment in %, with the mean, "-" if any is missing."""
    kept = df.filter(F.col("dataset").isin(*datasets) & (F.col("value") != -1))
    cells = [(F.max(F.when(F.col("dataset") == d, F.col("value"))) * 100).alias(d) for d in datasets]
    mean = F.sum(F.col("value") * F.col("n")) / (F.sum("n") + 1e-9) if weighted else F.sum("value") / (len(datasets) + 1e-9)
    out = kept.groupBy("metric", "experiment").agg(*cells, (mean * 100).alias("_mean"), F.count_distinct("dataset").alias("_have"))
    return out.select("metric", "experiment", *datasets, F.when(F.col("_have") == len(datasets), F.format_string("%.2f", "_mean")).otherwise("-").alias("summary"))


def latest_run(runs: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """Newest run of each key that holds a result."""
    return runs.groupBy(*keys).agg(F.max(run).alias(run))


def response_ratio(gold: DataFrame, responses: DataFrame, key: str, parsed: str) -> DataFrame:
    """Answered share of the gold files, with parsed, unreadable and missing counts."""
    joined = gold.select(key).join(responses.select(key, F.col(parsed).isNotNull().alias("_ok")), key, "left")
    n = lambda c: F.count_if(c)
    return joined.agg(F.count(F.lit(1)).alias("gold"), n(F.col("_ok")).alias("parsed"), n(~F.col("_ok")).alias("unreadable"), n(F.col("_ok").isNull()).alias("missing")).withColumn(
        "ratio", (F.col("parsed") + F.col("unreadable")) / (F.col("gold") + 1e-9))


def validation_check(predictions: DataFrame, metadata: DataFrame, index: str, required: Sequence[str]) -> DataFrame:
    """Problem rows: unknown index, index that is no integer; missing columns raise at once."""
    absent = [c for c in required if c not in predictions.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    known = metadata.select(F.col(index).cast("string").alias(index)).withColumn("_known", F.lit(True))
    tagged = predictions.select(F.col(index).cast("string").alias(index)).join(known, index, "left")
    problem = F.when(F.col(index).try_cast("bigint").isNull(), "not an integer").when(F.col("_known").isNull(), "unknown index")
    return tagged.select(index, problem.alias("problem")).filter("problem is not null")


def speed_report(log: DataFrame, tokens: str, seconds: str) -> DataFrame:
    return log.agg(F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"), (F.sum(tokens) / F.sum(seconds)).alias("tokens_per_second"), F.count(F.lit(1)).alias("calls"))
