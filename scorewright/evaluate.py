"""One benchmark run as one lazy plan: join, clean, extract, score, report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.builtins import register_builtins
from scorewright.functions.text import drop_rejected
from scorewright.registry import extract, report, score


@dataclass
class Spec:
    """How a benchmark is scored: an extraction of the prediction, a named scorer, a named report and their options.

    ``extract`` is the name of an extractor, read from the columns ``extract_from``, or a function of the joined table. ``grouping`` is
    vanilla, or circular: rows that share ``g_index`` are rotations of one question, which hits only when all of them do.
    """

    scorer: str = "exact"
    report: str = "accuracy_report"
    extract: str | Callable[[DataFrame], Column] | None = None
    extract_from: Sequence[str] = ("prediction",)
    grouping: str = "vanilla"
    index: str = "idx"
    drop_failed: bool = False
    extract_options: Mapping[str, object] = field(default_factory=dict)
    scorer_options: Mapping[str, object] = field(default_factory=dict)
    report_options: Mapping[str, object] = field(default_factory=dict)


def scored(predictions: DataFrame, answers: DataFrame, spec: Spec) -> DataFrame:
    """Answer rows with their prediction, the extracted choice and a ``hit`` score; unread predictions score 0."""
    register_builtins()
    kept = drop_rejected(predictions, "prediction") if spec.drop_failed else predictions
    joined = answers.join(kept.select(spec.index, "prediction"), spec.index)
    if isinstance(spec.extract, str):
        read = extract(joined, spec.extract, *spec.extract_from, **spec.extract_options)
    else:
        read = joined.withColumn("choice", spec.extract(joined) if spec.extract else F.col("prediction"))
    out = score(read, spec.scorer, "choice", "answer", output="hit", **spec.scorer_options).fillna(0.0, ["hit"])
    if spec.grouping == "vanilla":
        return out
    if spec.grouping != "circular":
        raise ValueError(f"no grouping {spec.grouping}")
    groups = out.groupBy("g_index").agg(F.min("hit").alias("hit"))
    return out.filter(F.col(spec.index) == F.col("g_index")).drop("hit").join(groups, "g_index")


def evaluate(predictions: DataFrame, answers: DataFrame, spec: Spec) -> DataFrame:
    return report(scored(predictions, answers, spec), spec.report, **spec.report_options)
