"""Rule-based constraints of free text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from scorewright.functions.score import lines_trimmed, paragraphs, sentences, text_constraint


def rules_held(df: DataFrame, text: str, rules: Mapping[str, tuple]) -> DataFrame:
    """``df`` with one boolean column for each named rule (name, params...); the text is trimmed and cut into paragraphs and sentences once for all rules."""
    t, trimmed, parts = F.col(text), F.col("_trimmed"), (F.col("_paragraphs"), F.col("_sentences"))
    cut = df.withColumn("_trimmed", lines_trimmed(t)).withColumns({"_paragraphs": paragraphs(t, trimmed), "_sentences": sentences(t, trimmed)})
    held = {name: text_constraint(rule, t, *params, parts=parts) for name, (rule, *params) in rules.items()}
    return cut.withColumns(held).drop("_trimmed", "_paragraphs", "_sentences")


def constraint_score(df: DataFrame, key: str, text: str, constraints: Mapping[str, Sequence[tuple]]) -> DataFrame:
    """Mean over the constraints of an item; a constraint holds when all its rules (name, params...) do."""
    named = {f"_rule{i}_{j}": rule for i, rules in enumerate(constraints.values()) for j, rule in enumerate(rules)}
    held = rules_held(df, text, named)
    parts = [reduce(lambda a, b: a & b, [F.col(f"_rule{i}_{j}") for j in range(len(rules))], F.lit(True)).cast("double") for i, rules in enumerate(constraints.values())]
    flat = held.select(key, F.explode(F.array(*parts)).alias("ok"))
    return flat.groupBy(key).agg(F.avg("ok").alias("score"))
