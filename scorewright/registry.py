"""Named scorers, extractors and reports: user functions are looked up by name when a table is scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SCORERS: dict[str, Callable[..., Column]] = {}
EXTRACTORS: dict[str, Callable[..., Column]] = {}
REPORTS: dict[str, Callable[..., DataFrame]] = {}


def register_scorer(name: str, column_fn: Callable[..., Column]) -> None:
    SCORERS[name] = column_fn


def register_pandas_scorer(name: str, pandas_udf) -> None:
    """A vectorised UDF scorer; inputs cross in Arrow batches."""
    SCORERS[name] = lambda *cols, **_: pandas_udf(*cols)


def register_extractor(name: str, column_fn: Callable[..., Column]) -> None:
    EXTRACTORS[name] = column_fn


def register_report(name: str, df_fn: Callable[..., DataFrame]) -> None:
    REPORTS[name] = df_fn


def score(df: DataFrame, rule: str, *cols: str, output: str = "score", **options) -> DataFrame:
    """Add a DOUBLE ``output`` column computed by the named scorer."""
    return df.withColumn(output, SCORERS[rule](*[F.col(c) for c in cols], **options).cast("double"))


def extract(df: DataFrame, rule: str, *cols: str, output: str = "choice", **options) -> DataFrame:
    """Add what the named extractor reads from the columns."""
    return df.withColumn(output, EXTRACTORS[rule](*[F.col(c) for c in cols], **options))


def report(df: DataFrame, name: str, **options) -> DataFrame:
    return REPORTS[name](df, **options)
