"""Query catalogue: each entry pairs a Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.operators.skew import spread
from scorewright.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derive(self, table: str, select: str, deal: bool = False) -> DataFrame:
        """Rows of ``table`` reshaped by a SELECT list that both engines understand.

        ``deal`` spreads a table held in fewer files than there are cores before costly row work.
        """
        source = spread(getattr(self, table)) if deal else getattr(self, table)
        kept = select.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(f"SELECT {kept} FROM {{src}}", src=source)


def query(name: str, sql: str | None = None, doubles: str = "", ints: str = "", digits: int = 6):
    """Register ``fn(tables)`` under ``name`` with its check statement.

    ``doubles`` are rounded to ``digits`` places and ``ints`` cast to BIGINT on both sides, so that both engines compare alike.
    """
    rounded, counted = doubles.split(), ints.split()

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Tables(configure(spark), folder))
            fixed = {c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in rounded}
            fixed |= {c: F.col(c).cast("bigint") for c in counted}
            return df.withColumns(fixed) if fixed else df

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            casts = [f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in rounded]
            casts += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in counted]
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return fn

    return wrap


def over(table: str, select: str, body: str) -> str:
    """Check statement over the derived rows ``d`` of a table."""
    return f"WITH d AS (SELECT {select} FROM {table}) {body}"


def sets_sql(sets: dict[str, list[str]], aggs: str, by: str = "", source: str = "d") -> str:
    """UNION ALL of plain groupings, one per named set, in the shape of the long reports."""
    head = f"{by}, " if by else ""
    parts = []
    for name, keys in sets.items():
        value = "concat_ws('/', " + ", ".join(keys) + ")" if keys else "'all'"
        group = ", ".join([*([by] if by else []), *keys])
        parts.append(f"SELECT {head}'{name}' AS dim, {value} AS value, {aggs} FROM {source}" + (f" GROUP BY {group}" if group else ""))
    return " UNION ALL ".join(parts)
