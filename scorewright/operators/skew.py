"""Ranking, neighbour windows and joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.session import partitions

# A key is hot when it holds more than this share of the rows, so at most 1/HOT_SHARE keys can be hot.
HOT_SHARE = 0.002

# Rows a task sorts or groups at a time where tables are dealt out by their size.
TASK_ROWS = 250_000


# Texts are compared by this many characters; cuts come from about this many different values.
TEXT_KEY = 1_024
TEXT_SAMPLE = 20_000
_DRAW = 1 << 30


def _sort_value(df: DataFrame, name: str) -> Column:
    """A value in the order of the column: a number, times as seconds, texts by their beginning."""
    kind = dict(df.dtypes)[name]
    if kind.startswith(("timestamp", "date")):
        return F.col(name).cast("timestamp").cast("double")
    if kind == "string":
        return F.substring(name, 1, TEXT_KEY)
    if kind.startswith(("decimal", "double", "float", "bigint", "int", "smallint", "tinyint", "boolean")):
        return F.col(name).cast("double")
    raise TypeError(f"cannot order by {name} of type {kind}")


def _text_cuts(values: DataFrame, buckets: int) -> DataFrame:
    """One row: ``c``, the quantiles of the texts ``v`` as an array; a value that fills several quantiles is there several times.

    Values are counted (combined before their shuffle); those that fill a quantile alone all count, the others through a hash share of about
    TEXT_SAMPLE of them, each standing for those not drawn. So the window below sees a bounded number of rows.
    """
    counts = values.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.struct(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).alias("t"))
    counted = counts.withColumn("t", total.select("t").scalar())
    frequent = F.col("n") * buckets > F.col("t.rows")
    share = F.least(F.lit(1.0), TEXT_SAMPLE / F.col("t.values"))
    drawn = counted.where(frequent | (F.pmod(F.xxhash64("v"), F.lit(_DRAW)) < share * _DRAW)).select("v", F.when(frequent, F.col("n")).otherwise(F.col("n") / share).alias("w"))
    upto = Window.partitionBy(F.lit(0)).orderBy("v")
    run = drawn.select("v", "w", F.sum("w").over(upto).alias("to"), F.sum("w").over(Window.partitionBy(F.lit(0))).alias("all"))
    first = F.ceil((F.col("to") - F.col("w")) / F.col("all") * buckets - 1e-9)
    last = F.ceil(F.col("to") / F.col("all") * buckets - 1e-9) - 1
    cuts = run.select("v", first.alias("first"), last.alias("last")).where("last >= first").select("v", F.explode(F.sequence("first", "last")).alias("q"))
    return cuts.agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda x: x["v"]).alias("c"))


def _cuts(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """One row: ``c``, the quantiles of a column as an array."""
    values = df.select(_sort_value(df, name).alias("v"))
    if dict(df.dtypes)[name] == "string":
        return _text_cuts(values, buckets)
    return values.agg(F.percentile_approx("v", F.array(*[F.lit(i / buckets) for i in range(buckets)]), 20000).alias("c"))


def _range_number(bounds: str, heads: str, value: str, fine: int) -> Column:
    """How many cuts lie below the value: first among every ``fine``-th cut, then among the ``fine`` cuts from there on."""
    head = F.greatest(F.size(F.filter(heads, lambda b: b < F.col(value))), F.lit(1)) - 1
    return head * fine + F.size(F.filter(F.slice(bounds, head * fine + 1, fine), lambda b: b < F.col(value)))


def _bucketed(df: DataFrame, order: Sequence[str], buckets: int) -> DataFrame:
    """Add ``_bucket``: quantile ranges of the first order column (a number, time or text).

    A value so frequent that it fills several quantiles gets buckets of its own, cut by the quantiles of the second
    order column, so ties on the first column do not end in one task either.
    """
    fine = max(1, round(buckets**0.5))
    names = order[:2]
    tagged = df.withColumns({f"_value{i}": _sort_value(df, n) for i, n in enumerate(names)})
    # scalar subqueries: the cut lists, as many values as there are buckets, and every ``fine``-th of them
    for i, n in enumerate(names):
        bounds = _cuts(df, n, buckets).select(F.struct(F.col("c").alias("all"), F.filter("c", lambda b, k: k % fine == 0).alias("heads")).alias("b"))
        tagged = tagged.withColumn(f"_b{i}", bounds.scalar()).withColumns({f"_bounds{i}": F.col(f"_b{i}.all"), f"_heads{i}": F.col(f"_b{i}.heads")}).drop(f"_b{i}")
    number = lambda i: F.coalesce(_range_number(f"_bounds{i}", f"_heads{i}", f"_value{i}", fine), F.lit(0))
    # nulls come first, in buckets of their own
    first, below = F.when(F.col("_value0").isNull(), -1).otherwise(number(0)), F.lit(0)
    if len(names) > 1:
        frequent = F.col("_value0").isNull() | (F.get("_bounds0", first + 1) == F.col("_value0"))
        below = F.when(frequent, number(1) + 1).otherwise(0)
    return tagged.withColumn("_bucket", first.cast("bigint") * (buckets + 2) + below).drop(*[f"_{k}{i}" for k in ("value", "bounds", "heads") for i in range(len(names))])


def ordered(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    position: str | None = None,
    total: str | None = None,
    sums: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Ordered columns over whole groups: 0-based position, group size, running sums and the next row's value.

    Rows are sorted inside range buckets of the first order column (a number, time or text) and completed with the totals
    of the earlier buckets, so neither one global sort task nor one task per hot group is needed.
    ``sums`` maps output -> summed column, ``following`` maps output -> column read from the next row.
    """
    buckets = max(8, partitions(df.sparkSession))
    by, sums, following = list(by), dict(sums or {}), dict(following or {})
    keys = [*by, "_bucket"]
    tagged = _bucketed(df, order, buckets)
    head = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_f{i}") for i, c in enumerate(following.values())])
    stats = tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"),
        *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())],
        *([F.min(head).alias("_head")] if following else []))
    # at most one row per bucket and group reaches these windows
    run = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = run.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stats.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_size").over(run).alias("_total"),
        *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))],
        *[F.lead(F.col("_head")[f"_f{i}"]).over(run.orderBy("_bucket")).alias(f"_n{i}") for i in range(len(following))])
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumns({
        "_local": F.row_number().over(inside) - 1,
        **{f"_l{i}": F.sum(c).over(upto) for i, c in enumerate(sums.values())},
        **{f"_m{i}": F.lead(c).over(inside) for i, c in enumerate(following.values())},
        **({"_last": F.row_number().over(inside) == F.count(F.lit(1)).over(Window.partitionBy(*keys))} if following else {})})
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = local.join(shifts, match, "inner")
    out = [F.col(c) for c in df.columns]
    if position:
        out.append((F.col("_local") + F.col("_offset")).cast("bigint").alias(position))
    if total:
        out.append(F.col("_total").alias(total))
    out += [(F.col(f"_l{i}") + F.col(f"_o{i}")).alias(n) for i, n in enumerate(sums)]
    out += [F.when(F.col("_last"), F.col(f"_n{i}")).otherwise(F.col(f"_m{i}")).alias(n) for i, n in enumerate(following)]
    return joined.select(*out)


def ranked(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rn", total: str | None = None) -> DataFrame:
    """0-based exact position of each row in its group by ``order``."""
    return ordered(df, order, by, position=name, total=total)


def with_halo(df: DataFrame, position: str, before: int, after: int, chunk_rows: int = 65536) -> DataFrame:
    """Split each ordered group into chunks of ``chunk_rows`` positions and copy the edge rows into the neighbours.

    Windows partitioned by (group, ``_chunk``) then see ``before`` earlier and ``after`` later rows of every own row;
    keep rows where ``_own`` is true afterwards.
    """
    own = F.floor(F.col(position) / chunk_rows)
    first = F.greatest(F.lit(0), F.floor((F.col(position) - after) / chunk_rows))
    last = F.floor((F.col(position) + before) / chunk_rows)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_chunk") == own)


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", rows: int = 1_000_000) -> DataFrame:
    """Equi join whose hot keys on the ``big`` side are spread over copies of the matching ``small`` rows.

    Only keys above HOT_SHARE are spread, so the list that is broadcast has at most 1/HOT_SHARE rows; each gets one salt per ``rows`` of its rows.
    The salt is a hash of the row, so a stage that runs again deals the same way. Rows with a null key match nothing and stay out of the join.
    ``how`` is inner, left, left_semi or left_anti (each big row meets exactly one copy).
    """
    on = list(on)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    keyed = big.filter(whole)
    counts = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    limit = counts.agg(F.sum("_n") * F.lit(HOT_SHARE)).scalar()
    hot = counts.filter(F.col("_n") > limit).select(*on, F.greatest(F.lit(2), F.ceil(F.col("_n") / rows)).cast("int").alias("_salts"))
    salt = F.pmod(F.xxhash64(*[c for c, kind in big.dtypes if "map<" not in kind]), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = keyed.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_salts")
    copies = small.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    joined = dealt.join(copies, [*on, "_salt"], how).drop("_salt")
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(big.filter(~whole), allowMissingColumns=True)


def unit_hash(*parts: Column, seed: str = "0") -> Column:
    """Repeatable number in [0, 1) from a key: the seeded stand-in for a random draw."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def tasks_for(*tables: DataFrame, rows: int = TASK_ROWS) -> int | None:
    """Number of tasks that get about ``rows`` of the tables' rows each; None where the cores are enough. Rows of stored tables are read from their footers."""
    tasks = -(-sum(t.count() for t in tables) // rows)
    return tasks if tasks > tables[0].sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    """Rows dealt by their keys to ``tasks`` tasks, so that what a task sorts or holds does not grow with the table; None leaves it to Spark."""
    return df.repartition(tasks, *keys) if tasks else df


def side_by_side(df: DataFrame, order: Sequence[str], rows: int = TASK_ROWS) -> DataFrame:
    """Rows in order over tasks of about ``rows`` each, one a core at least, so that alike rows are written side by side.

    Meant for narrow rows from which long values are made: in this order a stored column holds what two rows share only once. Ranges are cut
    by all of ``order``, so its last column should tell rows with the same beginning apart.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input would keep less than half of the cores busy (a few small files, or a file of few row groups, before costly row work).

    A split of a file has the rows of the row groups that begin in it, so splits alone do not tell: their rows are counted, from the footers of a stored
    table. Inputs whose rows are spread pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores:
        rows = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n")).collect()]
        if max(rows, default=0) * cores <= 2 * sum(rows):
            return df
    return df.repartition(max(cores, splits))
