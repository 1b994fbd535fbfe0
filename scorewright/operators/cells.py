"""Dyadic cells: a span of any length is a few cells of doubling width, so long and short spans meet in one equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def bin_of(at: Column, width: float) -> Column:
    return F.floor(at / width).cast("bigint")


def cells_of(df: DataFrame, first: Column, last: Column, levels: Column, names: Sequence[str] = ("level", "no", "part")) -> DataFrame:
    """Rows sent to the dyadic cells that touch their bins first..last: columns level, number and ``part``.

    ``part`` is false for the fewest cells that make up the bins, at most two a level, and true for the larger cells up to ``levels`` that hold
    one of these and stick out, at most two a level as well. ``levels`` is at least the level of the longest span, floor(log2(bins)). Nothing
    is sent when last < first or either is null. No lambdas, so the work stays in generated code.
    """
    level, no, part = names
    found = df.withColumns({"_a": first, "_b": last}).where("_b >= _a").withColumn("_k", F.explode(F.sequence(F.lit(0), levels)))
    # cells low..after-1 of a level lie inside; shifts of long numbers round down
    found = found.withColumns({"_low": F.expr("-shiftright(-_a, _k)"), "_after": F.expr("shiftright(_b + 1, _k)")})
    found = found.withColumns({"_up_low": F.expr("-shiftright(-_a, _k + 1)"), "_up_after": F.expr("shiftright(_b + 1, _k + 1)"), "_from": F.expr("shiftright(_a, _k)"), "_to": F.expr("shiftright(_b, _k)")})
    whole = lambda n: f"NOT (shiftright({n}, 1) >= _up_low AND shiftright({n}, 1) < _up_after)"
    cell = lambda n, partly, when: F.struct(F.expr(n).alias("no"), F.lit(partly).alias("part"), F.expr(when).alias("keep"))
    four = F.array(cell("_low", False, f"_low < _after AND {whole('_low')}"), cell("_after - 1", False, f"_low < _after - 1 AND {whole('_after - 1')}"),
                   cell("_from", True, "_from < _low OR _from >= _after"), cell("_to", True, "(_to < _low OR _to >= _after) AND _to <> _from"))
    kept = found.select(*df.columns, F.col("_k").alias(level), F.inline(four).alias(no, part, "_keep")).where("_keep")
    return kept.drop("_keep")


def top_level(sides: Sequence[tuple[DataFrame, Column, Column]], width: float) -> Column:
    """Level of the longest span of all sides, as a scalar subquery."""
    longest = [df.agg(F.max(F.abs(bin_of(end, width) - bin_of(start, width)) + 1).alias("n")) for df, start, end in sides]
    every = longest[0]
    for more in longest[1:]:
        every = every.unionByName(more)
    # half a bin more than the count keeps the logarithm on the safe side of a power of two
    return every.agg(F.greatest(F.coalesce(F.floor(F.log2(F.max("n") + 0.5)), F.lit(0)), F.lit(0)).cast("int").alias("l")).scalar()


def _leveled(df: DataFrame, side: str, keys: Sequence[str], axes: Sequence[tuple[str, str]], widths: Sequence[float]) -> DataFrame:
    """Rows with whole spans, columns but the keys named by side: first and last bin ``_a``, ``_b`` and ``_level`` of each axis."""
    out = df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])
    for i, (axis, width) in enumerate(zip(axes, widths)):
        ends = [F.col(f"{side}_{c}") for c in axis]
        bins = [bin_of(e, width) for e in ends]
        out = out.where(ends[0].isNotNull() & ends[1].isNotNull()).withColumns({f"_a{i}": F.least(*bins), f"_b{i}": F.greatest(*bins)})
        # a rounded logarithm may give a neighbouring level, which costs a cell and loses nothing
        wide = F.col(f"_b{i}") - F.col(f"_a{i}")
        out = out.withColumn(f"_level{i}", F.when(wide <= 1, 0).otherwise(F.ceil(F.log2(wide))).cast("int"))
    return out


def _dealt(mine: DataFrame, other: DataFrame, side: str, axes: int) -> DataFrame:
    """Leveled rows sent to the cells they touch, for each combination of levels that ``other`` has: levels ``_l``, ``_r`` and cell ``_no``."""
    levels, seen = [f"_level{i}" for i in range(axes)], [f"_seen{i}" for i in range(axes)]
    held = other.agg(F.collect_set(F.struct(*[F.col(l).alias(s) for l, s in zip(levels, seen)]))).scalar()
    out = mine.withColumn("_s", F.explode(held)).select("*", "_s.*").drop("_s")
    for i in range(axes):
        ends = [F.expr(f"shiftright({n}{i}, greatest(_level{i}, _seen{i}))") for n in ("_a", "_b")]
        out = out.withColumn(f"_no{i}", F.explode(F.sequence(*ends))).drop(f"_a{i}", f"_b{i}")
    one, two = (levels, seen) if side == "l" else (seen, levels)
    return out.withColumnsRenamed({c: f"_{p}{i}" for p, names in (("l", one), ("r", two)) for i, c in enumerate(names)})


def span_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], axes: Sequence[tuple[str, str]], widths: Sequence[float]) -> DataFrame:
    """Pairs of left and right rows of the keys whose closed spans meet on every axis; each pair once. Columns: keys, l_* and r_*.

    ``axes`` names the (start, end) columns. A row's level on an axis is the first whose cells, twice as wide each, hold its bins in two at most.
    Rows of two levels meet in the cells of the higher one, so a row is sent, for each combination of levels that the other side has, to the
    cells it touches there: two an axis at most, mostly one. Only rows of those two levels are compared there, and of the cells that hold both
    the one with the later start counts. A few combinations are in use, however many rows there are, and no more than the logarithm of the
    longest span an axis. Spans with a null end meet nothing. A span that ends before it starts meets what its two ends, taken as they are, allow.
    """
    keys = list(keys)
    one, two = _leveled(left, "l", keys, axes, widths), _leveled(right, "r", keys, axes, widths)
    cells = [f"_{p}{i}" for p in ("l", "r", "no") for i in range(len(axes))]
    pairs = _dealt(one, two, "l", len(axes)).join(_dealt(two, one, "r", len(axes)), [*keys, *cells])
    for i, ((s, e), width) in enumerate(zip(axes, widths)):
        later = bin_of(F.greatest(F.col(f"l_{s}"), F.col(f"r_{s}")), width)
        pairs = pairs.where((F.col(f"l_{s}") <= F.col(f"r_{e}")) & (F.col(f"r_{s}") <= F.col(f"l_{e}")))
        pairs = pairs.withColumn("_later", later).where(F.expr(f"shiftright(_later, greatest(_l{i}, _r{i})) = _no{i}")).drop("_later")
    return pairs.drop(*cells)
