"""Lines of a page paired by edit distance without pricing every pair."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from scorewright.functions.alignment import mutual_partners
from scorewright.functions.text import let
from scorewright.sources.records import scratch

GRAM = 4
NEAR = 0.1  # edit share up to which partners come from the gram index
BLOCK = 64  # lines of one side that a line left over is held against at once
SAMPLE = 2_000  # lines whose grams tell which are common
PAGE_PAIRS, PAGE_CHARS = 4_000_000, 4_000_000  # pairs of lines and characters of a page up to which one row holds it
COMMON = (64, 512, 4_096)  # sizes of the classes of common grams, commonest first


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grams(line: Column) -> Column:
    """Distinct hashed grams of a line."""
    def cut(chars: Column) -> Column:
        last = F.size(chars) - GRAM
        joined = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.concat(*[F.get(chars, i + j) for j in range(GRAM)])))
        return F.when(last >= 0, F.array_distinct(joined)).otherwise(F.array().cast("array<bigint>"))

    # a negative limit keeps every character, also trailing blanks
    return let(F.filter(F.split(line, ""), lambda c: c != ""), cut)


def _edits(a: Column, b: Column, limit: Column) -> Column:
    """Edit distance if it is at most ``limit``, else null; small limits are tried first, as the work grows with them."""
    tried = [F.nullif(F.call_function("levenshtein", a, b, F.floor(limit / part).cast("int")), F.lit(-1)) for part in (8, 2, 1)]
    return F.when(a == b, 0).otherwise(F.coalesce(*tried))


def _cheaper(line: Column, known: Column, other: Column) -> Column:
    """``known`` (cost, other), or ``other`` with its cost if that is cheaper, or as cheap and a smaller text."""
    longest = F.greatest(F.length(line), F.length(other))
    gap = longest - F.least(F.length(line), F.length(other))
    limit = F.least(longest.cast("double"), F.floor(known["cost"] * longest + 1e-9))
    new = F.when(gap <= limit, F.struct((_edits(line, other, limit) / F.greatest(longest, F.lit(1))).alias("cost"), other.alias("other")))
    return let(new, lambda n: F.when((n["cost"] < known["cost"]) | ((n["cost"] == known["cost"]) & (known["other"].isNull() | (n["other"] < known["other"]))), n).otherwise(known))


def _ranked(grams: DataFrame) -> Column:
    """``g`` with the rarer grams first. Which ones are common comes from a sample; any order of the grams is complete, this one is short."""
    drawn = grams.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < F.col("share")).select(F.explode("g").alias("x"))
    known = [r["x"] for r in drawn.groupBy("x").count().orderBy(F.desc("count"), "x").limit(COMMON[-1]).collect()]
    tier = lambda x: sum((F.when(x.isin(known[:n]), 1).otherwise(0) for n in COMMON[1:]), F.when(x.isin(known[: COMMON[0]]), 1).otherwise(0)) if known else F.lit(0)
    return F.transform(F.array_sort(F.transform("g", lambda x: F.struct(tier(x).alias("tier"), x.alias("x")))), lambda s: s["x"])


def best_partners(gold: DataFrame, pred: DataFrame, page: str) -> DataFrame:
    """(page, side, line, cost, other): for each distinct line of a page the cheapest line of the other side, ties to the smaller text.

    Equal lines come from a join. Of the others, partners within the edit share NEAR come from a gram index: k edits change at most GRAM x k of a line's
    distinct grams, so two such lines share one of the first GRAM x k + 1 grams of each in any common order, and only these are joined, the rare
    ones first. Lines whose best partner is farther, or that have too few different grams to be sure, are held against all lines of the other
    side, in blocks; a line that has found its partner is no longer asked. Nothing is cut: every line meets its cheapest partner.
    """
    def lines(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col(page).alias("page"), "line").distinct().withColumn("side", F.lit(side))

    both = lines(gold, "g").unionByName(lines(pred, "p"))
    met = both.groupBy("page", "line").agg(F.count(F.lit(1)).alias("n"), F.first("side").alias("side"))
    sides = F.when(F.col("n") == 2, F.array(F.lit("g"), F.lit("p"))).otherwise(F.array("side"))
    most = F.floor(F.length("line") * (NEAR / (1 - NEAR)) + 1e-9)
    known = met.select("page", "line", F.explode(sides).alias("side"), (F.col("n") == 1).alias("open"), F.xxhash64("line").alias("id"), _grams(F.col("line")).alias("g"), most.alias("k"))
    known = _written(known.withColumn("sure", F.size("g") > GRAM * F.col("k")), "lines")
    share = F.lit(min(1.0, SAMPLE / max(1, known.count())) * (1 << 20))
    first = F.slice(_ranked(known.withColumn("share", share)), F.lit(1), (GRAM * F.col("k") + 1).cast("int"))
    keys = known.select("page", "side", "open", "id", F.explode(first).alias("gram"))
    take = lambda s, other: keys.where(F.col("side") == s).select("page", "gram", F.col("open").alias(f"{s}_open"), F.col("id").alias(f"{s}_id"))
    pairs = take("g", "p").join(take("p", "g"), ["page", "gram"]).where("g_open or p_open").select("page", "g_id", "p_id", "g_open", "p_open").distinct()
    text = lambda s: known.where(F.col("side") == s).select("page", F.col("id").alias(f"{s}_id"), F.col("line").alias(f"{s}_line"), F.col("sure").alias(f"{s}_sure"), F.col("g").alias(f"{s}_grams"))
    priced = pairs.join(text("g"), ["page", "g_id"]).join(text("p"), ["page", "p_id"])
    # what the edits allowed to this pair leave in common at the least; without such a rest only equal lines would do
    longest = F.greatest(F.length("g_line"), F.length("p_line"))
    allowed = F.floor(longest * NEAR + 1e-9)
    alike = F.size(F.array_intersect("g_grams", "p_grams")) >= F.greatest(F.size("g_grams"), F.size("p_grams")) - GRAM * allowed
    priced = priced.where((longest - F.least(F.length("g_line"), F.length("p_line")) <= allowed) & alike)
    end = lambda s, o, cost: F.struct(F.lit(s).alias("side"), F.col(f"{s}_line").alias("line"), F.col(f"{o}_line").alias("other"), F.col(f"{s}_open").alias("open"), F.col(f"{s}_sure").alias("sure"), cost.alias("cost"))
    # behind the explode, where no filter can ask for the distance a second time
    ends = let(_edits(F.col("g_line"), F.col("p_line"), allowed) / longest, lambda cost: F.array(end("g", "p", cost), end("p", "g", cost)))
    near = priced.select("page", F.explode(ends).alias("e")).where("e.open and e.cost is not null").withColumn("cost", F.col("e.cost"))
    near = near.groupBy("page", "e.side", "e.line", "e.sure").agg(F.min(F.struct("cost", F.col("e.other").alias("other"))).alias("b"))
    near = _written(near, "near")
    left = known.where("open").select("page", "side", "line").join(near, ["page", "side", "line"], "left").where("sure is null or not sure")
    # a line starts from what it has found; a cost of 2 is none
    left = left.select("page", "side", "line", F.coalesce("b", F.struct(F.lit(2.0).alias("cost"), F.lit(None).cast("string").alias("other"))).alias("b"))
    size = known.groupBy("page", "side").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    held = known.join(size, ["page", "side"]).groupBy("page", F.when(F.col("side") == "g", "p").otherwise("g").alias("side"), F.pmod(F.hash("line"), F.col("blocks").cast("int")).alias("block"))
    held = held.agg(F.collect_list("line").alias("others"))
    # lines of about the same length come first, so the bound falls soon
    order = F.array_sort(F.transform("others", lambda o: F.struct(F.abs(F.length(o) - F.length("line")).alias("gap"), o.alias("o"))))
    least = F.aggregate(order, F.col("b"), lambda known, s: _cheaper(F.col("line"), known, s["o"]))
    far = left.join(held, ["page", "side"]).select("page", "side", "line", least.alias("b")).groupBy("page", "side", "line").agg(F.min("b").alias("b"))
    near = near.where("sure").select("page", "side", "line", "b")
    equal = known.where("not open").select("page", "side", "line", F.lit(0.0).alias("cost"), F.col("line").alias("other"))
    return near.unionByName(far).select("page", "side", "line", "b.cost", "b.other").unionByName(equal)


def _placed(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """For each gold line of a page the place of its predicted line, -1 for none, and the cost; the n-th copy of a line gets the n-th of its partner."""
    def page(gold: list, pred: list) -> list[dict]:
        places: dict[str, list[int]] = {}
        for j, line in enumerate(pred):
            if line is not None:
                places.setdefault(line, []).append(j)
        mutual = mutual_partners(list(dict.fromkeys(x for x in gold if x is not None)), list(places))
        copies: Counter = Counter()
        out = []
        for line in gold:
            partner, cost = mutual.get(line, (None, 1.0))
            held = places.get(partner, ())
            out.append({"at": held[copies[line]], "edit": cost} if copies[line] < len(held) else {"at": -1, "edit": 1.0})
            copies[line] += 1
        return out

    return pa.array([page(g.as_py(), p.as_py()) for g, p in zip(gold, pred)], pa.list_(pa.struct([("at", pa.int32()), ("edit", pa.float64())])))


PLACES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("edit", T.DoubleType())]))


def greedy_line_match(gold: DataFrame, pred: DataFrame, page: str) -> DataFrame:
    """Gold lines (page, pos, line) with the predicted line that is mutually the cheapest by edit share; others cost 1.

    Equal lines of a page are compared once and their copies paired in order. The lines of a page meet in one row and are paired there, so a line is
    shuffled once; pages of more than PAGE_PAIRS pairs or PAGE_CHARS characters are paired by joins, their lines over many tasks.
    """
    line = lambda df, of_pred: df.select(F.col(page).alias("page"), F.lit(of_pred).alias("pred"), *[(F.col("pos") if of_pred == p else F.lit(None).cast(dict(d.dtypes)["pos"])).alias(n)
                                         for p, d, n in ((False, gold, "gold_pos"), (True, pred, "pred_pos"))], "line")
    both = line(gold, False).unionByName(line(pred, True)).where("page is not null")
    lines = lambda of_pred: F.count_if(F.col("pred") == of_pred).cast("double")
    sizes = both.groupBy("page").agg((lines(False) * lines(True)).alias("pairs"), F.sum(F.length("line")).alias("chars"))
    large = sizes.where((F.col("pairs") > PAGE_PAIRS) | (F.col("chars") > PAGE_CHARS)).select("page")
    # a page of neither size is not named, so the names are few
    joined = [] if large.isEmpty() else [_match_by_joins(*[df.join(large.withColumnRenamed("page", page), page, "left_semi") for df in (gold, pred)], page)]
    rest = both.join(large, "page", "left_anti") if joined else both
    packed = rest.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pred", "gold_pos", "pred_pos", "line"))).alias("m"))
    packed = packed.select("page", F.filter("m", lambda x: ~x["pred"]).alias("g"), F.filter("m", lambda x: x["pred"]).alias("p")).where("size(g) > 0")
    text = lambda side: F.transform(side, lambda x: x["line"])
    met = packed.withColumn("placed", F.arrow_udf(_placed, PLACES)(text("g"), text("p")))
    flat = met.select("page", "p", F.inline(F.arrays_zip("g", "placed")))
    partner = F.get("p", F.col("placed.at"))
    out = flat.select(F.col("page").alias(page), F.col("g.gold_pos").alias("pos"), F.col("g.line").alias("gold_line"), partner["line"].alias("pred_line"), partner["pred_pos"].alias("pred_pos"), F.col("placed.edit").alias("edit"))
    alone = gold.where(F.col(page).isNull()).select(page, "pos", F.col("line").alias("gold_line"), *[F.lit(None).cast(kind).alias(n) for n, kind in out.dtypes[3:5]], F.lit(1.0).alias("edit"))
    for more in [alone, *joined]:
        out = out.unionByName(more)
    return out


def _match_by_joins(gold: DataFrame, pred: DataFrame, page: str) -> DataFrame:
    """``greedy_line_match`` with the partners of ``best_partners``."""
    best = best_partners(gold, pred, page).withColumnRenamed("page", page)
    pick = lambda side: F.when(F.col("side") == side, F.col("line")).otherwise(F.col("other"))
    # a pair chosen from both of its ends is mutual
    mutual = best.select(page, pick("g").alias("gold_line"), pick("p").alias("pred_line"), "cost").groupBy(page, "gold_line", "pred_line").agg(
        F.min("cost").alias("cost"), F.count(F.lit(1)).alias("_n")).filter("_n = 2").drop("_n")
    copy = lambda df, line: df.withColumn("_copy", F.row_number().over(Window.partitionBy(page, line).orderBy("pos")))
    g = copy(gold.withColumnRenamed("line", "gold_line"), "gold_line").join(mutual, [page, "gold_line"], "left")
    p = copy(pred.select(page, "pos", F.col("line").alias("pred_line")), "pred_line").select(page, "pred_line", "_copy", F.col("pos").alias("pred_pos"))
    out = g.join(p, [page, "pred_line", "_copy"], "left")
    found = F.col("pred_pos").isNotNull()
    return out.select(page, "pos", "gold_line", F.when(found, F.col("pred_line")).alias("pred_line"), "pred_pos", F.when(found, F.col("cost")).otherwise(1.0).alias("edit"))
