"""Grouped reports over scored tables. Most return long rows (dim, value, metrics); ``widen`` pivots them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.text import literal_map


def grouping_report(df: DataFrame, sets: Mapping[str, Sequence[str]], aggs: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """One pass over several groupings: ``sets`` maps a dimension name to its columns ([] = all rows).

    Output: by columns, dim, value (the group columns joined by "/", "all" for the empty set) and the aggregates.
    """
    by = list(by)
    columns = list(dict.fromkeys([*by, *[c for s in sets.values() for c in s]]))
    if not columns:
        return df.agg(*aggs).select(F.lit(next(iter(sets))).alias("dim"), F.lit("all").alias("value"), "*")
    grouped = df.groupingSets([[F.col(c) for c in [*by, *s]] for s in sets.values()], *columns).agg(*aggs, F.grouping_id(*columns).alias("_gid"))
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, keys in sets.items():
        gid = int("".join("0" if c in by or c in keys else "1" for c in columns), 2)
        dim = F.when(F.col("_gid") == gid, name).otherwise(dim)
        value = F.when(F.col("_gid") == gid, F.concat_ws("/", *keys) if keys else F.lit("all")).otherwise(value)
    metrics = [c for c in grouped.columns if c not in columns and c != "_gid"]
    return grouped.select(*by, dim.alias("dim"), value.alias("value"), *metrics)


def widen(report: DataFrame, rows: Sequence[str], names: str, values: str, wanted: Sequence[str]) -> DataFrame:
    """Long report to one row per ``rows`` with a column per wanted name."""
    return report.groupBy(*rows).pivot(names, list(wanted)).agg(F.first(values))


def mean(column: str, alias: str | None = None, scale: float = 1.0) -> Column:
    return (F.avg(column) * scale).alias(alias or column)


def rows(alias: str = "n") -> Column:
    return F.count(F.lit(1)).alias(alias)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def split_or_none(df: DataFrame) -> DataFrame:
    return df if "split" in df.columns else df.withColumn("split", F.lit("none"))


def accuracy_report(df: DataFrame, hit: str = "hit", names: Mapping[str, str] | None = None) -> DataFrame:
    """Mean hit per split: overall, by l2_category and by category, where those columns exist; names may be abbreviated."""
    sets = {"overall": []} | {c: [c] for c in ("l2_category", "category") if c in df.columns}
    out = grouping_report(split_or_none(df), sets, [mean(hit, "acc"), rows()], by=["split"])
    if names:
        out = out.withColumn("value", F.coalesce(F.try_element_at(literal_map(names), F.col("value")), F.col("value")))
    return out


def two_level_report(df: DataFrame, hit: str = "hit") -> DataFrame:
    """Category means; l2_category = unweighted mean of its category means; the extra split ALL holds every row."""
    df = split_or_none(df)
    sets = [["category", "l2_category"], ["split", "category", "l2_category"], [], ["split"]]
    both = df.groupingSets([[F.col(c) for c in s] for s in sets], "split", "category", "l2_category").agg(
        mean(hit, "acc"), rows(), F.grouping("split").alias("_every"), F.grouping("category").alias("_total"))
    flat = both.withColumn("split", F.when(F.col("_every") == 1, "ALL").otherwise(F.col("split")))
    overall = flat.filter("_total = 1").select("split", F.lit("overall").alias("dim"), F.lit("all").alias("value"), "acc")
    cells = flat.filter("_total = 0").select("split", "category", "l2_category", "acc", "n")
    per_category = cells.groupBy("split", "category").agg((F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("acc"))
    categories = per_category.select("split", F.lit("category").alias("dim"), F.col("category").alias("value"), "acc")
    other = per_category.select(F.col("split").alias("_s"), F.col("category").alias("_c"), F.col("acc"))
    members = cells.select("split", "category", "l2_category").join(other, F.col("split").eqNullSafe(F.col("_s")) & F.col("category").eqNullSafe(F.col("_c")))
    level2 = members.groupBy("split", "l2_category").agg(F.avg("acc").alias("acc")).select(
        "split", F.lit("l2_category").alias("dim"), F.col("l2_category").alias("value"), "acc")
    return overall.unionByName(categories).unionByName(level2)


def pivot_report(df: DataFrame, settings: Sequence[str], hit: str = "hit") -> DataFrame:
    """Mean by (subject, setting), (category, setting) and setting; missing cells 0; Avg = row mean."""
    kept = df.filter(F.col("setting").isin(*settings))
    long = grouping_report(kept, {"subject": ["subject"], "category": ["category"], "overall": []}, [F.avg(hit).alias("acc")], by=["setting"])
    subject = F.when(F.col("dim") == "category", F.concat(F.lit("CATEGORY_"), F.col("value"))).when(F.col("dim") == "overall", "Overall").otherwise(F.col("value"))
    wide = widen(long.withColumn("subject", subject), ["subject"], "setting", "acc", settings).fillna(0.0, list(settings))
    return wide.withColumn("Avg", sum((F.col(s) for s in settings), F.lit(0.0)) / len(settings))


def task_tree_report(df: DataFrame) -> DataFrame:
    """``category`` = task/subtask; right and wrong shares of scores >= 0 at every level of the tree."""
    low = F.lower("l2_category")
    leaf = F.when(low.contains("attribute"), F.concat(F.split_part(low, F.lit("/"), F.lit(1)), F.lit("/attribute"))).otherwise(low)
    flat = df.filter(F.col("score") >= 0).select(F.split_part("category", F.lit("/"), F.lit(1)).alias("task"),
                                                 F.split_part("category", F.lit("/"), F.lit(2)).alias("subtask"), leaf.alias("leaf"), "score")
    return flat.rollup("task", "subtask", "leaf").agg(F.sum("score").cast("double").alias("right"), rows("total"), F.avg("score").alias("acc"))


VQA_HIT = {
    "mean": lambda m: F.aggregate(m, F.lit(0.0), lambda a, x: a + x) / F.size(m),
    "max": lambda m: F.array_max(m),
    "anls": lambda m: F.when(1 - F.array_min(m) < 0.5, 0.0).otherwise(1 - F.array_min(m)),
}


def vqa_report(df: DataFrame, match: str, metric: str) -> DataFrame:
    """Hit of each row by the benchmark's metric, mean x 100 by split, or overall and by category."""
    hits = df.withColumn("hit", VQA_HIT[metric](F.col(match)))
    sets = {"split": ["split"]} if "split" in df.columns else {"overall": []}
    if "category" in df.columns:
        sets["category"] = ["category"]
    return grouping_report(hits, sets, [mean("hit", "score", 100.0), rows()])


def default_rating(df: DataFrame, score: str = "score") -> DataFrame:
    sets = {"overall": []} | {c: [c] for c in ("category", "l2_category") if c in df.columns}
    out = grouping_report(df, sets, [mean(score, "rating", 100.0), rows()])
    return out.filter((F.col("dim") == "overall") | (F.col("value") != ""))


def _binary(df: DataFrame, truth: Column, guess: Column, keys: Sequence[str]) -> DataFrame:
    count = lambda c: F.count_if(c).cast("double")
    agg = [count(truth & guess).alias("tp"), count(~truth & guess).alias("fp"), count(truth & ~guess).alias("fn"), count(~truth & ~guess).alias("tn")]
    return df.groupBy(*keys).agg(*agg)


def binary_rates(counts: DataFrame, scale: float = 1.0) -> DataFrame:
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (counts.withColumn("precision", precision * scale).withColumn("recall", recall * scale)
            .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def binary_f1_report(df: DataFrame) -> DataFrame:
    """Rows count once in each of their comma-separated categories; accuracy, precision, recall and F1 x 100, also overall."""
    flat = df.withColumn("category", F.explode(F.split("category", ",")))
    truth, guess = F.col("answer") == "Yes", F.col("extracted") == "Yes"
    count = lambda c: F.count_if(c).cast("double")
    long = grouping_report(flat, {"overall": [], "category": ["category"]}, [
        count(truth & guess).alias("tp"), count(~truth & guess).alias("fp"), count(truth & ~guess).alias("fn"), mean("score", "acc", 100.0)])
    return binary_rates(long, 100.0).select("dim", "value", "acc", "precision", "recall", "f1")


def category_remap_rating(df: DataFrame, remap: Mapping[str, str]) -> DataFrame:
    """Mean x 100 of the mapped categories and their unweighted mean."""
    named = df.withColumn("category", F.coalesce(F.try_element_at(literal_map(remap), F.col("category")), F.col("category")))
    per = named.groupBy("category").agg(mean("score", "rating", 100.0))
    return per.unionByName(per.agg(F.avg("rating").alias("rating")).select(F.lit("Avg ACC").alias("category"), "rating"))


def sum_of_categories(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per category: accuracy plus accuracy of the products of both scores of an image (x 100); sums over named groups."""
    image = df.groupBy("category", "image").agg(F.product("score").alias("pair"), F.sum("score").alias("s"), rows())
    per = image.groupBy("category").agg(((F.sum("s") / F.sum("n") + F.avg(F.when(F.col("n") == 2, F.col("pair")))) * 100).alias("score"))
    member = F.try_element_at(literal_map({c: g for g, cs in groups.items() for c in cs}), F.col("category"))
    supers = per.withColumn("g", member).filter(F.col("g").isNotNull()).groupBy("g").agg(F.sum("score").alias("score"))
    return supers.select(F.col("g").alias("category"), "score").unionByName(per)


def confusion_report(df: DataFrame, baseline: str = "original", by: Sequence[str] = ()) -> DataFrame:
    """Each kind joined with the shared baseline rows: rates and confusion counts, plus a macro row.

    The prediction is rebuilt from the answer and the score. The baseline is added as four counts, not as copied rows.
    """
    by = list(by)
    truth = F.col("answer") == "Yes"
    guess = F.when(F.col("score") == 1, truth).otherwise(~truth)
    counts = _binary(df, truth, guess, [*by, "kind"])
    names = ["tp", "fp", "fn", "tn"]
    base = counts.filter(F.col("kind") == baseline).select(*by, *[F.col(n).alias(f"base_{n}") for n in names])
    kinds = counts.filter(F.col("kind") != baseline)
    if by:
        joined = kinds.join(base, by)
    else:
        totals = base.agg(*[F.coalesce(F.sum(f"base_{n}"), F.lit(0.0)).alias(f"base_{n}") for n in names])
        joined = kinds.select("*", *[totals.select(f"base_{n}").scalar().alias(f"base_{n}") for n in names])
    full = joined.select(*by, "kind", *[(F.col(n) + F.col(f"base_{n}")).alias(n) for n in names])
    rates = binary_rates(full.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))))
    wanted = ["accuracy", "precision", "recall", "f1"]
    macro = rates.groupBy(*by).agg(*[F.avg(m).alias(m) for m in wanted]).select(
        *by, F.lit("overall").alias("kind"), *[F.lit(None).cast("double").alias(n) for n in names], *wanted)
    return rates.select(*by, "kind", *names, *wanted).unionByName(macro)


def hit_rate_report(df: DataFrame, category: str = "category") -> DataFrame:
    """Totals, prefetched and hit counts with their rates, by category and Overall."""
    long = grouping_report(df, {"overall": [], "category": [category]}, [
        rows("tot"), F.count_if(F.col("prefetched")).alias("prefetch"), F.count_if(F.col("hit") == 1).alias("hit")])
    return long.select(F.when(F.col("dim") == "overall", "Overall").otherwise(F.col("value")).alias("subject"), "tot", "prefetch", "hit",
                       (F.col("prefetch") / F.col("tot") * 100).alias("prefetch_rate"), (F.col("hit") / F.col("tot") * 100).alias("acc"))


def multi_label_report(df: DataFrame, labels: str, score: str = "score") -> DataFrame:
    """A row counts once in each distinct label it names."""
    return df.withColumn("label", F.explode(F.array_distinct(labels))).groupBy("label").agg(F.avg(score).alias("mean_score"), rows())


def positive_f1(df: DataFrame, gold: str, pred: str, score: str = "score", negative: str = "Not answerable") -> DataFrame:
    """Recall over answerable gold rows, precision over answered rows, and their F1."""
    out = df.agg(F.avg(F.when(F.col(gold) != negative, F.col(score))).alias("recall"), F.avg(F.when(F.col(pred) != negative, F.col(score))).alias("precision"))
    return out.withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def all_vs_valid(df: DataFrame, dims: str, coarse: Mapping[str, Sequence[str]], score: str = "score") -> DataFrame:
    """Mean with failures as 0 and mean of the valid rows, by fine dimension and by coarse group of dimensions."""
    aggs = [F.avg(F.greatest(score, F.lit(0.0))).alias("mean_all"), F.avg(F.when(F.col(score) >= 0, F.col(score))).alias("mean_valid")]
    fine = df.withColumn("value", F.explode(dims)).groupBy("value").agg(*aggs).select(F.lit("fine").alias("dim"), "value", "mean_all", "mean_valid")
    groups = F.array(*[F.when(F.arrays_overlap(dims, F.array(*[F.lit(x) for x in members])), name) for name, members in coarse.items()])
    flat = df.withColumn("value", F.explode(F.filter(groups, lambda g: g.isNotNull())))
    return fine.unionByName(flat.groupBy("value").agg(*aggs).select(F.lit("coarse").alias("dim"), "value", "mean_all", "mean_valid"))


def duration_cube(df: DataFrame, duration: str, dims: Sequence[str], labels: str | None = None, score: str = "score") -> DataFrame:
    """Mean of the scores >= 0 by duration group (and over all) x each dimension; ``labels`` is an array dimension."""
    kept = df.filter(F.col(score) >= 0)
    sets = {"duration:overall": [duration], "all:overall": []}
    sets |= {f"duration:{d}": [duration, d] for d in dims} | {f"all:{d}": [d] for d in dims}
    out = grouping_report(kept, sets, [F.avg(score).alias("mean_score"), rows()])
    if labels:
        flat = kept.withColumn("_label", F.explode(labels))
        extra = grouping_report(flat, {f"duration:{labels}": [duration, "_label"], f"all:{labels}": ["_label"]}, [F.avg(score).alias("mean_score"), rows()])
        out = out.unionByName(extra)
    return out


# Right-closed duration bins in minutes.
DURATION_BINS = ["0-10", "10-20", "20-30", "30-40", "40-50", "50-60", "60+"]


def duration_bin(seconds: Column) -> Column:
    minutes = seconds / 60
    label = F.lit(DURATION_BINS[-1])
    for i in reversed(range(6)):
        label = F.when(minutes <= (i + 1) * 10, DURATION_BINS[i]).otherwise(label)
    return label


def bucketed_report(df: DataFrame, dims: Sequence[str], score: str = "score", seconds: str = "duration") -> DataFrame:
    """Means rounded to four places, overall, by duration bin (0 for empty bins) and by each dimension."""
    kept = df.filter(F.col(score) != -1).withColumn("_bin", duration_bin(F.col(seconds)))
    sets = {"overall": [], "duration": ["_bin"]} | {d: [d] for d in dims}
    found = grouping_report(kept, sets, [F.round(F.avg(score), 4).alias("mean_score")])
    bins = df.sparkSession.createDataFrame([("duration", b) for b in DURATION_BINS], "dim string, value string")
    empty = bins.join(found.filter(F.col("dim") == "duration"), ["dim", "value"], "left_anti").withColumn("mean_score", F.lit(0.0))
    return found.unionByName(empty)


def grounding_report(df: DataFrame, dims: Sequence[str], thresholds: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """Mode means, clue recovery rate, accuracy at overlap and recall at overlap, overall and by dimension.

    Rows: (qid, task_mode long_acc / clue_acc / miou, score, dims). One pass brings the modes of a question together,
    a second one groups the questions.
    """
    kept = df.filter(F.col("score") != -1)
    mode = lambda m: F.col("task_mode") == m
    score_of = lambda m: F.max(F.when(mode(m), F.col("score")))
    question = kept.groupBy("qid", *dims).agg(
        *[score_of(m).alias(m) for m in ("long_acc", "clue_acc", "miou")])
    above = lambda t: F.col("miou") > t
    aggs = [F.avg(m).alias(m) for m in ("long_acc", "clue_acc", "miou")]
    aggs += [F.count("miou").alias("_miou"), F.count_if(F.col("miou").isNotNull() & F.col("long_acc").isNotNull()).alias("_both")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(above(t)).alias(f"_rec{i}"), F.count_if(above(t) & (F.col("long_acc") == 1)).alias(f"_acc{i}")]
    out = grouping_report(question, {"overall": []} | {d: [d] for d in dims}, aggs)
    share = lambda name, total: F.round(sum((F.round(ratio(F.col(f"{name}{i}"), F.col(total)), 4) for i in range(len(thresholds))), F.lit(0.0)) / len(thresholds), 4)
    crr = F.round(ratio(F.least("long_acc", "clue_acc"), F.col("clue_acc")), 4)
    return out.select("dim", "value", *[F.round(m, 4).alias(m) for m in ("long_acc", "clue_acc", "miou")], crr.alias("crr"),
                      share("_acc", "_both").alias("acc_at_iou"), share("_rec", "_miou").alias("rec_at_iou"))


def type_rating(df: DataFrame, kind: Column) -> DataFrame:
    """Right, total and accuracy per type and overall."""
    long = grouping_report(df.withColumn("_kind", kind), {"overall": [], "type": ["_kind"]}, [F.sum("score").cast("bigint").alias("correct"), rows("total")])
    return long.select(F.when(F.col("dim") == "overall", "overall").otherwise(F.col("value")).alias("type"), "correct", "total", (F.col("correct") / F.col("total")).alias("acc"))


def success_total_rollup(df: DataFrame) -> DataFrame:
    """(dim, task_type, success, overall) rows kept and summed by dimension, by task and over all; acc in % to two places."""
    cube = df.cube("dim", "task_type").agg(F.sum("success").alias("success"), F.sum("overall").alias("total"), F.grouping_id().alias("_gid"))
    level = F.element_at(F.array(F.lit("row"), F.lit("dim"), F.lit("task"), F.lit("overall")), (F.col("_gid") + 1).cast("int"))
    long = cube.withColumn("level", level)
    key = F.when(F.col("level") == "row", F.concat_ws(". ", "dim", "task_type")).when(F.col("level") == "overall", "overall").otherwise(F.coalesce("dim", "task_type"))
    return long.select("level", key.alias("key"), "success", "total", F.round(F.col("success") / F.col("total") * 100, 2).alias("acc"))


def macro_over_sources(df: DataFrame, hit: str = "hit", source: str = "source") -> DataFrame:
    """Accuracy of each source per split; Overall = mean over the sources."""
    per = split_or_none(df).groupBy("split", source).agg(F.avg(hit).alias("acc"))
    return per.select("split", F.col(source).alias("source"), "acc").unionByName(per.groupBy("split").agg(F.avg("acc").alias("acc")).select("split", F.lit("Overall").alias("source"), "acc"))


def macro_and_micro(df: DataFrame, task: Column, hit: Column) -> DataFrame:
    """Task accuracies, their macro mean and the micro ratio."""
    per = df.groupBy(task.alias("task")).agg(F.sum(hit.cast("double")).alias("right"), rows("total"))
    tasks = per.select("task", (F.col("right") / F.col("total")).alias("acc"))
    both = per.agg(F.avg(F.col("right") / F.col("total")).alias("macro"), (F.sum("right") / F.sum("total")).alias("micro"))
    return tasks.unionByName(both.select(F.lit("Overall macro").alias("task"), F.col("macro").alias("acc"))).unionByName(
        both.select(F.lit("Overall micro").alias("task"), F.col("micro").alias("acc")))


def grouped_super_means(df: DataFrame, groups: Mapping[str, Sequence[str]], hit: str = "hit") -> DataFrame:
    """Dataset means, the overall mean and unweighted means of named dataset groups, in % to two places."""
    long = grouping_report(df, {"overall": [], "dataset": ["category"]}, [F.avg(hit).alias("acc")])
    member = F.try_element_at(literal_map({c: g for g, cs in groups.items() for c in cs}), F.col("value"))
    supers = long.filter(F.col("dim") == "dataset").withColumn("g", member).filter(F.col("g").isNotNull()).groupBy("g").agg(F.avg("acc").alias("acc"))
    out = long.select("dim", "value", "acc").unionByName(supers.select(F.lit("group").alias("dim"), F.col("g").alias("value"), "acc"))
    return out.withColumn("acc", F.round(F.col("acc") * 100, 2))


def cycle_report(df: DataFrame, hit: str = "hit") -> DataFrame:
    """Accuracy by type (and all) within each cycle; Average = sum over the cycles / number of cycles."""
    per = grouping_report(df, {"all": [], "category": ["category"]}, [F.avg(hit).alias("accuracy")], by=["cycle"]).select("cycle", F.col("value").alias("type"), "accuracy")
    cycles = df.agg(F.count_distinct("cycle")).scalar()
    return per.unionByName(per.groupBy("type").agg(F.sum("accuracy").alias("s")).select(F.lit("Average").alias("cycle"), "type", (F.col("s") / cycles).alias("accuracy")))


def score_sum_report(df: DataFrame, groups: Mapping[str, Sequence[str]], hit: str = "hit") -> DataFrame:
    """Correct counts of named category groups, their sum and a tenth of it."""
    member = F.try_element_at(literal_map({c: g for g, cs in groups.items() for c in cs}), F.col("category"))
    long = grouping_report(df.withColumn("g", member).filter(F.col("g").isNotNull()), {"group": ["g"], "final": []}, [F.sum(hit).cast("double").alias("score")])
    final = long.filter(F.col("dim") == "final")
    return (long.select(F.when(F.col("dim") == "final", "Final Score").otherwise(F.col("value")).alias("name"), "score")
            .unionByName(final.select(F.lit("Final Score Norm").alias("name"), (F.col("score") / 10).alias("score"))))


def relative_score(df: DataFrame, score: str, reference: str) -> DataFrame:
    out = grouping_report(df, {"overall": [], "category": ["category"]}, [F.avg(score).alias("_m"), F.avg(reference).alias("_r")])
    return out.select("dim", "value", (F.col("_m") / F.col("_r") * 100).alias("relative"), (F.col("_m") * 10).alias("model_score"), (F.col("_r") * 10).alias("reference_score"))


def verdict_aggs(verdict: str) -> list[Column]:
    names = {2: "much_better", 1: "better", 0: "tie", -1: "worse", -2: "much_worse"}
    return [F.count_if(F.col(verdict) == v).alias(n) for v, n in names.items()]


def _reward() -> Column:
    return 100 * F.col("much_better") + 50 * F.col("better") - 50 * F.col("worse") - 100 * F.col("much_worse")


def win_rate_reward(df: DataFrame, verdict: str = "verdict", reverse: str = "reverse") -> DataFrame:
    """Counts of the five verdicts, reward and win rate, overall and per type; reversed rows change sign, null counts as a tie."""
    signed = df.withColumn("_v", F.coalesce(F.col(verdict) * F.when(F.col(reverse), -1).otherwise(1), F.lit(0)))
    long = grouping_report(signed, {"overall": [], "type": ["type"]}, [*verdict_aggs("_v"), rows()])
    return long.withColumn("reward", _reward() / F.col("n")).withColumn("win_rate", (F.col("better") + F.col("much_better")) / F.col("n"))


def dual_judgement_merge(forward: DataFrame, swapped: DataFrame, main_category: Mapping[str, str]) -> DataFrame:
    """Forward and swapped comparisons together: verdict negated and scores exchanged in the swapped ones.

    Rows: (task, verdict or null, score, ref_score or null, objective flag); reported per task, main category and overall.
    """
    flipped = swapped.select("task", (-F.col("verdict")).alias("verdict"), F.col("ref_score").alias("score"), F.col("score").alias("ref_score"), "objective")
    both = forward.select(*flipped.columns).unionByName(flipped)
    both = both.withColumn("main", F.try_element_at(literal_map(main_category), F.col("task")))
    long = grouping_report(both, {"task": ["task"], "main": ["main"], "overall": []}, [
        *verdict_aggs("verdict"), rows(), F.count("verdict").alias("valid"),
        F.count_if(F.col("objective")).alias("obj"), F.count_if(F.col("objective") & F.col("score").isNotNull()).alias("obj_valid"),
        F.avg(F.when(F.col("objective"), F.col("score"))).alias("obj_score"), F.avg(F.when(F.col("objective"), F.col("ref_score"))).alias("obj_ref_score")])
    return long.select("dim", "value", (F.col("valid") / F.col("n")).alias("parse_ok"),
                       *[ratio(F.col(c), F.col("valid")).alias(f"share_{c}") for c in ("much_better", "better", "tie", "worse", "much_worse")],
                       (ratio(F.col("better") + F.col("much_better"), F.col("valid")) * 100).alias("win_rate"), ratio(_reward(), F.col("valid")).alias("reward"),
                       F.when(F.col("obj") > 0, F.col("obj_valid") / F.col("obj")).alias("obj_parse_ok"), "obj_score", "obj_ref_score")


def mean_relative_accuracy(df: DataFrame) -> DataFrame:
    """Yes/no, choice and count accuracies and the mean over ten thresholds of the share within them.

    Rows: (kind int / str / float, gold, pred); unreadable numbers count as wrong.
    """
    gold, pred = F.lower("gold"), F.lower("pred")
    yes_no = (F.col("kind") == "str") & F.col("gold").isin("yes", "no")
    said = pred.contains(gold) | ((gold == "yes") & pred.contains("true")) | ((gold == "no") & pred.contains("false"))
    g, p = F.col("gold").try_cast("double"), F.col("pred").try_cast("double")
    off = F.abs(g - p) / F.nullif(g, F.lit(0.0))
    limits = F.array(*[F.lit(round(0.05 * i, 2)) for i in range(1, 11)])
    inside = F.size(F.filter(limits, lambda t: F.coalesce(off < t, F.lit(False)))) / 10.0
    flag = lambda cond, hit: F.avg(F.when(cond, F.coalesce(hit, F.lit(False)).cast("double")))
    return df.agg(flag(yes_no, said).alias("yes_no_accuracy"),
                  flag((F.col("kind") == "str") & ~F.col("gold").isin("yes", "no"), F.col("gold") == pred).alias("choice_accuracy"),
                  flag(F.col("kind") == "int", F.col("gold").try_cast("int") == F.col("pred").try_cast("int")).alias("count_accuracy"),
                  F.avg(F.when(F.col("kind") == "float", inside)).alias("mean_relative_accuracy"))


def level_report(df: DataFrame) -> DataFrame:
    """Right and total per level, format errors, and the overall accuracy weighted by level size."""
    long = grouping_report(df, {"overall": [], "level": ["level"]}, [F.sum("score").cast("double").alias("correct"), rows("total"), F.count_if(F.col("format_error")).alias("format_errors")])
    return long.withColumn("acc", F.col("correct") / F.col("total"))


def field_weighted_score(df: DataFrame, how: str = "mean") -> DataFrame:
    """Rows (task, query, field, score, weight): query score from its valid fields (weighted mean or minimum), task mean over
    all its queries, macro over tasks and micro over queries; queries without valid field score -1 and add nothing."""
    valid = F.col("score") >= 0
    w = F.when(valid, F.col("weight"))
    value = F.sum(w * F.col("score")) / F.nullif(F.sum(w), F.lit(0.0)) if how == "mean" else F.min(F.when(valid, F.col("score")))
    per_query = df.groupBy("task", "query").agg(F.coalesce(value, F.lit(-1.0)).alias("q"))
    per_task = per_query.groupBy("task").agg(F.sum(F.greatest("q", F.lit(0.0))).alias("s"), rows())
    tasks = per_task.select("task", (F.col("s") / F.col("n")).alias("mean_score"), F.col("n").alias("queries"))
    total = per_task.agg(F.avg(F.col("s") / F.col("n")).alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"), F.sum("n").alias("queries"))
    return tasks.unionByName(total.select(F.lit("macro").alias("task"), F.col("macro").alias("mean_score"), "queries")).unionByName(
        total.select(F.lit("micro").alias("task"), F.col("micro").alias("mean_score"), "queries"))


def attribute_breakdown(df: DataFrame, attributes: Sequence[str], hit: str = "hit") -> DataFrame:
    """Mean hit by every value of several attributes and overall."""
    return grouping_report(df, {"overall": []} | {a: [a] for a in attributes}, [F.avg(hit).alias("acc"), rows()])


def nan_safe_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column means x 100 without the -1 rows (0 for an empty column), and the mean of the column means."""
    out = df.agg(*[F.coalesce(F.avg(F.when(F.col(c) != -1, F.col(c))), F.lit(0.0)).alias(c) for c in columns])
    overall = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    return out.select((overall * 100).alias("overall"), *[(F.col(c) * 100).alias(c) for c in columns])


def case_report(df: DataFrame) -> DataFrame:
    """Totals and right answers by question form and category, by category and overall."""
    long = grouping_report(df, {"overall": [], "category": ["category"], "form": ["form"], "form_category": ["form", "category"]},
                           [rows("total"), F.sum("hit").cast("double").alias("correct")])
    return long.withColumn("acc", F.col("correct") / F.col("total"))


def single_accuracy(df: DataFrame, match: Column) -> DataFrame:
    return df.agg(F.avg(F.coalesce(match, F.lit(False)).cast("double")).alias("accuracy"), rows())


def count_histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(rows("count"))


def mode_of_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most common value of each group; equal counts go to the smallest value."""
    counts = df.groupBy(group, value).agg(rows())
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("_b")).select(group, F.col("_b.v").alias("mode_value"), (-F.col("_b.n")).alias("n"))


def radar_normalise(df: DataFrame, columns: Sequence[str], log: bool = False) -> DataFrame:
    """Columns rescaled to 0-100 over one shared range (the widest column range plus a margin), centred per column."""
    prepared = df.withColumns({c: F.ln(c) for c in columns}) if log else df
    margin = 1.005 if log else 1.25
    ends = prepared.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    widest = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in columns]) if len(columns) > 1 else F.col(f"hi_{columns[0]}") - F.col(f"lo_{columns[0]}")
    span = ends.select((widest * margin).alias("span")).scalar()
    out = {}
    for c in columns:
        middle = ends.select(((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2).alias("m")).scalar()
        low = F.when(middle + span / 2 < 100, middle - span / 2).otherwise(100 - span)
        out[c] = (F.col(c) - low) / span * 100
    return prepared.withColumns(out)


def running_mean(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Running sum, count and average in order, per group."""
    from scorewright.operators.skew import ordered
    out = ordered(df, order, by, position="_p", sums={"running_sum": value})
    return out.withColumn("running_count", F.col("_p") + 1).withColumn("running_avg", F.col("running_sum") / F.col("running_count")).drop("_p")


def step_precision_recall(df: DataFrame, item: str = "item") -> DataFrame:
    """Judged steps (item, side precision / recall, step_type, judgment) to precision, recall and F1 per metric.

    Precision = matched / (matched + wrong), recall = matched / (matched + unmatched); items without steps and items
    scoring 0 are left out of the means, as the rule this follows does. ``efficiency``, for all types together, is the mean share of an item's
    precision steps that are not redundant.
    """
    n = lambda j: F.count_if(F.col("judgment") == j)
    per = grouping_report(df, {"type": ["step_type"], "overall": []}, [n("Matched").alias("m"), n("Wrong").alias("w"), n("Unmatched").alias("u"), n("Redundant").alias("r"), rows("s")], by=[item, "side"])
    missed = F.when(F.col("side") == "precision", F.col("w")).otherwise(F.col("u"))
    value_col = F.col("m") / F.nullif(F.col("m") + missed, F.lit(0))
    scored = per.select(F.when(F.col("dim") == "overall", "overall").otherwise(F.col("value")).alias("metric"), "side", F.nullif(value_col, F.lit(0.0)).alias("v"), (1 - F.col("r") / F.col("s")).alias("e"))
    precise = F.col("side") == "precision"
    means = scored.groupBy("metric").agg(
        F.coalesce(F.avg(F.when(precise, F.col("v"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.when(F.col("side") == "recall", F.col("v"))), F.lit(0.0)).alias("recall"),
        F.avg(F.when(precise & (F.col("metric") == "overall"), F.col("e"))).alias("efficiency"), F.count("v").alias("_n"))
    return means.filter("_n > 0").drop("_n").withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def staged_judgement(df: DataFrame) -> DataFrame:
    """Final score: step one decides 0 / 1, its 2 passes on to step two, missing results are -1; with the deciding stage."""
    one, two = F.col("step_1"), F.col("step_2")
    decided = one.isin(0, 1)
    score = F.when(decided, one).when(one == 2, F.coalesce(F.when(two.isin(0, 1), two), F.lit(-1))).otherwise(-1)
    stage = F.when(decided, "step_1").when((one == 2) & two.isin(0, 1), "step_2").otherwise("failed")
    return df.withColumn("score", score.cast("double")).withColumn("stage", stage)


def combined_label_report(df: DataFrame, parts: Sequence[str], hit: str = "hit") -> DataFrame:
    """Accuracy x 100 by source, by both label parts together, by the second part and overall."""
    first, second = parts
    return grouping_report(df, {"source": ["source"], "combined": [first, second], "part": [second], "overall": []}, [mean(hit, "acc", 100.0), rows()])


def companion_score(df: DataFrame, second: str) -> DataFrame:
    """Hit-rate report with a companion row per category holding the mean of a second score."""
    base = hit_rate_report(df)
    long = grouping_report(df, {"overall": [], "category": ["category"]}, [rows("tot"), F.sum(second).alias("s")])
    name = F.concat(F.when(F.col("dim") == "overall", "Overall").otherwise(F.col("value")), F.lit("_RP"))
    zero = F.lit(0).cast("bigint")
    extra = long.select(name.alias("subject"), "tot", zero.alias("prefetch"), zero.alias("hit"), F.lit(0.0).alias("prefetch_rate"), (F.col("s") / F.col("tot") * 100).alias("acc"))
    return base.unionByName(extra)
