"""Scores that look at groups of rows together: rotations, pairs, figures, steps and variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.extract import infer
from scorewright.operators.reports import grouping_report, rows

OFFSET = 1_000_000


def rotation_offset(top: Column) -> Column:
    """Distance between the indices of two rotations: 1e6, grown tenfold until it exceeds the largest main index."""
    return F.greatest(F.lit(OFFSET), F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(top, F.lit(1)))) + 1)).cast("bigint")


def circular_expand(df: DataFrame, letters: str, offset: Column | int | None = None) -> DataFrame:
    """k rotations of every k-option row: index + offset * i, options and answer moved to their new letters.

    Rows whose option texts hold option labels, or whose answer is no option, are emitted once.
    ``offset`` defaults to 1e6, grown tenfold until it exceeds the largest index.
    """
    if offset is None:
        top = df.agg(F.max("idx")).scalar()
        offset = rotation_offset(top)
    names = F.array(*[F.lit(c) for c in letters])
    texts = F.filter(F.array(*[F.col(c) for c in letters]), lambda x: x.isNotNull())
    base = df.withColumn("_t", texts).withColumn("_k", F.size("_t")).withColumn("_off", offset if isinstance(offset, Column) else F.lit(offset))
    used = F.slice(names, F.lit(1), F.greatest(F.col("_k"), F.lit(1)))
    tokens = lambda s: F.split(F.regexp_replace(s, "[^A-Za-z ]", " "), " +")
    labelled = F.exists("_t", lambda s: (F.size(F.array_intersect(tokens(s), used)) > 1) | F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ").contains(s))
    regular = ~labelled & (F.col("_k") >= 2) & F.array_contains(used, F.col("answer"))
    base = base.withColumn("_n", F.when(regular, F.col("_k")).otherwise(1))
    spun = base.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # rotation i moves the text of position p to position (p - i) mod k
    at = lambda p: F.get("_t", F.pmod(F.lit(p) + F.col("_i"), F.greatest(F.col("_k"), F.lit(1))))
    options = {c: F.when(F.lit(p) < F.col("_k"), at(p)) for p, c in enumerate(letters)}
    place = F.array_position(names, F.col("answer")) - 1
    answer = F.when(F.col("_i") == 0, F.col("answer")).otherwise(F.get(names, F.pmod(place - F.col("_i"), F.col("_k")).cast("int")))
    keep = [c for c in df.columns if c not in letters and c not in ("idx", "answer")]
    return spun.select((F.col("idx") + F.col("_off") * F.col("_i")).cast("bigint").alias("idx"), F.col("idx").cast("bigint").alias("g_index"),
                       answer.alias("answer"), *[v.alias(c) for c, v in options.items()], *keep)


def paired_product(df: DataFrame, image: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean x 100 of the product of both scores of an image; images without two rows are left out."""
    pairs = df.groupBy(*by, image).agg(F.product("score").alias("p"), rows()).filter(F.col("n") == 2)
    return pairs.groupBy(*by).agg((F.avg("p") * 100).alias("paired"), rows("images"))


def all_correct_by_key(df: DataFrame, keys: Mapping[str, Sequence[str]], by: Mapping[str, Sequence[str]]) -> DataFrame:
    """Row accuracy and, for every named key, the share of key groups that are right throughout (x 100).

    ``by`` names the report groupings ([] = overall). Groups form inside each grouping.
    """
    parts = []
    for dim, cols in by.items():
        value = F.concat_ws("/", *cols) if cols else F.lit("all")
        tagged = df.withColumn("_value", value)
        out = tagged.groupBy("_value").agg((F.avg("score") * 100).alias("row_acc"))
        for name, key in keys.items():
            good = tagged.groupBy("_value", *[F.col(k).alias(f"_g{i}") for i, k in enumerate(key)]).agg(F.min(F.col("score")).alias("ok"))
            share = good.groupBy("_value").agg((F.avg((F.col("ok") != 0).cast("double")) * 100).alias(name))
            out = out.join(share, "_value")
        parts.append(out.select(F.lit(dim).alias("dim"), F.col("_value").alias("value"), "row_acc", *keys))
    return reduce(DataFrame.unionByName, parts)


def vanilla_accuracy(predictions: DataFrame, answers: DataFrame, options: Column | None = None) -> DataFrame:
    """Predictions that have an answer, with the inferred choice and the hit (unresolved = 0)."""
    joined = predictions.join(answers.select("idx", F.col("answer").alias("gold")), "idx")
    choice = infer(F.col("prediction"), options) if options is not None else F.col("prediction")
    return joined.withColumn("choice", choice).withColumn("hit", F.coalesce((F.col("choice") == F.col("gold")).cast("int"), F.lit(0)))


def circular_accuracy(predictions: DataFrame, answers: DataFrame, options: Column | None = None, offset: Column | int | None = None) -> DataFrame:
    """A main row hits only when all its rotations do; unresolved rotations miss.

    Rotations of a question share ``g_index``, which ``circular_expand`` carries on the answers. Predictions and answers without it need the
    ``offset`` of the expansion; it is not to be told from the indices, as the largest of them may be a main or a rotated one.
    """
    scored = vanilla_accuracy(predictions, answers, options)
    if "g_index" not in scored.columns:
        if "g_index" in answers.columns:
            scored = scored.join(answers.select("idx", "g_index"), "idx")
        elif offset is None:
            raise ValueError("answers carry g_index, or the offset of the expansion is given")
        else:
            scored = scored.withColumn("g_index", F.col("idx") % (offset if isinstance(offset, Column) else F.lit(offset)))
    groups = scored.groupBy("g_index").agg(F.min("hit").alias("group_hit"), rows("rotations"))
    main = scored.filter(F.col("idx") == F.col("g_index")).drop("hit")
    return main.join(groups, "g_index").withColumnRenamed("group_hit", "hit")


def pair_accuracy(df: DataFrame, idx: str, hit: str) -> DataFrame:
    """Share x 100 of id groups (id without its last ``_part``) with two or more rows, all right; smaller groups are wrong."""
    keyed = df.filter(F.col(idx).contains("_")).withColumn("_key", F.regexp_replace(idx, "_[^_]*$", ""))
    groups = keyed.groupBy("_key").agg(F.min(F.col(hit).cast("int")).alias("ok"), rows())
    right = (F.col("ok") == 1) & (F.col("n") >= 2)
    return groups.agg((F.avg(right.cast("double")) * 100).alias("accuracy"), rows("groups"), F.count_if(right).alias("right_groups"))


def quad_scores(df: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Question, image, binary and group accuracy of groups of four (positions 0-3 = q0i0, q0i1, q1i0, q1i1)."""
    at = lambda p: F.max(F.when(F.col(position) == p, F.col(value)))
    quads = df.groupBy(group).agg(*[at(p).alias(f"a{p}") for p in range(4)], rows()).filter(F.col("n") == 4)
    yes, no = (lambda p: F.col(f"a{p}") == 1), (lambda p: F.col(f"a{p}") == 0)
    num = lambda c: c.cast("int")
    q = num(yes(0) & no(1)) + num(yes(3) & no(2))
    i = num(yes(0) & no(2)) + num(yes(3) & no(1))
    b = num(yes(0)) + num(no(1)) + num(no(2)) + num(yes(3))
    return quads.select(q.alias("q"), i.alias("i"), b.alias("b")).agg(
        (F.sum("q") / (2 * F.count(F.lit(1)))).alias("question_acc"), (F.sum("i") / (2 * F.count(F.lit(1)))).alias("image_acc"),
        (F.sum("b") / (4 * F.count(F.lit(1)))).alias("binary_acc"), F.avg(num((F.col("q") == 2) & (F.col("i") == 2))).alias("group_acc"), rows("groups"))


def worst_case(df: DataFrame, question: str, variant: str, dims: Sequence[str], hit: str = "hit") -> DataFrame:
    """Average case over all rows and worst case (every variant right, read on the first variant), with the same breakdowns."""
    sets = {"overall": []} | {d: [d] for d in dims}
    average = grouping_report(df, sets, [F.avg(hit).alias("acc"), rows()])
    firsts = df.groupBy(question).agg(F.min(hit).alias("_worst"), *[F.min_by(d, variant).alias(d) for d in dims])
    worst = grouping_report(firsts, sets, [F.avg("_worst").alias("acc"), rows()])
    return average.withColumn("setting", F.lit("average")).unionByName(worst.withColumn("setting", F.lit("worst")))


def flip_circular(df: DataFrame, qid: str = "qid", hit: str = "hit") -> DataFrame:
    """Accuracy under four groupings of an id: itself, without -flip, prefix 8 or 13, prefix 8; a group hits when all rows do."""
    keys = {"vanilla": F.col(qid), "flip_eval": F.replace(qid, F.lit("-flip"), F.lit("")),
            "circ_eval": F.when(F.col(qid).contains("-flip"), F.substring(qid, 1, 13)).otherwise(F.substring(qid, 1, 8)),
            "flip_circ_eval": F.substring(qid, 1, 8)}
    tags = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), k.alias("key")) for n, k in keys.items()]))
    groups = df.select(tags.alias("_t"), hit).groupBy("_t.setting", "_t.key").agg(F.min(hit).alias("ok"))
    return groups.groupBy("setting").agg(F.avg("ok").alias("acc"), rows())


def rotation_consistency(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Result tables (idx, category, hit) joined on (idx, category): right in all, wrong in all, each table's rate, Average row."""
    named = [df.select("idx", "category", F.col("hit").alias(f"hit_{n}")) for n, df in tables.items()]
    joined = reduce(lambda a, b: a.join(b, ["idx", "category"]), named)
    cols = [F.col(f"hit_{n}") for n in tables]
    lowest, highest = (F.least(*cols), F.greatest(*cols)) if len(cols) > 1 else (cols[0], cols[0])
    per = joined.groupBy("category").agg(rows("total_questions"), F.avg((lowest == 1).cast("double")).alias("hit_all"), F.avg((highest == 0).cast("double")).alias("miss_all"),
                                         *[F.avg(f"hit_{n}").alias(n) for n in tables])
    shares = ["hit_all", "miss_all", *tables]
    average = per.agg(F.floor(F.avg("total_questions")).cast("bigint").alias("total_questions"), *[F.round(F.avg(c), 3).alias(c) for c in shares])
    return per.unionByName(average.select(F.lit("Average").alias("category"), "total_questions", *shares))


def four_view_consistency(df: DataFrame, key: str, passed: str) -> DataFrame:
    """Keys with exactly four passing rows over a quarter of all rows, x 100."""
    per = df.groupBy(key).agg(F.count_if(F.col(passed)).alias("p"), rows())
    return per.agg((F.count_if(F.col("p") == 4) / (F.sum("n") / 4) * 100).alias("consistency"), F.sum("n").alias("n"))


def step_mastery(df: DataFrame, item: str, step: str, right: str, steps: Sequence[int] = (2, 3)) -> DataFrame:
    """Sub-steps 1..n against the final question ("multi"): memorised, ungeneralised, missing knowledge or mastered.

    ``step`` holds keys such as 2steps_1 and 2steps_multi. One aggregation per item replaces the chain of self joins;
    an item counts when it has a first step. Loose and strict counts, rates and weighted scores in one row.
    """
    key = F.regexp_extract(step, r"^(\d+)steps_(\w+)$", 1).cast("int")
    part = F.regexp_extract(step, r"^(\d+)steps_(\w+)$", 2)
    flat = df.filter(key.isin(*steps)).select(item, key.alias("n"), part.alias("part"), F.col(right).cast("boolean").alias("ok"))
    last = max(steps)
    wide = flat.groupBy(item, "n").agg(*[F.max(F.when(F.col("part") == str(i), F.col("ok"))).alias(f"s{i}") for i in range(1, last + 1)],
                                       F.max(F.when(F.col("part") == "multi", F.col("ok"))).alias("multi")).filter(F.col("s1").isNotNull())
    states = F.filter(F.slice(F.array(*[F.col(f"s{i}") for i in range(1, last + 1)]), F.lit(1), F.col("n")), lambda x: x.isNotNull())
    full = F.size(states) == F.col("n")
    any_wrong, any_right = F.exists(states, lambda x: ~x), F.exists(states, lambda x: x)
    all_right, all_wrong = full & ~any_wrong, full & ~any_right
    multi = F.col("multi")
    n = lambda c: F.count_if(c).cast("double")
    counts = wide.agg(
        n(all_right & ~multi).alias("inadequate"), n(any_wrong & ~multi).alias("insufficient"),
        n(any_right & multi).alias("mastery_loose"), n(all_right & multi).alias("mastery_strict"),
        n(all_wrong & multi).alias("rote_loose"), n(any_wrong & multi).alias("rote_strict"), rows("items"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    score = lambda kind: (F.col("items") - 0.5 * F.col("inadequate") - F.col(f"rote_{kind}") - F.col("insufficient")) / F.col("items")
    return counts.withColumns({"rote_loose_rate": share("rote_loose", "mastery_loose"), "rote_strict_rate": share("rote_strict", "mastery_strict"),
                               "score_loose": score("loose"), "score_strict": score("strict")})


def concept_accuracy(steps: DataFrame, tree: DataFrame) -> DataFrame:
    """Mean by concept attached to the concept tree (concept, root), then the mean of the concept means by root."""
    per = steps.groupBy("concept").agg(F.avg("hit").alias("acc"))
    return tree.join(per, "concept", "left").groupBy("root").agg(F.avg("acc").alias("acc"), F.count("acc").alias("concepts"))


def compare_with_auxiliary_runs(base: DataFrame, auxiliary: DataFrame) -> DataFrame:
    """Base score of every item beside a map of the auxiliary runs' scores (item, run, score)."""
    runs = auxiliary.groupBy("item").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("run", "score")))).alias("auxiliary"))
    return base.join(runs, "item", "left")
