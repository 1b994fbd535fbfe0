"""Matching between gold and predicted parts of a row: tokens, n-grams, lines, fields and linked fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.score import edit_ratio, matcher_ratio, shared_tokens
from scorewright.operators.skew import dealt
from scorewright.session import ensure_checkpoint_dir


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every linked id, root = smallest id of its connected group.

    Each round takes the smallest root among the neighbours and then jumps to the root's root; the table is cut from its
    lineage by a checkpoint in the shared folder and the loop ends when nothing changes.
    """
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    roots = edges.groupBy(F.col("x").alias("id")).agg(F.least(F.first("x"), F.min("y")).alias("root")).checkpoint()
    while True:
        near = edges.join(roots, F.col("y") == F.col("id")).groupBy("x").agg(F.min("root").alias("near"))
        lower = roots.join(near, F.col("id") == F.col("x"), "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        up = roots.select(F.col("id").alias("_id"), F.col("root").alias("_up"))
        moved = lower.join(up, F.col("low") == F.col("_id"), "left").select("id", F.col("root").alias("_old"), F.least("low", F.coalesce("_up", "low")).alias("root")).checkpoint()
        done = moved.filter("root <> _old").isEmpty()
        roots = moved.select("id", "root")
        if done:
            return roots


def merge_linked_fragments(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Elements (id, pos, category, text) with linked ones merged: text in order, the first element keeps id, pos and category."""
    known = nodes.select("id")
    valid = links.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    roots = components(valid)
    member = nodes.join(roots, "id", "left")
    alone = member.filter(F.col("root").isNull()).select("id", "pos", "category", "text", F.lit(1).cast("bigint").alias("parts"))
    part = F.struct("pos", "id", "category", "text")
    merged = member.filter(F.col("root").isNotNull()).groupBy("root").agg(F.sort_array(F.collect_list(part)).alias("m"))
    head = lambda n: F.element_at("m", 1)[n].alias(n)
    text = F.array_join(F.transform("m", lambda s: s["text"]), "").alias("text")
    return merged.select(head("id"), head("pos"), head("category"), text, F.size("m").cast("bigint").alias("parts")).unionByName(alone)


def bag_overlap(df: DataFrame, key: str, gold: Column, pred: Column) -> DataFrame:
    """Shared token count with repeats, and both token counts, per row; counted inside the row, so no token is shuffled."""
    size = lambda tokens: F.coalesce(F.size(tokens), F.lit(0)).cast("bigint")
    return df.select(key, F.coalesce(shared_tokens(gold, pred), F.lit(0)).cast("bigint").alias("right"), size(gold).alias("gold_tokens"), size(pred).alias("pred_tokens"))


def best_ngram_match(df: DataFrame, key: str, needle: str, hay: str, tokens, sep: str = " ", similarity: str = "matcher") -> DataFrame:
    """Most similar n-gram of the answer text among those sharing a token with the needle (first one of equals), with set scores.

    ``tokens`` maps a text column to its token array; n is the needle's token count. Grams without a shared token are
    dropped before any comparison. ``similarity`` is matcher (matching blocks) or edit (1 - edit share).
    """
    base = df.select(key, F.col(needle).alias("_needle"), tokens(F.col(needle)).alias("_want"), tokens(F.col(hay)).alias("_have"))
    n = F.size("_want")
    last = F.size("_have") - n
    grams = F.when((n > 0) & (last >= 0), F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.transform(F.sequence(i, i + n - 1), lambda k: F.get("_have", k))))
    near = F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda s: F.arrays_overlap(s["g"], F.col("_want")))
    flat = base.select(key, "_needle", "_want", F.explode(near).alias("c")).withColumn("_gram", F.array_join("c.g", sep))
    sim = matcher_ratio(F.col("_gram"), F.col("_needle")) if similarity == "matcher" else 1 - edit_ratio(F.col("_needle"), F.col("_gram"), F.levenshtein)
    best = flat.withColumn("_sim", sim).groupBy(key).agg(F.max(F.struct(F.col("_sim").alias("s"), (-F.col("c.i")).alias("i"), F.col("c.g").alias("g"))).alias("b"))
    out = base.select(key, "_want").join(best, key, "left")
    g, w = F.coalesce(F.col("b.g"), F.array().cast("array<string>")), F.col("_want")
    both = F.size(F.array_intersect(g, w))
    precision = F.coalesce(both / F.nullif(F.size(F.array_distinct(g)), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(both / F.nullif(F.size(F.array_distinct(w)), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    none = F.col("b").isNull()
    return out.select(key, F.coalesce(F.col("b.s"), F.lit(0.0)).alias("max_sim"), F.array_join(g, sep).alias("best"),
                      precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                      F.when(none, 0.0).otherwise(F.coalesce(both / F.nullif(F.size(F.array_union(g, w)), F.lit(0)), F.lit(0.0))).alias("jaccard"),
                      F.when(~none & (g == w), 1.0).otherwise(0.0).alias("exact"))


def field_match(gold: DataFrame, pred: DataFrame, tasks: int | None = None) -> DataFrame:
    """Fields (file, field, value) as multisets: true positives, missing and surplus per file and field; a null matches nothing.

    Both sides are counted in one grouping, so no join sorts them; ``tasks`` deals the fields of both to so many tasks.
    """
    side = lambda df, g, p: df.select("file", "field", "value", F.lit(g).alias("g"), F.lit(p).alias("p"))
    both = dealt(side(gold, 1, 0).unionByName(side(pred, 0, 1)), ["file", "field"], tasks)
    j = both.groupBy("file", "field", "value").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    whole = F.col("file").isNotNull() & F.col("field").isNotNull() & F.col("value").isNotNull()
    met = F.when(whole, F.least("g", "p")).otherwise(0)
    return j.groupBy("file", "field").agg(F.sum(met).alias("tp"), F.sum(F.col("g") - met).alias("fn"), F.sum(F.col("p") - met).alias("fp"))
