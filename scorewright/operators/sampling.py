"""Shuffling, mixing, batching, sampling and ordering of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.operators.skew import ranked, unit_hash


def gather_turns(df: DataFrame, conversation: str, turn: str) -> DataFrame:
    """One row per conversation with its turns in order as an array of (role, text)."""
    parts = F.sort_array(F.collect_list(F.struct(turn, "role", "text")))
    return df.groupBy(conversation).agg(F.transform(parts, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def shuffled(df: DataFrame, key: str, seed: str = "0", name: str = "pos") -> DataFrame:
    """Whole-data shuffle: position of every row in a seeded hash order (no single sort task)."""
    keyed = df.withColumn("_h", unit_hash(F.col(key), seed=seed))
    return ranked(keyed, ["_h", key], name=name).drop("_h")


def repeat_epochs(df: DataFrame, key: str, epochs: int, seed: str = "0") -> DataFrame:
    """``epochs`` differently shuffled passes over all rows: epoch and position inside it."""
    passes = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = passes.withColumn("_h", unit_hash(F.col("epoch"), F.col(key), seed=seed))
    return ranked(keyed, ["_h", key], ["epoch"], name="pos").drop("_h")


def resample_shards(shards: DataFrame, key: str, draws: int, seed: str = "0") -> DataFrame:
    """``draws`` shards with replacement: draw number i takes the shard at a hashed position."""
    placed = ranked(shards.withColumn("_k", F.md5(F.col(key).cast("string"))), ["_k", key], name="_i").drop("_k")
    total = shards.agg(F.count(F.lit(1))).scalar()
    picks = shards.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(unit_hash(F.col("id"), seed=seed) * total).alias("_i"))
    return picks.join(placed, "_i").drop("_i")


def mix_sources(df: DataFrame, source: str, key: str, weights: Mapping[str, float], steps: int, seed: str = "0", tasks: Mapping[str, str] | None = None,
                task_weights: Mapping[str, float] | None = None) -> DataFrame:
    """Step i draws one source by normalised weight and takes that source's next row in shuffled order (cycling).

    With ``tasks`` (source -> task) the draw has two levels: a task by ``task_weights``, then a source inside it.
    """
    if tasks:
        inner = {t: sum(w for s, w in weights.items() if tasks[s] == t) for t in set(tasks.values())}
        outer = sum(task_weights.values())
        shares = {s: task_weights[tasks[s]] / outer * w / inner[tasks[s]] for s, w in weights.items()}
    else:
        total = sum(weights.values())
        shares = {s: w / total for s, w in weights.items()}
    draw, edge, choice = unit_hash(F.col("id"), seed=seed), 0.0, None
    for name in list(shares)[:-1]:
        edge += shares[name]
        choice = F.when(draw < edge, name) if choice is None else choice.when(draw < edge, name)
    last = list(shares)[-1]
    choice = F.lit(last) if choice is None else choice.otherwise(last)
    plan = df.sparkSession.range(steps).select(F.col("id").alias("step"), choice.alias(source))
    turns = ranked(plan, ["step"], [source], name="_turn")
    kept = df.filter(F.col(source).isin(*shares)).withColumn("_h", unit_hash(F.col(key), seed=seed))
    placed = ranked(kept, ["_h", key], [source], name="_i", total="_n").drop("_h")
    sizes = placed.groupBy(source).agg(F.max("_n").alias("_n"))
    wanted = turns.join(F.broadcast(sizes), source).withColumn("_i", F.col("_turn") % F.col("_n")).drop("_n", "_turn")
    return wanted.join(placed.drop("_n"), [source, "_i"]).drop("_i")


def zip_sources(sources: Mapping[str, tuple[DataFrame, str, str]], mode: str = "max_size_cycle") -> DataFrame:
    """Rows of several sources side by side by position: shortest source, or cycling to the longest one.

    ``sources`` maps a name to (DataFrame, order column, value column).
    """
    placed, sizes = {}, {}
    for name, (df, order, value) in sources.items():
        placed[name] = ranked(df.select(order, value), [order], name="pos").select("pos", F.col(value).alias(name))
        sizes[name] = df.agg(F.count(F.lit(1))).scalar()
    length = F.greatest(*sizes.values())
    out = None
    for name, rows in placed.items():
        if mode == "max_size_cycle":
            # a row at position p comes back at p + size, p + 2 size, ... below the longest length
            last = F.floor((length - 1 - F.col("pos")) / sizes[name]).cast("bigint")
            rows = rows.withColumn("_size", sizes[name]).withColumn("_last", last)
            rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
            rows = rows.select((F.col("pos") + F.col("_k") * F.col("_size")).alias("pos"), name)
        out = rows if out is None else out.join(rows, "pos")
    return out


def batch(df: DataFrame, order: str, value: str, n: int, partial: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Lists of ``n`` values in order; the last short one is dropped unless ``partial``."""
    placed = ranked(df, [order], list(by), name="_p")
    grouped = placed.groupBy(*by, F.floor(F.col("_p") / n).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("_p", F.col(value).alias("v")))).alias("_l"))
    out = grouped.select(*by, "batch", F.transform("_l", lambda s: s["v"]).alias("items"))
    return out if partial else out.filter(F.size("items") == n)


def frame_positions(total: Column, n: int) -> Column:
    """n evenly spaced interior positions of 0..total-1."""
    step = total / (n + 1)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(i * step).cast("int"))


def frames_at_rate(total: Column, video_fps: Column, fps: float) -> Column:
    """Every step of the video rate over the wanted rate, over the whole length."""
    count = F.floor(total / video_fps * fps).cast("int")
    step = video_fps / fps
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.floor(i * step).cast("int"))).otherwise(F.array().cast("array<int>"))


def subsample_positions(total: Column, k: int) -> Column:
    """Positions floor(i * total / k); all positions when there are at most k."""
    thin = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * total / k).cast("int"))
    return F.when(total <= k, F.sequence(F.lit(0), F.greatest(total.cast("int") - 1, F.lit(0)))).otherwise(thin)


def drop_condition(text: Column, key: Column, p: float, seed: str = "0", empty: str = "") -> Column:
    return F.when(unit_hash(key, seed=seed) < p, empty).otherwise(text)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_anti").distinct()
