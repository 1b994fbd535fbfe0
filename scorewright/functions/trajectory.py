"""Driving trajectories: coordinate tokens, displacement errors and scene windows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.functions.text import let
from scorewright.operators.skew import ranked, with_halo

# The coordinate grid is single precision, so its real step differs from 0.3.
GRID_LOW = -100.0
GRID_STEP = 0.3000030517578125
GRID_BINS = 667
# Phrases of the four driving commands.
DIRECTIONS = ["go left", "go straight", "go right", "unknown"]


def quantise_index(value: Column) -> Column:
    """Nearest grid index; halfway values take the lower one."""
    raw = F.ceil((value.cast("double") - GRID_LOW) / GRID_STEP - 0.5)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(GRID_BINS - 1)).cast("int")


def quantise(value: Column) -> Column:
    return F.concat(F.lit("<bev_"), quantise_index(value).cast("string"), F.lit(">"))


def dequantise(token: Column) -> Column:
    """Grid value of a token, null for anything else."""
    index = F.regexp_extract(token, r"^<bev_\s*([+-]?\d+)\s*>$", 1).try_cast("int")
    value = (F.lit(GRID_LOW) + index * F.lit(GRID_STEP)).cast("float").cast("double")
    return F.when(index.between(0, GRID_BINS - 1), value)


def trajectory_tokens(points: Column) -> Column:
    """Way points to x, y tokens in order."""
    return F.flatten(F.transform(points, lambda p: F.array(quantise(p[0]), quantise(p[1]))))


def decode_trajectory(tokens: Column) -> Column:
    """Valid token values paired in order; an odd last value is dropped."""
    def pair(values: Column) -> Column:
        pairs = F.floor(F.size(values) / 2).cast("int")
        points = F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), lambda i: F.array(F.get(values, i * 2), F.get(values, i * 2 + 1)))
        return F.when(pairs > 0, points).otherwise(F.array().cast("array<array<double>>"))

    return let(F.filter(F.transform(tokens, dequantise), lambda v: v.isNotNull()), pair)


def displacement(pred: Column, gold: Column) -> Column:
    """Struct of mean (ade) and last (fde) point distance over the shorter length; nulls when a side is empty."""
    n = F.least(F.size(pred), F.size(gold))
    errors = F.zip_with(F.slice(pred, F.lit(1), n), F.slice(gold, F.lit(1), n),
                        lambda p, g: F.sqrt(F.pow(p[0] - g[0], F.lit(2.0)) + F.pow(p[1] - g[1], F.lit(2.0))))
    total = F.aggregate(errors, F.lit(0.0), lambda s, e: s + e)
    return F.struct(F.when(n > 0, total / n).alias("ade"), F.when(n > 0, F.try_element_at(errors, F.lit(-1))).alias("fde"))


def teacher_forced(pred: Column, gold: Column, masked: Column) -> Column:
    """Predicted tokens at masked positions, gold tokens elsewhere."""
    return F.transform(gold, lambda g, i: F.when(F.get(masked, i), F.get(pred, i)).otherwise(g))


def mean_ade_fde(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """Means over the rows that have both trajectories, with the counts."""
    e = displacement(F.col(pred), F.col(gold))
    scored = df.select(e["ade"].alias("ade"), e["fde"].alias("fde"))
    return scored.agg(F.avg("ade").alias("mean_ade"), F.avg("fde").alias("mean_fde"),
                      F.count("ade").alias("valid"), F.count(F.lit(1)).alias("total"))


def split_status(status: Column) -> Column:
    """Command, velocity and acceleration of an 8-value status; null when it is shorter."""
    parts = F.struct(F.slice(status, 1, 4).alias("command"), F.slice(status, 5, 2).alias("velocity"), F.slice(status, 7, 2).alias("acceleration"))
    return F.when(F.size(status) >= 8, parts)


def command_text(command: Column) -> Column:
    """Phrase of the largest command value (the first one of equals)."""
    at = F.array_position(command, F.array_max(command)).cast("int")
    return F.when(at > 0, F.element_at(F.array(*[F.lit(d) for d in DIRECTIONS]), F.least(at, F.lit(len(DIRECTIONS)))))


def target_steps(seconds: float, dt: float) -> int:
    return max(1, int(round(seconds / dt)))


def scene_window(frames: DataFrame, scene: str, order: list[str], values: dict[str, Column], history: int, future: int, target: int) -> DataFrame:
    """One sample per frame that starts a full window: history values, future poses and the target frame.

    ``values`` names the expressions kept of every frame; the output has ``history_<n>``, ``future_<n>`` and ``target_<n>``.
    Long scenes are cut into chunks with copied edges, so a hot scene is spread over tasks.
    """
    span = max(history + future, history + target)
    placed = ranked(frames, order, [scene], name="_pos")
    chunked = with_halo(placed, "_pos", before=0, after=span - 1)
    window = Window.partitionBy(scene, "_chunk").orderBy("_pos").rowsBetween(0, span - 1)
    frame = F.struct(*[v.alias(n) for n, v in values.items()])
    rows = chunked.withColumn("_w", F.collect_list(frame).over(window)).filter(F.col("_own") & (F.size("_w") == span))
    part = lambda name, first, n: F.transform(F.slice("_w", first, n), lambda f: f[name])
    out = [scene, F.col("_pos").alias("start")]
    for n in values:
        out += [part(n, 1, history).alias(f"history_{n}"), part(n, history + 1, future).alias(f"future_{n}"),
                F.element_at("_w", history + target)[n].alias(f"target_{n}")]
    return rows.select(*out)


def prompt_text(frame_count: Column, seconds: float, velocity: Column, acceleration: Column, command: Column, history: Column) -> Column:
    """Sentence with frame count, speed, heading, acceleration, action phrase and recent trajectory tokens."""
    # single precision values, ties to even: the text is written from float32 numbers
    one = lambda x: x.cast("float").cast("double")
    velocity, acceleration = (one(velocity[0]), one(velocity[1])), (one(acceleration[0]), one(acceleration[1]))
    fixed = lambda x, n: F.bround(x, n)
    speed = F.sqrt(F.pow(velocity[0], F.lit(2.0)) + F.pow(velocity[1], F.lit(2.0)))
    heading = F.degrees(F.atan2(velocity[1], velocity[0]))
    return F.concat_ws(
        " ",
        F.format_string(f"The ego vehicle history spans %d frames. Predict the driving action and front camera view after {seconds:.2f} seconds.", frame_count),
        F.format_string("Current velocity: speed=%.2f m/s, heading=%.1f deg.", fixed(speed, 2), fixed(heading, 1)),
        F.format_string("Current acceleration: ax=%.2f m/s^2, ay=%.2f m/s^2.", fixed(acceleration[0], 2), fixed(acceleration[1], 2)),
        F.concat(F.lit("You plan to take the following action: "), command_text(command), F.lit(".")),
        F.concat(F.lit("Recent trajectory (ego frame) tokens: "), F.array_join(trajectory_tokens(history), ""), F.lit(".")))


def clip_filter(frames: DataFrame, clip: str, keep: DataFrame | None = None, drop: DataFrame | None = None, shortest: int = 0, longest: int | None = None) -> DataFrame:
    """Frames of clips on the white list, off the black list and within the length limits."""
    if keep is not None:
        frames = frames.join(keep.select(clip), clip, "left_semi")
    if drop is not None:
        frames = frames.join(drop.select(clip), clip, "left_anti")
    sizes = frames.groupBy(clip).agg(F.count(F.lit(1)).alias("_n"))
    good = sizes.filter(F.col("_n").between(shortest, longest if longest is not None else 2**62)).select(clip)
    return frames.join(good, clip, "left_semi")


def inputs_targets(df: DataFrame, key: str, inputs: list[str], targets: list[str]) -> DataFrame:
    return df.select(key, F.struct(*inputs).alias("inputs"), F.struct(*targets).alias("targets"))
