"""Time intervals: overlap scores, overlap joins, frame sampling and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.operators.cells import bin_of, cells_of, span_pairs, top_level
from scorewright.operators.skew import ordered, ranked


def _marks(df: DataFrame, key: str, side: str) -> DataFrame:
    edge = lambda at, step: F.struct(F.col(at).cast("double").alias("t"), F.lit(step if side == "gold" else 0).alias("g"), F.lit(step if side == "pred" else 0).alias("p"))
    return df.select(key, F.explode(F.array(edge("start", 1), edge("end", -1))).alias("m")).select(key, "m.t", "m.g", "m.p")


def interval_iou(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Overlap over union of the merged gold and predicted (start, end) intervals of each key.

    One sweep: interval edges are put in time order, running depths tell which stretches each side covers. Long keys are
    spread over time ranges. No interval pairs are formed.
    """
    marks = _marks(gold, key, "gold").unionByName(_marks(pred, key, "pred"))
    swept = ordered(marks, ["t"], [key], sums={"gd": "g", "pd": "p"}, following={"nxt": "t"})
    width = F.coalesce(F.col("nxt") - F.col("t"), F.lit(0.0))
    in_gold, in_pred = F.col("gd") > 0, F.col("pd") > 0
    total = swept.groupBy(key).agg(F.sum(F.when(in_gold & in_pred, width).otherwise(0.0)).alias("both"), F.sum(F.when(in_gold | in_pred, width).otherwise(0.0)).alias("either"))
    return total.select(key, F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(0.0).alias("iou"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of left and right rows of a key whose closed intervals meet. Columns: key, l_* and r_*.

    Intervals are cut into dyadic cells from ``width`` up, so a hot key spreads over its cells and a long interval adds a few rows.
    """
    return span_pairs(left, right, [key], [("start", "end")], [width])


def covered(spans: DataFrame, points: DataFrame, key: str, width: float) -> DataFrame:
    """Spans (key, start, end, ...) with a point (key, t) strictly inside; equal spans all stay.

    A span asks its first and last bin for their distinct points and the dyadic cells between them whether any point is there, so a long span
    adds a few rows and no list grows with the span.
    """
    at = points.select(F.col(key), F.col("t").cast("double").alias("_t")).where("_t IS NOT NULL")
    levels = top_level([(spans, F.col("start"), F.col("end"))], width)
    listed = at.groupBy(key, bin_of(F.col("_t"), width).alias("_no")).agg(F.collect_set("_t").alias("_ts"))
    cell = lambda level, no: F.struct(level.cast("int").alias("level"), no.alias("no"))
    # a list has level -1; the cells above it, from level 0 on, carry none
    above_it = F.transform(F.sequence(F.lit(0), F.col("_top")), lambda k: cell(k, F.floor(F.col("_no") / F.pow(F.lit(2.0), k)).cast("bigint")))
    lists = listed.select(key, F.lit(-1).alias("level"), F.col("_no").alias("no"), "_ts")
    marks = listed.withColumn("_top", levels).select(key, F.inline(above_it)).distinct().withColumn("_ts", F.lit(None).cast("array<double>"))
    per = spans.withColumn("_id", F.struct(*spans.columns)).groupBy(key, "_id").agg(F.count(F.lit(1)).alias("_times")).withColumn("_top", levels)
    first, last = (bin_of(F.col(f"_id.{c}"), width) for c in ("start", "end"))
    per = per.where(last >= first)
    edges = per.select(key, "_id", "_times", F.inline(F.array_distinct(F.array(cell(F.lit(-1), first), cell(F.lit(-1), last)))))
    between = cells_of(per, first + 1, last - 1, F.col("_top")).where(~F.col("part")).select(key, "_id", "_times", "level", "no")
    cut = edges.unionByName(between).join(lists.unionByName(marks), [key, "level", "no"])
    inside = F.col("_ts").isNull() | F.exists("_ts", lambda t: (t > F.col("_id.start")) & (t < F.col("_id.end")))
    hit = cut.filter(inside).groupBy(key, "_id").agg(F.first("_times").alias("_times"))
    return hit.select("_id.*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(*spans.columns)


def merge_by_time(frames: DataFrame, subtitles: DataFrame, key: str, width: float) -> DataFrame:
    """Frames (key, t, content) and the subtitles holding a frame, in one order by time and midpoint.

    Subtitles under a second are widened to one second. Output: key, at, kind (0 frame, 1 subtitle), content, pos.
    """
    middle, short = (F.col("start") + F.col("end")) / 2, F.col("end") - F.col("start") < 1
    widened = subtitles.withColumns({"start": F.when(short, middle - 0.5).otherwise(F.col("start")), "end": F.when(short, middle + 0.5).otherwise(F.col("end"))})
    kept = covered(widened, frames, key, width)
    a = frames.select(key, F.col("t").alias("at"), F.lit(0).alias("kind"), "content")
    b = kept.select(key, ((F.col("start") + F.col("end")) / 2).alias("at"), F.lit(1).alias("kind"), "content")
    return ranked(a.unionByName(b), ["at", "kind", "content"], [key], name="pos")


def sample_by_interval(df: DataFrame, key: str, frame_num: int, fps: float) -> DataFrame:
    """Frame numbers of the (start, end) intervals of a key: shares by length, at least one each, segment centres.

    All frames are taken when the budget covers the whole length.
    """
    cut = df.withColumn("_a", F.rint(F.col("start") * fps).cast("bigint")).withColumn("_b", F.rint(F.col("end") * fps).cast("bigint"))
    total = cut.groupBy(key).agg(F.sum(F.col("_b") - F.col("_a")).alias("_total"))
    joined = cut.join(total, key)
    length = F.col("_b") - F.col("_a")
    n = F.greatest(F.floor(F.lit(frame_num) * (length / F.col("_total"))), F.lit(1)).cast("int")
    size = length / n
    centres = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(F.col("_a") + size / 2 + size * i).cast("bigint"))
    every = F.when(length > 0, F.sequence(F.col("_a"), F.greatest(F.col("_b") - 1, F.col("_a")))).otherwise(F.array().cast("array<bigint>"))
    frames = F.when(F.lit(frame_num) >= F.col("_total"), every).otherwise(centres)
    return joined.withColumn("frame", F.explode(frames)).drop("_a", "_b", "_total")


def subtitle_text(lines: DataFrame, times: DataFrame, with_time: bool = False, video: str = "video") -> DataFrame:
    """Subtitle block of every video from the lines (video, line, text, start, end) that span a sampled time.

    Lines come in the order of the sampled times, then of the file; a repeated text is kept once.
    """
    clean = F.replace(F.col("text"), F.lit("\\N"), F.lit(" "))
    if with_time:
        clean = F.concat(F.lit("["), F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string"), F.lit("] "), clean)
    spanning = lines.join(times, video).withColumn("_hits", F.filter("times", lambda x: (x > F.col("start")) & (x < F.col("end"))))
    seen = spanning.filter(F.size("_hits") > 0).select(video, clean.alias("_text"), F.struct(F.element_at("_hits", 1).alias("c"), "start", "line").alias("_at"))
    once = seen.filter(F.trim("_text") != "").groupBy(video, "_text").agg(F.min("_at").alias("_at"))
    joined = once.groupBy(video).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_text"))), lambda s: s["_text"]), "\n").alias("_b"))
    return joined.select(video, F.concat(F.lit("The subtitles of the video are as follows:\n\n"), "_b", F.lit("\n\n")).alias("body"))
