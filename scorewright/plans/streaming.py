"""Streaming queries (N): a stream over the table files runs to its end into the shared folder, and the result is read back."""

from pyspark.sql import functions as F

from scorewright.functions.score import exact
from scorewright.plans.catalog import query
from scorewright.plans.text import unit_sql
from scorewright.sources.records import scratch
from scorewright.streaming import stream as N

c = F.col


def _stream(t, table):
    # a table is one file or a folder of files; as a pattern the path may be either
    return N.read_files(t.spark, f"{t.folder}/{{{table}}}.parquet", getattr(t, table).schema)


def _finish(query):
    query.awaitTermination()


@query("n01_stream_score", "SELECT DISTINCT conv_id, turn, CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END AS score FROM conversations", "score", "turn")
def stream_score(t):
    target = scratch(t.spark, "scores")
    rows = _stream(t, "conversations")
    _finish(N.append_batches(N.stream_score(rows, ["conv_id", "turn"], exact(c("role"), F.lit("user"))), f"{target}/out", f"{target}/state"))
    return t.spark.read.parquet(f"{target}/out").select("conv_id", "turn", "score")


@query("n01_stream_score_event_time", "SELECT event_id, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS score FROM events", "score", "event_id")
def stream_score_event_time(t):
    """Every event arrives twice and is scored once; the state ends with the watermark."""
    target = scratch(t.spark, "event_scores")
    twice = _stream(t, "events").withColumn("ts", c("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    _finish(N.append_batches(N.stream_score(twice, "event_id", exact(c("event_type"), F.lit("click")), "ts", "40 days"), f"{target}/out", f"{target}/state"))
    return t.spark.read.parquet(f"{target}/out").select("event_id", "score")


@query("n02_stream_latest_frame", "SELECT user_id, ts, event_id, value, CASE WHEN value <= 100 THEN 1.0 ELSE 0.0 END AS speed_ok FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", "speed_ok")
def stream_latest_frame(t):
    target = scratch(t.spark, "frames")
    frames = _stream(t, "events").select("user_id", "ts", "event_id", "value")
    newest = N.stream_latest_frame(frames, "user_id", ["ts", "event_id"], lambda df: df.withColumn("speed_ok", F.when(c("value") <= 100, 1.0).otherwise(0.0)))
    _finish(N.changed_batches(newest, ["user_id"], f"{target}/out", f"{target}/state"))
    return N.current_rows(t.spark, f"{target}/out", ["user_id"])


@query("n03_stream_running_metrics", "SELECT event_type, count(*) AS n, avg(value) AS mean_value, avg(user_id) AS mean_user_id FROM events GROUP BY event_type", "mean_value mean_user_id", "n")
def stream_running_metrics(t):
    target = scratch(t.spark, "metrics")
    _finish(N.changed_batches(N.stream_running_metrics(_stream(t, "events"), ["event_type"], ["value", "user_id"]), ["event_type"], f"{target}/out", f"{target}/state"))
    return N.current_rows(t.spark, f"{target}/out", ["event_type"])


_LINE = "replace(text, chr(10), '')"


@query("n04_stream_corpus_prepare", f"SELECT doc_id, CASE WHEN length({_LINE}) > 300 THEN substr({_LINE}, CAST(floor({unit_sql('doc_id')} * (length({_LINE}) - 300)) AS INT) + 1, 300) ELSE {_LINE} END AS text FROM documents WHERE lang <> 'en'")
def stream_corpus_prepare(t):
    target = scratch(t.spark, "corpus")
    rows = _stream(t, "documents").select("doc_id", "lang", "text")
    _finish(N.append_batches(N.stream_corpus_prepare(rows, "text", "doc_id", 300, c("lang") != "en"), f"{target}/out", f"{target}/state"))
    return t.spark.read.parquet(f"{target}/out").select("doc_id", "text")
