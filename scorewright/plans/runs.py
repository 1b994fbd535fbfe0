"""Run management queries (M)."""

from pyspark.sql import functions as F

from scorewright.operators import joins, runs
from scorewright.plans.catalog import over, query

c = F.col


@query("m01_resume_todo", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0 AND doc_id % 3 > 0)")
def resume_todo(t):
    result = F.when(c("toxic") == 1, F.lit("Failed to obtain answer via API.")).when(c("doc_id") % 3 == 0, F.lit(None)).otherwise("fine")
    results = t.labels.select("doc_id", result.alias("result"))
    return runs.resume_todo(t.documents.select("doc_id", "lang"), results, "doc_id", "result")


@query("m02_merge_partial_results", """WITH p AS (SELECT l_orderkey AS idx, l_partkey AS step, 0 AS part, l_suppkey AS r FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_partkey, 1, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1)
 SELECT idx, max(step) AS step, arg_max(r, (step, part, r)) AS r, CAST(NULL AS BIGINT) AS missing FROM p GROUP BY idx UNION ALL SELECT NULL, NULL, NULL, count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""", ints="step r missing")
def merge_partial_results(t):
    part = lambda n: t.lineitem.filter(c("l_linenumber") % 2 == n).select(c("l_orderkey").alias("idx"), c("l_partkey").alias("step"), c("l_suppkey").alias("r"))
    merged = runs.merge_partial_results([part(0), part(1)], "idx", "step")
    gaps = runs.missing_results(t.orders.select(c("o_orderkey").alias("idx")), merged, "idx").agg(F.count(F.lit(1)).alias("missing"))
    return merged.withColumn("missing", F.lit(None).cast("bigint")).unionByName(gaps, allowMissingColumns=True)


SCAN = "lang AS model, source AS dataset, CASE WHEN doc_id % 7 = 0 THEN 'Failed to obtain answer via API.' ELSE text END AS prediction, CASE WHEN doc_id % 11 = 0 THEN 'All 5 retries failed.' ELSE 'ok' END AS log"


@query("m03_failure_scan", over("documents", SCAN, """ SELECT model, dataset, 'inference' AS rule, count(*) FILTER (contains(prediction, 'Failed to obtain answer via API')) AS failed, count(*) AS total, count(*) FILTER (contains(prediction, 'Failed to obtain answer via API')) / count(*) * 100 AS share FROM d GROUP BY ALL
 UNION ALL SELECT model, dataset, 'judge', count(*) FILTER (contains(log, 'All 5 retries failed.')), count(*), count(*) FILTER (contains(log, 'All 5 retries failed.')) / count(*) * 100 FROM d GROUP BY ALL"""), "share", "failed total")
def failure_scan(t):
    rules = {"inference": runs.failed(c("prediction")), "judge": c("log").contains("All 5 retries failed.")}
    return runs.failure_scan(t.derive("documents", SCAN), ["model", "dataset"], rules)


@query("m04_missing_combinations", "SELECT c_custkey AS model, b AS dataset FROM customer, (SELECT DISTINCT p_brand AS b FROM part) EXCEPT SELECT o_custkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey")
def missing_combinations(t):
    done = t.orders.join(t.lineitem.select(c("l_orderkey").alias("o_orderkey"), c("l_partkey").alias("p_partkey")), "o_orderkey").join(t.part, "p_partkey")
    scored = done.select(c("o_custkey").alias("model"), c("p_brand").alias("dataset"))
    return joins.missing_pairs(t.customer.select(c("c_custkey").alias("model")), "model", t.part.select(c("p_brand").alias("dataset")), "dataset", scored)


@query("m05_summary_table", "SELECT o_orderpriority AS model, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY o_orderpriority", "F O")
def summary_table(t):
    stats = t.orders.groupBy(c("o_orderpriority").alias("model"), c("o_orderstatus").alias("benchmark")).agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("best"))
    long = stats.unpivot(["model", "benchmark"], ["mean", "best"], "metric", "value")
    return runs.summary_table(long, {"F": "mean", "O": "best"})


EXP = "SELECT 'acc' AS metric, o_orderpriority AS experiment, o_orderstatus AS dataset, avg(o_totalprice) / 500000 AS value, count(*) AS n FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') GROUP BY ALL"


def _experiments(name, weighted, mean):
    @query(name, f"WITH e AS ({EXP}) SELECT metric, experiment, max(value) FILTER (dataset = 'F') * 100 AS \"F\", max(value) FILTER (dataset = 'O') * 100 AS \"O\", max(value) FILTER (dataset = 'P') * 100 AS \"P\", CASE WHEN count(DISTINCT dataset) = 3 THEN printf('%.2f', {mean} * 100) ELSE '-' END AS summary FROM e GROUP BY metric, experiment", "F O P")
    def run(t):
        kept = t.orders.filter("NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')")
        df = kept.groupBy(F.lit("acc").alias("metric"), c("o_orderpriority").alias("experiment"), c("o_orderstatus").alias("dataset")).agg((F.avg("o_totalprice") / 500000).alias("value"), F.count(F.lit(1)).alias("n"))
        return runs.multi_experiment_summary(df, ["F", "O", "P"], weighted)


_experiments("m06_multi_experiment_summary", False, "sum(value) / (3 + 1e-9)")
_experiments("m06_multi_experiment_summary_weighted", True, "sum(value * n) / (sum(n) + 1e-9)")


@query("m07_latest_run", "SELECT o_custkey AS model, max(o_orderdate) AS run FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def latest_run(t):
    held = t.orders.filter("o_orderstatus <> 'P'").select(c("o_custkey").alias("model"), c("o_orderdate").alias("run"))
    return runs.latest_run(held, ["model"], "run")


@query("m08_response_ratio", "WITH j AS (SELECT d.doc_id, l.doc_id AS f, CASE WHEN toxic = 0 THEN 1 END AS ok FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT count(*) AS gold, count(ok) AS parsed, count(f) - count(ok) AS unreadable, count(*) - count(f) AS missing, count(f) / (count(*) + 1e-9) AS ratio FROM j", "ratio", "gold parsed unreadable missing")
def response_ratio(t):
    responses = t.labels.select("doc_id", F.when(c("toxic") == 0, "text").alias("parsed"))
    return runs.response_ratio(t.documents, responses, "doc_id", "parsed")


PRED = "CASE WHEN o_orderkey % 50 = 0 THEN concat('x', CAST(o_orderkey AS VARCHAR(20))) ELSE CAST(o_orderkey * 4 AS VARCHAR(20)) END AS idx, o_orderstatus AS prediction"


@query("m09_validation_check", over("orders", PRED, "SELECT idx, CASE WHEN try_cast(idx AS BIGINT) IS NULL THEN 'not an integer' ELSE 'unknown index' END AS problem FROM d WHERE try_cast(idx AS BIGINT) IS NULL OR try_cast(idx AS BIGINT) NOT IN (SELECT l_orderkey FROM lineitem)"))
def validation_check(t):
    known = t.lineitem.select(c("l_orderkey").alias("idx")).distinct()
    return runs.validation_check(t.derive("orders", PRED), known, "idx", ["idx", "prediction"])


@query("m10_speed_report", "SELECT sum(user_id) AS tokens, sum(value) AS seconds, sum(user_id) / sum(value) AS tokens_per_second, count(*) AS calls FROM events", "seconds tokens_per_second", "tokens calls")
def speed_report(t):
    return runs.speed_report(t.events, "user_id", "value")
