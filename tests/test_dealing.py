"""Tables dealt to tasks by their size: what a task sorts or groups stays bounded, and the rows stay the same."""

import contextlib
import io

import pytest

from __spark_entry__ import oracle_sql, queries
from check import rows_of
from scorewright.operators import joins, matching, safety
from scorewright.operators.skew import dealt, tasks_for
from scorewright.plans import joins as join_plans, safety as safety_plans, score as score_plans
from tests.test_catalogue import FOLDER, duck  # noqa: F401


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_tasks_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark.range(10 * cores), rows=10) is None
    assert tasks_for(spark.range(10 * cores), spark.range(995), rows=10) == cores + 100
    assert dealt(spark.range(100), ["id"], 13).rdd.getNumPartitions() == 13


def test_future_boxes_is_one_grouping(spark):
    boxes = spark.createDataFrame([(1, 1, 7, 4.0, 2.0, 0.0), (1, 1, 7, 5.0, 1.0, 1.0), (1, 1, 8, 4.0, 2.0, 0.0), (1, None, 7, 4.0, 2.0, 0.0)],
                                  "scene int, frame int, box_id int, l double, w double, yaw double")
    steps = spark.createDataFrame([(1, 1, 7, 1, 0.1, True, 1.0, 1.0, 0.1), (1, 1, 7, 2, 0.1, True, 2.0, 2.0, 0.05), (1, 1, 7, 3, 0.2, True, 3.0, 3.0, 0.9), (1, None, 7, 1, 0.1, True, 1.0, 1.0, 0.0),
                                   (1, 1, 9, 1, 0.1, True, 1.0, 1.0, 0.0), (1, 1, 8, 1, 0.1, False, 1.0, 1.0, 0.0)],
                                  "scene int, frame int, box_id int, seq int, relative_time double, valid boolean, x double, y double, yaw double")
    want = [(1, 1, 7, 1, 0.1, 2.0, 2.0, 4.0, 2.0, 0.05), (1, 1, 7, 1, 0.1, 2.0, 2.0, 5.0, 1.0, 1.0), (1, 1, 7, 2, 0.2, 3.0, 3.0, 4.0, 2.0, 0.05), (1, 1, 7, 2, 0.2, 3.0, 3.0, 5.0, 1.0, 0.9)]
    assert sorted(map(tuple, safety.future_boxes(boxes, steps).collect())) == want
    deal = lambda df: dealt(df, safety.FRAME, 3)
    out = safety.future_boxes(deal(boxes), deal(steps))
    assert sorted(map(tuple, out.collect())) == want
    # what is dealt by frame is neither joined nor shuffled again
    assert "Join" not in plan(out) and "ENSURE_REQUIREMENTS" not in plan(out)


def test_field_match_is_one_grouping(spark):
    kind = "file int, field string, value string"
    gold = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "a", None), (2, "b", "y"), (None, "b", "y")], kind)
    pred = spark.createDataFrame([(1, "a", "x"), (1, "a", None), (1, "a", None), (3, "b", "y"), (None, "b", "y")], kind)
    out = matching.field_match(gold, pred, 3)
    want = {(1, "a", 1, 2, 2), (2, "b", 0, 1, 0), (3, "b", 0, 0, 1), (None, "b", 0, 1, 1)}
    assert set(map(tuple, out.collect())) == want == set(map(tuple, matching.field_match(gold, pred).collect()))
    assert "Join" not in plan(out) and "ENSURE_REQUIREMENTS" not in plan(out)


def test_first_match_deals_both_tables(spark):
    wanted = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    found = spark.createDataFrame([(1, 5), (1, 4), (3, 1), (None, 2)], "k int, root int")
    first, missing = joins.first_match(wanted, found, "k", "root", 3)
    assert [tuple(r) for r in first.collect()] == [(1, 4)]
    assert sorted(map(tuple, missing.collect()), key=str) == [(2,), (None,)]
    again, _ = joins.first_match(wanted, found, "k", "root", 3)
    assert plan(again).count("REPARTITION_BY_NUM") == 2 and "hashpartitioning(k, 8)" not in plan(again)


@pytest.mark.parametrize("name", ["l01_box_corners", "l02_collision", "l02_collision_exact", "l04_solid_line", "l05_drivable_area", "l06_future_boxes", "l07_time_to_collision", "l09_full_score",
                                  "d39_field_match_kie", "e06_field_micro_f1", "e06_error_rows", "h07_first_match_lookup"])
def test_dealt_query(spark, duck, monkeypatch, name):  # noqa: F811
    for plans in (safety_plans, score_plans, join_plans):
        monkeypatch.setattr(plans, "tasks_for", lambda *tables: 12)
    df = queries()[name](spark, FOLDER)
    rel = duck.execute(oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in rel.description], rel.fetchall())
