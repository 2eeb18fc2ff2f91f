"""Flame graphs with each trace in one task, and dealt to all tasks: the same rows."""

import random

import pytest

from telemark.operators import traces

SCHEMA = "trace_id string, span_id string, parent_span_id string, ts_start_ns long, ts_end_ns long"


def forest(n, seed=3):
    r = random.Random(seed)
    rows = [(f"t{r.randrange(12)}", f"s{r.randrange(60)}", f"s{r.randrange(70)}" if r.random() < 0.8 else "", r.randrange(40), r.randrange(60)) for _ in range(n)]
    return rows + [("é", "é", "", 5, 4), ("é", "z", "é", 5, 9), ("é", "a", "é", 5, 9), ("t1", None, "s1", 1, 2), (None, "x", "", 1, 2), ("t2", "none", None, None, 3), ("u", "own", "own", 1, 2), ("big", "r", "", 0, 9)] + [("big", f"c{k}", f"c{k - 1}" if k else "r", k, k + 1) for k in range(150)]


def graphs(df, **more):
    return sorted(map(tuple, traces.flame_graph(df, **more).collect()), key=str)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_large_and_small_traces_give_the_same(spark, batch):
    df = spark.createDataFrame(forest(400), SCHEMA)
    by_joins = graphs(df, most_spans=0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert graphs(df) == by_joins == graphs(df, most_spans=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(by_joins) > 200 and max(r[3] for r in by_joins) == 150


def test_spans_are_shuffled_once(spark):
    df = spark.createDataFrame(forest(400), SCHEMA)
    plan = traces.flame_graph(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "parquet" not in plan
