"""Queries read all rows of their tables, whatever dates these have."""

import os

import pytest
from pyspark.sql import functions as F

from telemark.plans import ranges, registry
from telemark.sources import testbed

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module", params=[0, 9000, -20000])
def shifted(spark, request, tmp_path_factory):
    """The tables some days later or earlier."""
    if not request.param:
        return DIR
    to = str(tmp_path_factory.mktemp("shifted"))
    for name, column in {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}.items():
        df = spark.read.parquet(f"{DIR}/{name}.parquet")
        df.withColumn(column, F.col(column).cast("timestamp") + F.make_dt_interval(days=F.lit(request.param))).write.parquet(f"{to}/{name}.parquet")
    return to


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_all_rows_are_read(spark, shifted):
    q = registry.queries()
    n = {t: spark.read.parquet(f"{shifted}/{t}.parquet").count() for t in ("events", "lineitem", "orders")}
    assert total(q["gauge_hourly_count"](spark, shifted), "value") == testbed.gauges(spark, shifted).count()
    assert total(q["histogram_merge"](spark, shifted), "n") == n["lineitem"]
    assert total(q["logs_severity"](spark, shifted), "count") == n["events"]
    assert total(q["red_totals"](spark, shifted), "count") == testbed.spans(spark, shifted).count() >= n["orders"]


def test_grids_hold_all_samples(spark, shifted):
    counts = registry.queries()["promql_count_over_time"](spark, shifted)
    (start, end), (first, last) = ranges.whole(spark, shifted)
    steps = [sum(r["ts_ms"] <= t < r["ts_ms"] + ranges.DAY for t in range(start, end + 1, 21_600_000)) for r in testbed.gauges(spark, shifted).select("ts_ms").collect()]
    assert min(steps) >= 1 and total(counts, "value") == sum(steps)
    weeks = testbed.delta_sums(spark, shifted).agg(F.min("ts_end_ms"), F.max("ts_end_ms")).first()
    assert first <= weeks[0] and weeks[1] <= first + (last - first) // (7 * ranges.DAY) * 7 * ranges.DAY


def test_one_query_has_a_range_within_the_tables(spark):
    q = registry.queries()
    whole, part = (q[n](spark, DIR) for n in ("promql_sum_rate", "promql_sum_rate_range"))
    assert 0 < part.count() < whole.count()
    (start, end), _ = ranges.FIXED
    steps = [r["t"] for r in part.select("t").distinct().collect()]
    assert start <= min(steps) and max(steps) <= end


def test_only_the_ranges_asked_for_are_looked_up():
    sql = registry.oracle_sql()
    assert ranges.asked(sql["promql_sum_rate"]) == {"events": True, "lines": False}
    assert ranges.asked(sql["promql_native_count"]) == {"events": False, "lines": True}
    assert not [n for n in sql if n.endswith("_whole")]
