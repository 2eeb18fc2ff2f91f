"""Windows by panes against windows by copies of the samples."""

import math
import random

import pytest

from telemark.model import label_key
from telemark.operators import panes
from telemark.operators import windows as W


@pytest.fixture(scope="module")
def raw(spark):
    """Series with gaps, bursts, NaN, staleness markers, samples at the steps and far outside the grid."""
    rng = random.Random(7)
    rows = []
    for s in range(4):
        ts = sorted({rng.randrange(-900, 4000) for _ in range(rng.choice([3, 40, 150]))} | {0, 100, 1000} | ({5, 6, 7} if s else set()))
        for x in ts:
            if s == 2 and 800 < x < 1900:
                continue
            value = math.nan if rng.random() < 0.04 and s == 3 else float(rng.randrange(0, 50))
            rows.append(("m", {"s": str(s)}, x, value, rng.random() < 0.05))
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double, is_stale boolean")
    return df.withColumn("lkey", label_key("labels")).repartition(3).cache()


def by_copies(monkeypatch, run):
    with monkeypatch.context() as m:
        m.setattr(panes, "applies", lambda grid, width: False)
        return run()


def by_panes(monkeypatch, run):
    with monkeypatch.context() as m:
        m.setattr(panes, "applies", panes.fits)
        return run()


def points(v):
    return {(r["lkey"], r["t"]): r["value"] for r in v.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k] or math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a[k]) and math.isnan(b[k])), k


@pytest.mark.parametrize("function", ["avg", "count", "first", "last", "max", "min", "present", "stddev", "stdvar", "sum", "ts_of_first", "ts_of_last", "ts_of_max", "ts_of_min"])
def test_functions(raw, monkeypatch, function):
    some = raw if function not in ("avg", "stddev", "stdvar", "sum") else raw.where("not isnan(value)")
    for grid, width, offset in ((W.Grid(0, 3000, 100), 700, 0), (W.Grid(50, 2950, 100), 800, -130), (W.Grid(0, 3000, 250), 500, 40)):
        run = lambda g=grid, w=width, o=offset: points(W.over_time(some, function, g, w, o))
        close(by_panes(monkeypatch, run), by_copies(monkeypatch, run))


def test_all_functions_are_there(spark):
    assert set(panes.folds()) == set(W._OVER_TIME)


@pytest.mark.parametrize("chunk", [None, 8, 9])
def test_growth(raw, monkeypatch, chunk):
    some = raw.where("not isnan(value)")
    for grid, width in ((W.Grid(0, 3000, 100), 700), (W.Grid(0, 3000, 100), 1600)):
        run = lambda g=grid, w=width: points(W.increase(some, g, w, chunk_steps=chunk))
        close(by_panes(monkeypatch, run), by_copies(monkeypatch, run))


def test_rows_are_bounded(raw):
    """No sample is copied: before the windows there is a row for each pane, after them one for each window that holds any."""
    grid, width = W.Grid(0, 3000, 10), 1280
    fold = panes.folds()["sum"]
    parts = panes.panes(W.shifted(raw).where("not is_stale"), grid, width, fold, ["metric", "lkey"])
    held = raw.where(f"not is_stale and ts_ms > {-width} and ts_ms <= 3000").count()
    assert parts.count() <= held
    out = panes.windows(parts, grid, width, fold, chunk_steps=64)
    assert out.count() == out.select("lkey", "t").distinct().count() <= 4 * (grid.last + 1)


def test_long_windows_look_back_by_halves(raw):
    plan = W.over_time(raw, "max", W.Grid(0, 3000, 1), 1024)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("lag(") < 60
    assert not panes.fits(W.Grid(0, 10, 3), 10) and panes.fits(W.Grid(0, 10, 5), 10) and not panes.fits(W.Grid(0, 10, 5), 5)
    assert panes.applies(W.Grid(0, 100, 1), 16) and not panes.applies(W.Grid(0, 100, 1), 15)


