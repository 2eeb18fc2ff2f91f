"""Sums in any order, against rational arithmetic."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from telemark.functions import exact
from telemark.operators import vectors as V

CASES = {
    "cancel": [1e308, 1e308, -1e308],
    "small": [1e16, 1.0, -1e16],
    "tiny": [1e300, 5e-324, -1e300],
    "far": [2.0**1000, 2.0**-1000, 1.0, -(2.0**1000), -1.0],
    "borrow": [-(2.0**58), 2.0**29, 2.0**-30],
    "negative": [-1e-5, -2.5, -3e9, -4e40],
    "zeros": [0.0, -0.0],
    "one": [0.1],
    "tenths": [0.1] * 1000,
    "overflow": [1.7e308, 1.7e308, 1.7e308],
    "least": [5e-324] * 7,
    "powers": [s * 2.0**k for k in range(-1074, 1023, 13) for s in (1, -1, 1)],
    "edges": [x for k in (29, 58, -29, 0, 87) for x in (2.0**k, math.nextafter(2.0**k, 0), -math.nextafter(2.0**k, math.inf))],
}


def rounded(x):
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_and_means(spark, parts):
    rng = random.Random(1)
    cases = dict(CASES)
    for i in range(20):
        cases[f"random{i}"] = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-200, 200) for _ in range(rng.randint(1, 60))]
        cases[f"random{i}"] += [-x for x in cases[f"random{i}"][: rng.randint(0, 30)]]
    rows = [(k, x) for k, xs in cases.items() for x in xs]
    rng.shuffle(rows)
    got = {r["k"]: r for r in exact.totals(spark.createDataFrame(rows, "k string, value double").repartition(parts), ["k"]).collect()}
    for k, xs in cases.items():
        total = sum(map(Fraction, xs), Fraction(0))
        want = rounded(total)
        assert got[k]["n"] == len(xs)
        assert got[k]["sum"] == want or abs(got[k]["sum"] - want) <= math.ulp(want), k
        if math.isinf(want) or Fraction(want) == total:
            assert got[k]["sum"] == want, k
        mean = float(total / len(xs))
        assert math.isclose(got[k]["avg"], mean, rel_tol=4e-16, abs_tol=5e-324), k


def test_numbers_that_are_none(spark):
    nan, inf = math.nan, math.inf
    rows = [("a", inf), ("a", 1.0), ("b", inf), ("b", -inf), ("c", nan), ("c", 1.0), ("d", None), ("d", 2.0), ("e", None)]
    got = {r["k"]: (r["sum"], r["avg"], r["n"], r["rows"]) for r in exact.totals(spark.createDataFrame(rows, "k string, value double"), ["k"], rows=F.count(F.lit(1))).collect()}
    assert got["a"] == (inf, inf, 2, 2) and got["d"] == (2.0, 2.0, 1, 2) and got["e"] == (None, None, 0, 1)
    assert all(math.isnan(got[k][i]) for k in "bc" for i in (0, 1))


def test_aggregates_don_t_depend_on_order(spark):
    rows = [("m", {"s": str(i)}, f"{i}", 0, 0, x, False) for i, x in enumerate([1e16, 1.0, -1e16, 1e308, 1e308, -1e308, -1e308])]
    v = spark.createDataFrame(rows, "metric string, labels map<string,string>, lkey string, t long, src_ts long, value double, drop_name boolean")
    for some in (v.repartition(1), v.repartition(5), v.orderBy(F.desc("lkey"))):
        assert V.aggregate(some, "sum").first()["value"] == 1.0
        assert V.aggregate(some, "avg").first()["value"] == 1 / 7
    top = v.where("value = 1e308")
    assert V.aggregate(top, "sum").first()["value"] == math.inf and V.aggregate(top, "avg").first()["value"] == 1e308
