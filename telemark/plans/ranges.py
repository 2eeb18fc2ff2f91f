"""The ranges of time that registered queries read: a fixed one, or all that the tables hold."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from telemark.sources import testbed as S

DAY = 86_400_000
#: events, then lineitem and orders: from 2024-01-03 to 2024-01-28, and the years 1996 to 2000.
FIXED = ((1_704_240_000_000, 1_706_400_000_000), (820_454_400_000, 978_307_200_000))
#: Whole days beyond the last row's: spans end a day later at most, and the last weekly step comes after them.
_AFTER_EVENTS, _AFTER_LINES = 1, 9


class Sql:
    """An SQL expression that stands in the place of a number while a statement is written."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def __add__(self, other) -> Sql:
        return Sql(f"({self} + {other})")

    def __sub__(self, other) -> Sql:
        return Sql(f"({self} - {other})")

    def __mul__(self, other) -> Sql:
        return Sql(f"({self} * {other})")

    def __floordiv__(self, other) -> Sql:
        return Sql(f"({self} // {other})")


def at_least(least: int, value):
    return Sql(f"greatest({least}, {value})") if isinstance(value, Sql) else max(least, value)


def _sql(column_of: dict[str, str], after: int) -> tuple[Sql, Sql]:
    rows = " UNION ALL ".join(f"SELECT min({c}) AS lo, max({c}) AS hi FROM {t}" for t, c in column_of.items())
    day = lambda x: f"CAST(floor(epoch_us({x}) / 86400000000) AS BIGINT)"
    return Sql(f"(SELECT coalesce({day('min(lo)')}, 0) * {DAY} FROM ({rows}))"), Sql(f"(SELECT (coalesce({day('max(hi)')}, 0) + {after}) * {DAY} FROM ({rows}))")


_EVENTS, _LINES = {"events": "ts"}, {"lineitem": "l_shipdate", "orders": "o_orderdate"}
WHOLE_SQL = (_sql(_EVENTS, _AFTER_EVENTS), _sql(_LINES, _AFTER_LINES))


def _of_tables(spark: SparkSession, sf_dir: str, column_of: dict[str, str], after: int) -> tuple[int, int]:
    """The plain columns' least and greatest value, as a file's own statistics have them."""
    ends = [S.table(spark, sf_dir, t).agg(F.min(c).alias("lo"), F.max(c).alias("hi")).select(*(F.unix_micros(F.col(x).cast("timestamp")) for x in ("lo", "hi"))).first() for t, c in column_of.items()]
    los, his = ([r[i] // (DAY * 1000) for r in ends if r[i] is not None] or [0] for i in (0, 1))
    return min(los) * DAY, (max(his) + after) * DAY


def whole(spark: SparkSession, sf_dir: str, events: bool = True, lines: bool = True) -> tuple[tuple[int, int], tuple[int, int]]:
    """From the first row's day to after the last row's, of events and of lineitem and orders; a range that isn't asked for is the fixed one."""
    return _of_tables(spark, sf_dir, _EVENTS, _AFTER_EVENTS) if events else FIXED[0], _of_tables(spark, sf_dir, _LINES, _AFTER_LINES) if lines else FIXED[1]


def asked(sql: str) -> dict[str, bool]:
    """Which of the ranges a statement over whole ones takes."""
    takes = lambda column_of: any(f"max({c}) AS hi" in sql for c in column_of.values())
    return {"events": takes(_EVENTS), "lines": takes(_LINES)}
