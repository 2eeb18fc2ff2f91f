"""All registered queries of the library with their SQL over the same tables.

A query that takes a range of time takes all of it: from the tables' own first day to their
last.  promql_sum_rate_range shows a range within them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telemark.plans import promql, ranges, structured

FLAGSHIP = "promql_sum_rate"
_MODULES = (promql, structured)
_FIXED, _WHOLE = ([m.build(*r) for m in _MODULES] for r in (ranges.FIXED, ranges.WHOLE_SQL))
#: Counts of the last hour, day and week: their ranges are the request.
_RELATIVE = {"overview"}


def _over_all(i: int, name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql = _WHOLE[i][1].get(name)
    which = ranges.asked(sql) if sql else {}
    return lambda spark, sf_dir: _MODULES[i].build(*ranges.whole(spark, sf_dir, **which))[0][name](spark, sf_dir)


def _takes_a_range(i: int, name: str) -> bool:
    fixed, whole = _FIXED[i][1].get(name), _WHOLE[i][1].get(name)
    return name not in _RELATIVE and (fixed is None or fixed != whole)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _over_all(i, name) if _takes_a_range(i, name) else f for i, (q, _) in enumerate(_FIXED) for name, f in q.items()}
    return out | {f"{FLAGSHIP}_range": _FIXED[0][0][FLAGSHIP]}


def oracle_sql() -> dict[str, str]:
    out = {name: _WHOLE[i][1][name] if _takes_a_range(i, name) else s for i, (_, sql) in enumerate(_FIXED) for name, s in sql.items()}
    return out | {f"{FLAGSHIP}_range": _FIXED[0][1][FLAGSHIP]}
