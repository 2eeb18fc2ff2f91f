"""Log analytics: summaries, field discovery, value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.model import attr_str
from telemark.operators.filters import LOGS, MOST_ROWS

#: Least level of each severity, from the highest down.
BANDS = ((21, "FATAL"), (17, "ERROR"), (13, "WARN"), (9, "INFO"), (5, "DEBUG"), (1, "TRACE"))
#: Rows of a request that names no limit.
TOP, MOST_FIELDS = 20, 100


def severity(level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for least, name in BANDS:
        out = out.when(level >= least, name)
    return out.otherwise("UNSPECIFIED")


def bucket_width(start_ns: int | None, end_ns: int | None) -> int:
    """A second at least, and 120 buckets at most; a minute without a window."""
    return 60 * 10**9 if start_ns is None or end_ns is None else max(10**9, (end_ns - start_ns) // 120)


def _bucket(width: int) -> Column:
    return (F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(width).cast("long"))).alias("bucket_ns")


def volume(logs: DataFrame, width: int) -> DataFrame:
    return logs.groupBy(_bucket(width)).agg(F.count(F.lit(1)).alias("count"))


def severity_timeline(logs: DataFrame, width: int) -> DataFrame:
    return logs.groupBy(_bucket(width), "log_level", severity(F.col("log_level")).alias("band")).agg(F.count(F.lit(1)).alias("count"))


def severity_distribution(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_level", severity(F.col("log_level")).alias("band")).agg(F.count(F.lit(1)).alias("count"))


def top(logs: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The most frequent values of a column."""
    return logs.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def service_severity(logs: DataFrame, k: int = TOP) -> DataFrame:
    """Records of each service by severity, and the share of errors; most errors first."""
    band = severity(F.col("log_level"))
    g = logs.groupBy("service_name").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(band == name).alias(name.lower()) for _, name in BANDS))
    errors = F.col("error") + F.col("fatal")
    return g.withColumns({"errors": errors, "error_ratio": errors / F.col("total")}).orderBy(F.desc("errors"), F.desc("total"), "service_name").limit(k)


def fields(logs: DataFrame, prefix: str = "", limit: int = MOST_FIELDS) -> DataFrame:
    """field, scope, count: the core columns that are filled, and the attributes of records and resources."""
    core = logs.agg(*(F.count_if(F.col(c).isNotNull() if c in LOGS.numbers else F.col(c) != "").alias(c) for c in ("log_stream", "service_name", "log_level", "severity_text", "trace_id", "span_id", "body")))
    named = core.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.lit("core").alias("scope"), F.col(c).alias("count")) for c in core.columns))))
    def keys_of(column: str, scope: str) -> Column:
        return F.transform(F.map_keys(column), lambda k: F.struct(k.alias("field"), F.lit(scope).alias("scope")))

    keys = F.concat(keys_of("attrs_str", "record"), keys_of("attrs_num", "record"), keys_of("res_str", "resource"), keys_of("res_num", "resource"))
    found = logs.select(F.explode(keys).alias("x")).groupBy("x.field", "x.scope").agg(F.count(F.lit(1)).alias("count"))
    return named.unionByName(found).where(F.col("field").startswith(prefix) & (F.col("count") > 0)).orderBy(F.desc("count"), "field", "scope").limit(limit)


def field_values(logs: DataFrame, field: str, condition: Column | None = None, prefix: str = "", limit: int = MOST_FIELDS) -> DataFrame:
    rows = logs if condition is None else logs.where(condition)
    value = LOGS.shown(field).cast("string")
    g = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return g.where((F.col("value") != "") & F.col("value").startswith(prefix)).orderBy(F.desc("count"), "value").limit(limit)


def attributes(logs: DataFrame, allowed: list[str] | None = None, resource: bool = True) -> DataFrame:
    """Records with one map of their attributes, numbers as text."""
    texts = lambda c: F.transform_values(c, lambda _, v: v.cast("string"))
    record = F.map_concat("attrs_str", F.map_filter(texts("attrs_num"), lambda k, _: ~F.map_contains_key(F.col("attrs_str"), k)))
    scope = F.map_concat("res_str", F.map_filter(texts("res_num"), lambda k, _: ~F.map_contains_key(F.col("res_str"), k)))
    merged = F.map_concat(record, F.map_filter(scope, lambda k, _: ~F.map_contains_key(record, k))) if resource else record
    kept = merged if allowed is None else F.map_filter(merged, lambda k, _: k.isin(*allowed))
    return logs.select("ts_ns", "log_stream", "service_name", "log_level", "body", kept.alias("attributes"))


def newest(logs: DataFrame, condition: Column | None = None, limit: int = MOST_ROWS) -> DataFrame:
    rows = logs if condition is None else logs.where(condition)
    return rows.orderBy(F.desc("ts_ns"), "trace_id").limit(limit)


def by_attribute(logs: DataFrame, key: str) -> DataFrame:
    return logs.groupBy(attr_str("attrs_str", key).alias("value")).agg(F.count(F.lit(1)).alias("count"))
