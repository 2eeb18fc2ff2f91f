"""Conditions, projections and counts over logs and spans by field name.

A field is written as a user would: an alias (`service`, `level`, `duration`), a column, a
dotted attribute (`event.kind`), or an attribute of a scope (`resource['user']`).  Each
operator is a Column, so conditions combine with &, | and ~, and Catalyst pushes down what
the files can use.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.model import attr_num, attr_str, has_attr

#: Rows of a request that names no limit.
MOST_ROWS = 1000
_SCOPED = re.compile(r"(\w+)\[['\"](.+)['\"]\]")


class Fields(NamedTuple):
    """How a relation's fields are named."""

    aliases: dict[str, str]
    numbers: frozenset[str]
    defaults: tuple[str, ...]
    free_text: tuple[str, ...]
    time: str
    scopes: dict[str, tuple[str, str]]
    computed: dict[str, str] = {}

    def resolve(self, name: str) -> tuple[str, str]:
        """("column" or "computed", name) or (string map, "key")."""
        low = name.lower()
        if low in self.computed:
            return "computed", self.computed[low]
        if low in self.aliases:
            return "column", self.aliases[low]
        if m := _SCOPED.fullmatch(name):
            if m[1].lower() not in self.scopes:
                raise ValueError(f"no scope {m[1]!r} here")
            return self.scopes[m[1].lower()][0], m[2]
        return self.scopes["attributes"][0], name

    def number_map(self, strings: str) -> str:
        return next(n for s, n in self.scopes.values() if s == strings)

    def value(self, name: str, number: bool = False) -> Column:
        """A field to compare with a number or a text; an absent attribute is 0 or empty."""
        kind, key = self.resolve(name)
        if kind == "computed":
            return F.expr(key)
        if kind == "column":
            return F.col(key)
        return attr_num(self.number_map(kind), key) if number else attr_str(kind, key)

    def shown(self, name: str) -> Column:
        """A field for output: text if it is one, else the number as text, else empty."""
        kind, key = self.resolve(name)
        if kind in ("column", "computed"):
            return F.col(key) if kind == "column" else F.expr(key)
        return F.when(has_attr(kind, key), attr_str(kind, key)).when(has_attr(self.number_map(kind), key), attr_num(self.number_map(kind), key).cast("string")).otherwise(F.lit(""))


LOGS = Fields(
    aliases={
        **{c: c for c in ("ts_ns", "log_stream", "service_name", "log_level", "severity_text", "trace_id", "span_id", "body")},
        "ts": "ts_ns", "time": "ts_ns", "timestamp": "ts_ns", "stream": "log_stream", "service": "service_name", "message": "body", "content": "body", "trace": "trace_id", "span": "span_id", "level": "log_level", "severity": "log_level",
    },
    numbers=frozenset({"ts_ns", "log_level"}), defaults=("ts_ns", "log_stream", "service_name", "log_level", "body"), free_text=("body",), time="ts_ns",
    scopes={"attributes": ("attrs_str", "attrs_num"), "fields": ("attrs_str", "attrs_num"), "resource": ("res_str", "res_num"), "labels": ("res_str", "res_num")},
)

_SPAN_COLUMNS = (
    "ts_start_ns", "ts_end_ns", "trace_id", "span_id", "parent_span_id", "span_status", "kind", "service_name", "service_peer_name", "span_name", "http_method", "http_status_code", "http_request_size", "http_response_size", "http_origin", "http_host",
    "server_address", "server_port", "client_address", "client_port", "source_address", "source_port", "network_protocol_type", "network_protocol_version", "db_system", "db_collection_name", "db_namespace", "db_operation_name", "db_response_status_code",
    "db_query_text", "db_query_summary", "db_stored_procedure_name", "db_response_returned_rows", "rpc_method", "rpc_method_original", "rpc_response_status_code",
)

SPANS = Fields(
    aliases={
        **{c: c for c in _SPAN_COLUMNS},
        # fixed values: the other names by which a user knows the columns
        "ts": "ts_start_ns", "time": "ts_start_ns", "timestamp": "ts_start_ns", "start": "ts_start_ns", "start_time": "ts_start_ns", "ts_start": "ts_start_ns", "end": "ts_end_ns", "end_time": "ts_end_ns", "ts_end": "ts_end_ns",
        "trace": "trace_id", "span": "span_id", "parent": "parent_span_id", "status": "span_status", "kind_string": "kind", "service": "service_name", "peer": "service_peer_name", "service_peer": "service_peer_name", "peer_service": "service_peer_name", "name": "span_name",
        "http.method": "http_method", "http.request.method": "http_method", "http.status_code": "http_status_code", "http.response.status_code": "http_status_code", "status_code": "http_status_code",
        "http.host": "http_host", "http.request.header.host": "http_host", "http.origin": "http_origin",
        "db.system": "db_system", "db_system_name": "db_system", "db.collection": "db_collection_name", "db_collection": "db_collection_name", "db.collection.name": "db_collection_name", "db.namespace": "db_namespace",
        "db.operation": "db_operation_name", "db_operation": "db_operation_name", "db.operation.name": "db_operation_name", "db.query": "db_query_text", "db_query": "db_query_text", "db.query_summary": "db_query_summary",
        "rpc.method": "rpc_method", "rpc.status_code": "rpc_response_status_code", "rpc_status_code": "rpc_response_status_code", "network.protocol_type": "network_protocol_type", "network.protocol_version": "network_protocol_version",
    },
    numbers=frozenset(c for c in _SPAN_COLUMNS if c.endswith(("_ns", "_status_code", "_size", "_port", "_rows"))), defaults=_SPAN_COLUMNS,
    free_text=("service_name", "trace_id", "span_id", "span_name", "db_query_text", "rpc_method"), time="ts_start_ns", scopes={"attributes": ("attrs_str", "attrs_num"), "fields": ("attrs_str", "attrs_num")},
    computed={"duration": "(ts_end_ns - ts_start_ns)", "dur": "(ts_end_ns - ts_start_ns)", "duration_ns": "(ts_end_ns - ts_start_ns)"},
)

_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def where(f: Fields, name: str, op: str, *values) -> Column:
    """= != > >= < <= of one value; contains, !contains (case ignored), regex, !regex (anywhere), prefix, in, !in, exists, !exists.

    A level compared with a text means the severity's name.
    """
    if op in ("exists", "!exists"):
        there = exists(f, name)
        return ~there if op[0] == "!" else there
    if not values:
        raise ValueError(f"{op} needs a value")
    number = all(isinstance(v, int | float) and not isinstance(v, bool) for v in values)
    if name.lower() in ("level", "severity") and not number:
        name, values = "severity_text", tuple(str(v).upper() for v in values)
    c = f.value(name, number)
    if op in _COMPARE:
        if len(values) != 1:
            raise ValueError(f"{op} takes one value")
        return _COMPARE[op](c, F.lit(values[0]))
    text = c.cast("string")
    bare = op.lstrip("!")
    found = {"contains": lambda: F.contains(F.lower(text), F.lit(str(values[0]).lower())), "regex": lambda: text.rlike(str(values[0])), "prefix": lambda: text.startswith(str(values[0])), "in": lambda: c.isin(*values)}[bare]()
    return ~found if op[0] == "!" else found


def exists(f: Fields, name: str) -> Column:
    """An attribute of either kind; a text column that isn't empty; a number column that isn't null."""
    kind, key = f.resolve(name)
    if kind == "computed":
        return F.lit(True)
    if kind == "column":
        return F.col(key).isNotNull() if key in f.numbers else F.coalesce(F.col(key) != "", F.lit(False))
    return has_attr(kind, key) | has_attr(f.number_map(kind), key)


def text(f: Fields, words: str) -> Column:
    """Free text: contained in any of the relation's text fields."""
    out = F.lit(False)
    for c in f.free_text:
        out = out | F.contains(F.col(c), F.lit(words))
    return out


def within(f: Fields, start_ns: int, end_ns: int) -> Column:
    """Log records of [start, end]; spans that lie in it as a whole."""
    if f.time == "ts_ns":
        return F.col("ts_ns").between(start_ns, end_ns)
    return (F.col("ts_start_ns") >= start_ns) & (F.col("ts_end_ns") <= end_ns)


def column_name(field: str) -> str:
    return re.sub(r"\W+", "_", field).strip("_")


def find(df: DataFrame, f: Fields, condition: Column | None = None, fields: list[str] | None = None, remove: list[str] | None = None, sort: str | None = None, descending: bool = True, limit: int = MOST_ROWS) -> DataFrame:
    """The newest rows that meet the condition: chosen fields, or the default columns without some."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    rows = df if condition is None else df.where(condition)
    order = f.shown(sort) if sort else F.col(f.time)
    rows = rows.orderBy(order.desc() if descending else order.asc(), *(c for c in ("trace_id", "span_id") if c in df.columns)).limit(limit)
    if fields:
        return rows.select(*(f.shown(x).alias(column_name(x)) for x in fields))
    gone = {f.resolve(x)[1] for x in remove or []}
    return rows.select(*(c for c in f.defaults if c not in gone))


def count_by(df: DataFrame, f: Fields, fields: list[str], condition: Column | None = None, limit: int = MOST_ROWS) -> DataFrame:
    """Rows by the values of fields, most frequent first."""
    if not fields:
        raise ValueError("count by needs a field")
    rows = df if condition is None else df.where(condition)
    names = [column_name(x) for x in fields]
    g = rows.groupBy(*(f.shown(x).alias(n) for x, n in zip(fields, names, strict=True))).agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.desc("count"), *names).limit(limit)


def contributions(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many rows meet all conditions, and all but each of them, in one pass: condition ("" for all), rows."""
    met = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}

    def but(left_out: str | None) -> Column:
        out = F.lit(True)
        for n, c in met.items():
            out = out & c if n != left_out else out
        return F.count_if(out)

    names = [None, *met]
    counts = df.agg(F.array(*(F.struct(F.lit(n or "").alias("condition"), but(n).alias("rows")) for n in names)).alias("x"))
    return counts.select(F.inline("x"))
