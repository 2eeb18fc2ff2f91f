"""Registered queries over metrics, logs and spans by request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.model import label
from telemark.operators import filters as Q
from telemark.operators import logs as L
from telemark.operators import metrics as M
from telemark.operators import sketches as K
from telemark.operators import traces as T
from telemark.operators.vectors import Matcher
from telemark.plans.ranges import at_least
from telemark.sources import testbed as S
from telemark.sources.testbed import with_views

DAY, NS = 86_400_000, 1_000_000


def build(events: tuple, lines: tuple) -> tuple[dict, dict[str, str]]:
    """Queries and SQL over the ranges of events and of lineitem and orders, in ms: two numbers each, or two Sql."""
    EVENTS, LINES = events, lines
    NOW = EVENTS[1]

    _QUERIES: dict = {}
    _SQL: dict[str, str] = {}


    def _query(name: str, sql: str | None = None):
        def keep(f):
            _QUERIES[name] = f
            if sql is not None:
                _SQL[name] = sql
            return f

        return keep


    def _gauges(spark: SparkSession, d: str) -> DataFrame:
        return S.gauges(spark, d).select("metric", F.col("labels").alias("tags"), "lkey", "ts_ms", "value", F.lit("ms").alias("unit"))


    def _index(spark: SparkSession, d: str) -> DataFrame:
        return M.stream_index(_gauges(spark, d), S.delta_sums(spark, d), S.histograms(spark, d))


    _BUCKET = "SELECT event_type, CAST(shard AS VARCHAR) AS shard, ts_ms - ts_ms % {0} AS bucket_ms, round({1}, 9) AS value FROM gauges WHERE ts_ms >= {2} AND ts_ms < {3} AND {4} GROUP BY ALL"
    _AGGS = {"AVG": "avg(value)", "SUM": "sum(value)", "MIN": "min(value)", "MAX": "max(value)", "COUNT": "count(value)::DOUBLE", "P50": "quantile_cont(value, 0.5)", "P95": "quantile_cont(value, 0.95)", "P99": "quantile_cont(value, 0.99)"}


    def _gauge(aggregation: str, resolution: str, tags: dict):
        def run(spark, d):
            g = M.gauge_buckets(_gauges(spark, d), "event_value", *EVENTS, aggregation, resolution, tags)
            return g.select(label("tags", "event_type").alias("event_type"), label("tags", "shard").alias("shard"), "bucket_ms", F.round("value", 9).alias("value"))

        return run


    for _name, _sql in _AGGS.items():
        _query(f"gauge_hourly_{_name.lower()}", with_views(_BUCKET.format(3_600_000, _sql, *EVENTS, "true"), "gauges"))(_gauge(_name, "HOURLY", {}))
    _query("gauge_minutely_tagged", with_views(_BUCKET.format(60_000, "avg(value)", *EVENTS, "event_type = 'click'"), "gauges"))(_gauge("AVG", "MINUTELY", {"event_type": "click"}))
    _query("gauge_secondly", with_views(_BUCKET.format(1_000, "max(value)", *EVENTS, "true"), "gauges"))(_gauge("MAX", "SECONDLY", {}))

    _OVERLAP = f"ts_start_ms < {LINES[1]} AND ts_end_ms > {LINES[0]}"


    @_query("sum_delta", with_views(f"SELECT returnflag, linestatus, min(ts_start_ms) AS ts_start_ms, max(ts_end_ms) AS ts_end_ms, round(sum(value), 2) AS value FROM delta_sums WHERE {_OVERLAP} GROUP BY returnflag, linestatus", "delta_sums"))
    def _(spark, d):
        s = M.sum_query(S.delta_sums(spark, d), "sales", *LINES)
        return s.select(label("tags", "returnflag").alias("returnflag"), label("tags", "linestatus").alias("linestatus"), "ts_start_ms", "ts_end_ms", F.round("value", 2).alias("value"))


    def _cumulative(spark, d) -> DataFrame:
        return S.counters(spark, d).select("metric", F.col("labels").alias("tags"), "lkey", (F.col("ts_ms") - 1).alias("ts_start_ms"), F.col("ts_ms").alias("ts_end_ms"), "value", F.lit("CUMULATIVE").alias("sums_type"), F.lit("1").alias("unit"))


    @_query("sum_cumulative", with_views(f"SELECT event_type, CAST(shard AS VARCHAR) AS shard, max(ts_ms) FILTER (WHERE value = m) AS ts_end_ms, max(value) AS value FROM (SELECT *, max(value) OVER (PARTITION BY event_type, shard) AS m FROM counters WHERE ts_ms - 1 < {EVENTS[1]} AND ts_ms > {EVENTS[0]}) GROUP BY event_type, shard", "counters"))
    def _(spark, d):
        s = M.sum_query(_cumulative(spark, d), "events_total", *EVENTS, temporality="CUMULATIVE")
        return s.select(label("tags", "event_type").alias("event_type"), label("tags", "shard").alias("shard"), "ts_end_ms", "value")


    @_query("sum_cumulative_to_delta", with_views("SELECT event_type, CAST(shard AS VARCHAR) AS shard, sum(CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END) AS value FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, shard ORDER BY ts_ms) AS p FROM counters) GROUP BY event_type, shard", "counters"))
    def _(spark, d):
        s = M.cumulative_to_delta(_cumulative(spark, d)).groupBy("lkey").agg(F.first("tags").alias("tags"), F.sum("value").alias("value"))
        return s.select(label("tags", "event_type").alias("event_type"), label("tags", "shard").alias("shard"), "value")


    @_query("sum_scan", with_views(f"SELECT event_type, CAST(shard AS VARCHAR) AS shard, ts_ms AS ts_end_ms, CASE WHEN deltas THEN 1.0 WHEN p IS NULL OR value < p THEN value ELSE value - p END AS value FROM (SELECT *, bool_or(shard = 0 AND ts_ms % 2 = 0) OVER (PARTITION BY event_type, shard) AS deltas, lag(value) OVER (PARTITION BY event_type, shard ORDER BY ts_ms) AS p FROM counters WHERE ts_ms - 1 < {EVENTS[1]} AND ts_ms > {EVENTS[0]}) WHERE NOT deltas OR ts_ms % 2 = 0", "counters"))
    def _(spark, d):
        totals = _cumulative(spark, d)
        deltas = totals.where((label("tags", "shard") == "0") & (F.col("ts_end_ms") % 2 == 0)).withColumns({"value": F.lit(1.0), "sums_type": F.lit("DELTA")})
        s = M.sum_scan(totals.unionByName(deltas), "events_total", *EVENTS)
        return s.select(label("tags", "event_type").alias("event_type"), label("tags", "shard").alias("shard"), "ts_end_ms", "value")


    _HISTO = f"FROM lineitem WHERE epoch_us(l_shipdate) // 1000 < {LINES[1]} AND epoch_us(l_shipdate) // 1000 + {DAY} > {LINES[0]}"


    @_query("histogram_merge", f"SELECT l_returnflag AS returnflag, i, count(*) FILTER (WHERE l_quantity > lo AND l_quantity <= hi) AS n, round(sum(l_quantity), 2) AS total {_HISTO.replace('FROM lineitem', 'FROM lineitem, (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest([-1e9, 10, 20, 30, 40]) AS lo, unnest([10, 20, 30, 40, 1e9]) AS hi)')} GROUP BY l_returnflag, i")
    def _(spark, d):
        h = M.histogram_merge(S.histograms(spark, d), "quantity", *LINES)
        return h.select(label("tags", "returnflag").alias("returnflag"), F.posexplode("counts").alias("i", "n"), F.round("sum", 2).alias("total"))


    @_query("histogram_rebin", f"SELECT l_returnflag AS returnflag, i, round(CASE i WHEN 0 THEN count(*) FILTER (WHERE l_quantity <= 20)::DOUBLE - 0 WHEN 1 THEN count(*) FILTER (WHERE l_quantity > 20 AND l_quantity <= 30) + count(*) FILTER (WHERE l_quantity > 30 AND l_quantity <= 40) / 2.0 ELSE count(*) FILTER (WHERE l_quantity > 30 AND l_quantity <= 40) / 2.0 + count(*) FILTER (WHERE l_quantity > 40) END, 6) AS n {_HISTO.replace('FROM lineitem', 'FROM lineitem, (SELECT unnest([0, 1, 2]) AS i)')} GROUP BY l_returnflag, i")
    def _(spark, d):
        h = M.rebin(M.histogram_merge(S.histograms(spark, d), "quantity", *LINES), [20.0, 35.0])
        return h.select(label("tags", "returnflag").alias("returnflag"), F.posexplode("counts").alias("i", "n")).withColumn("n", F.round("n", 6))


    _UNLIKE = {0: (10.0, 20.0, 30.0, 40.0), 1: (15.0, 30.0, 45.0)}
    _EDGES = " UNION ALL ".join(f"SELECT {odd} AS odd, unnest({list(b)}) AS b" for odd, b in _UNLIKE.items())


    @_query("histogram_merge_bounds", f"""WITH rows AS (SELECT l_returnflag AS rf, epoch_us(l_shipdate) // 86400000000 % 2 AS odd, l_quantity AS q {_HISTO}), edges AS ({_EDGES}),
points AS (SELECT rf, odd, b, count(*) FILTER (WHERE q <= b) AS c FROM rows JOIN edges USING (odd) GROUP BY ALL),
around AS (SELECT p.rf, p.odd, x, max(b) FILTER (WHERE b <= x) AS lo, min(b) FILTER (WHERE b >= x) AS hi, max(c) FILTER (WHERE b <= x) AS c_lo, min(c) FILTER (WHERE b >= x) AS c_hi FROM (SELECT DISTINCT rf, b AS x FROM points) AS u JOIN points AS p ON u.rf = p.rf GROUP BY ALL),
upto AS (SELECT rf, x, (sum(CAST(floor((CASE WHEN lo IS NULL THEN 0 WHEN hi IS NULL OR hi = lo THEN c_lo ELSE c_lo + (c_hi - c_lo) * (x - lo) / (hi - lo) END)::DOUBLE * 1048576 + 0.5) AS BIGINT)) + 524288) // 1048576 AS c FROM around GROUP BY rf, x)
SELECT rf AS returnflag, x AS bound, CAST(c - coalesce(lag(c) OVER (PARTITION BY rf ORDER BY x), 0) AS BIGINT) AS n FROM upto
UNION ALL SELECT rf, NULL, CAST((SELECT count(*) FROM rows WHERE rows.rf = upto.rf) - max(c) AS BIGINT) FROM upto GROUP BY rf""")
    def _(spark, d):
        parts = [S.histograms(spark, d, b).where(F.col("ts_start_ms") / DAY % 2 == odd) for odd, b in _UNLIKE.items()]
        h = M.merge_bounds(M.histogram_merge(parts[0].unionByName(parts[1]), "quantity", *LINES))
        return h.select(label("tags", "returnflag").alias("returnflag"), "buckets", F.posexplode("counts").alias("i", "n")).select("returnflag", F.get("buckets", F.col("i")).alias("bound"), "n")


    @_query("histogram_cumulative", "SELECT l_returnflag AS returnflag, arg_max(epoch_us(l_shipdate) // 1000, n * 1e13 - epoch_us(l_shipdate) // 1000) AS ts_start_ms, max(n) AS count FROM (SELECT l_returnflag, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL) " + f"WHERE epoch_us(l_shipdate) // 1000 < {LINES[1]} AND epoch_us(l_shipdate) // 1000 + {DAY} > {LINES[0]} GROUP BY l_returnflag")
    def _(spark, d):
        h = M.histogram_latest(S.histograms(spark, d).withColumn("histo_type", F.lit("CUMULATIVE")), "quantity", *LINES)
        return h.select(label("tags", "returnflag").alias("returnflag"), "ts_start_ms", "count")


    # --- discovery ----------------------------------------------------------------------------

    _ALL = (0, 2_000_000_000_000)
    _STREAMS = (
        "WITH streams AS (SELECT DISTINCT 'event_value' AS metric, 'gauge' AS type, 'ms' AS unit, MAP {'event_type': event_type, 'shard': CAST(user_id % 4 AS VARCHAR)} AS tags FROM events "
        "UNION ALL SELECT DISTINCT 'sales', 'counter', 'usd', MAP {'returnflag': l_returnflag, 'linestatus': l_linestatus} FROM lineitem "
        "UNION ALL SELECT DISTINCT 'quantity', 'histogram', '1', MAP {'returnflag': l_returnflag} FROM lineitem) "
    )


    @_query("metric_name_hints", _STREAMS + "SELECT DISTINCT metric FROM streams")
    def _(spark, d):
        return M.name_hints(_index(spark, d), *_ALL)


    @_query("metric_tag_hints", _STREAMS + "SELECT DISTINCT unnest(map_keys(tags)) AS tag FROM streams WHERE metric = 'sales'")
    def _(spark, d):
        return M.tag_hints(_index(spark, d), *_ALL, "sales")


    @_query("metric_tag_values", "SELECT DISTINCT l_returnflag AS value FROM lineitem WHERE l_linestatus = 'O'")
    def _(spark, d):
        return M.tag_value_hints(_index(spark, d), *_ALL, "sales", "returnflag", tags={"linestatus": "O"})


    @_query("metric_search", "SELECT DISTINCT 'event_value' AS metric, event_type, CAST(user_id % 4 AS VARCHAR) AS shard FROM events WHERE regexp_full_match(event_type, '.*i.*') AND user_id % 4 <> 3")
    def _(spark, d):
        found = M.search(_index(spark, d), *_ALL, name_pattern="event_.*", tag_patterns={"event_type": ".*i.*", "shard": "[0-2]"})
        return found.select("metric", F.get_json_object("lkey", "$.event_type").alias("event_type"), F.get_json_object("lkey", "$.shard").alias("shard"))


    @_query("metric_search_anywhere", "SELECT DISTINCT 'sales' AS metric, l_returnflag AS returnflag FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'R' UNION SELECT DISTINCT 'quantity', l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
    def _(spark, d):
        found = M.search(_index(spark, d), *_ALL, anywhere="R")
        return found.select("metric", F.get_json_object("lkey", "$.returnflag").alias("returnflag")).distinct()


    @_query("series_discovery", "SELECT DISTINCT event_type, CAST(user_id % 4 AS VARCHAR) AS shard, 'GAUGE' AS event_type_of FROM events WHERE user_id % 4 <> 0")
    def _(spark, d):
        found = M.series(_index(spark, d), *_ALL, "event_value", Matcher("shard", "!=", "0"), Matcher("__unit__", "=", "ms"))
        return found.select(label("labels", "event_type").alias("event_type"), label("labels", "shard").alias("shard"), F.col("event_type").alias("event_type_of"))


    @_query("metric_kinds", "SELECT 'event_value' AS metric, 'GAUGE' AS event_type, count(DISTINCT (event_type, user_id % 4)) AS series FROM events UNION ALL SELECT 'sales', 'SUM', count(DISTINCT (l_returnflag, l_linestatus)) FROM lineitem UNION ALL SELECT 'quantity', 'HISTO', count(DISTINCT l_returnflag) FROM lineitem")
    def _(spark, d):
        return M.kind_of(_index(spark, d)).groupBy("metric", "event_type").agg(F.count(F.lit(1)).alias("series"))


    @_query("label_names", _STREAMS + "SELECT DISTINCT unnest(map_keys(tags)) AS label FROM streams UNION SELECT '__name__' FROM streams")
    def _(spark, d):
        return M.label_names(_index(spark, d), *_ALL)


    @_query("label_values", "SELECT DISTINCT event_type AS value FROM events")
    def _(spark, d):
        return M.label_values(_index(spark, d), *_ALL, "event_type")


    @_query("metric_metadata", _STREAMS + "SELECT DISTINCT metric, type, unit FROM streams")
    def _(spark, d):
        return M.metadata(_index(spark, d), *_ALL)


    _RANGES = {"h1": 3_600_000, "d1": DAY, "d7": 7 * DAY}
    _COUNTS = ", ".join(f"count(*) FILTER (WHERE ts >= {NOW - w} AND ts < {NOW}) AS {r}" for r, w in _RANGES.items())


    @_query("overview", with_views(f"SELECT 'gauges' AS source, {_COUNTS} FROM (SELECT ts_ms AS ts FROM gauges) UNION ALL SELECT 'logs', {_COUNTS} FROM (SELECT ts_ns // 1000000 AS ts FROM logs) UNION ALL SELECT 'spans', {_COUNTS} FROM (SELECT ts_start_ns // 1000000 AS ts FROM spans)", "gauges", "logs", "spans"))
    def _(spark, d):
        to_ms = lambda c: F.floor(F.col(c) / 1_000_000)
        return M.overview({"gauges": (_gauges(spark, d), F.col("ts_ms")), "logs": (S.logs(spark, d), to_ms("ts_ns")), "spans": (S.spans(spark, d), to_ms("ts_start_ns"))}, NOW, _RANGES)


    # --- logs ---------------------------------------------------------------------------------

    _WINDOW = (EVENTS[0] * NS, EVENTS[1] * NS)
    _IN = f"ts_ns BETWEEN {_WINDOW[0]} AND {_WINDOW[1]}"
    _WIDTH = at_least(10**9, (_WINDOW[1] - _WINDOW[0]) // 120)
    _BAND = "CASE WHEN log_level >= 21 THEN 'FATAL' WHEN log_level >= 17 THEN 'ERROR' WHEN log_level >= 13 THEN 'WARN' WHEN log_level >= 9 THEN 'INFO' WHEN log_level >= 5 THEN 'DEBUG' WHEN log_level >= 1 THEN 'TRACE' ELSE 'UNSPECIFIED' END"


    def _logs(spark, d) -> DataFrame:
        return S.logs(spark, d).where(Q.within(Q.LOGS, *_WINDOW))


    @_query("logs_volume", with_views(f"SELECT ts_ns - ts_ns % {_WIDTH} AS bucket_ns, count(*) AS count FROM logs WHERE {_IN} GROUP BY 1", "logs"))
    def _(spark, d):
        return L.volume(_logs(spark, d), L.bucket_width(*_WINDOW))


    @_query("logs_severity_timeline", with_views(f"SELECT ts_ns - ts_ns % {_WIDTH} AS bucket_ns, log_level, {_BAND} AS band, count(*) AS count FROM logs WHERE {_IN} GROUP BY ALL", "logs"))
    def _(spark, d):
        return L.severity_timeline(_logs(spark, d), L.bucket_width(*_WINDOW))


    @_query("logs_severity", with_views(f"SELECT log_level, {_BAND} AS band, count(*) AS count FROM logs WHERE {_IN} GROUP BY ALL", "logs"))
    def _(spark, d):
        return L.severity_distribution(_logs(spark, d))


    @_query("logs_top_services", with_views(f"SELECT service_name AS value, count(*) AS count FROM logs WHERE {_IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "logs"))
    def _(spark, d):
        return L.top(_logs(spark, d), "service_name", 3)


    @_query("logs_top_streams", with_views(f"SELECT log_stream AS value, count(*) AS count FROM logs WHERE {_IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "logs"))
    def _(spark, d):
        return L.top(_logs(spark, d), "log_stream")


    @_query("logs_service_severity", with_views(f"SELECT service_name, count(*) AS total, {', '.join(f'count(*) FILTER (WHERE {_BAND} = {n!r}) AS {n.lower()}' for _, n in L.BANDS)}, count(*) FILTER (WHERE log_level >= 17) AS errors, round(count(*) FILTER (WHERE log_level >= 17) / count(*), 9) AS error_ratio FROM logs WHERE {_IN} GROUP BY service_name", "logs"))
    def _(spark, d):
        return L.service_severity(_logs(spark, d)).withColumn("error_ratio", F.round("error_ratio", 9))


    @_query("logs_fields", with_views(f"SELECT f AS field, s AS scope, n AS count FROM (SELECT unnest(['log_stream', 'service_name', 'log_level', 'severity_text', 'trace_id', 'span_id', 'body', 'line_id', 'event.kind', 'value', 'user']) AS f, unnest(['core', 'core', 'core', 'core', 'core', 'core', 'core', 'record', 'record', 'record', 'resource']) AS s, unnest([count(*), count(*), count(*), count(*), count(*), count(*), count(*), count(*), count(*), count(num_value), count(*)]) AS n FROM logs WHERE {_IN})", "logs"))
    def _(spark, d):
        return L.fields(_logs(spark, d))


    @_query("logs_field_values", with_views(f"SELECT event_kind AS value, count(*) AS count FROM logs WHERE {_IN} AND log_level >= 9 GROUP BY 1", "logs"))
    def _(spark, d):
        return L.field_values(_logs(spark, d), "event.kind", Q.where(Q.LOGS, "level", ">=", 9))


    @_query("logs_filter", with_views(f"SELECT ts_ns, service_name AS service, event_kind, res_user AS resource_user, round(num_value, 6) AS value FROM logs WHERE {_IN} AND (log_level >= 13 OR event_kind IN ('click', 'view')) AND NOT contains(lower(body), 'user 1') AND num_value > 100 AND regexp_matches(body, 'sent .*[02468]}}') ORDER BY ts_ns DESC, trace_id LIMIT 500", "logs"))
    def _(spark, d):
        f = Q.LOGS
        condition = (Q.where(f, "level", ">=", 13) | Q.where(f, "event.kind", "in", "click", "view")) & Q.where(f, "message", "!contains", "USER 1") & Q.where(f, "value", ">", 100) & Q.where(f, "body", "regex", "sent .*[02468]}")
        rows = Q.find(_logs(spark, d), f, condition, ["ts_ns", "service", "event.kind", "resource['user']", "value"], limit=500)
        return rows.withColumn("value", F.round(F.col("value").cast("double"), 6)).withColumn("ts_ns", F.col("ts_ns").cast("long"))


    @_query("logs_exists", with_views(f"SELECT service_name, severity_text, count(*) AS count FROM logs WHERE {_IN} AND num_value IS NOT NULL AND severity_text = 'WARN' GROUP BY ALL", "logs"))
    def _(spark, d):
        f = Q.LOGS
        condition = Q.where(f, "fields['value']", "exists") & Q.where(f, "level", "=", "warn") & Q.where(f, "nothing", "!exists") & Q.text(f, "sent")
        return Q.count_by(_logs(spark, d), f, ["service_name", "severity_text"], condition)


    @_query("logs_free_text", with_views(f"SELECT service_name, severity_text, count(*) AS count FROM logs WHERE {_IN} AND num_value IS NOT NULL AND severity_text = 'INFO' AND contains(body, 'sent') GROUP BY ALL", "logs"))
    def _(spark, d):
        f = Q.LOGS
        condition = Q.where(f, "fields['value']", "exists") & Q.where(f, "level", "=", "info") & Q.where(f, "nothing", "!exists") & Q.text(f, "sent")
        return Q.count_by(_logs(spark, d), f, ["service_name", "severity_text"], condition)


    @_query("logs_remove", with_views("SELECT ts_ns, service_name, log_level FROM logs ORDER BY log_level ASC, trace_id, span_id LIMIT 1000", "logs"))
    def _(spark, d):
        return Q.find(S.logs(spark, d), Q.LOGS, remove=["stream", "body"], sort="level", descending=False)


    @_query("logs_attributes", with_views(f"SELECT ts_ns, line_id, res_user AS user, coalesce(num_value::VARCHAR, '') AS value FROM logs WHERE {_IN} AND service_name = 'svc-click'", "logs"))
    def _(spark, d):
        rows = L.attributes(_logs(spark, d).where("service_name = 'svc-click'"), ["line_id", "user", "value"])
        return rows.select("ts_ns", *(label("attributes", k).alias(k) for k in ("line_id", "user", "value")))


    # --- spans --------------------------------------------------------------------------------

    _SPAN = (LINES[0] * NS, LINES[1] * NS)
    _SPAN_IN = f"ts_start_ns >= {_SPAN[0]} AND ts_end_ns <= {_SPAN[1]}"
    _RED = "count(*) AS count, count(*) FILTER (WHERE span_status = 'ERROR') AS errors, " + ", ".join(f"round(quantile_cont(CASE WHEN span_status = 'OK' AND ts_end_ns > ts_start_ns THEN ts_end_ns - ts_start_ns END, {q}), 3) AS p{round(q * 100)}" for q in (0.5, 0.75, 0.9, 0.99)) + ", round(count(*) / 3600, 9) AS rps, round(count(*) / 60, 9) AS rpm, round(count(*) FILTER (WHERE span_status = 'ERROR') / count(*), 9) AS error_rate"


    def _red(df: DataFrame) -> DataFrame:
        return df.withColumns({**{p: F.round(p, 3) for p in ("p50", "p75", "p90", "p99")}, **{c: F.round(c, 9) for c in ("rps", "rpm", "error_rate")}})


    def _spans(spark, d) -> DataFrame:
        return S.spans(spark, d)


    _HOUR = "ts_start_ns - ts_start_ns % 3600000000000 AS bucket_ns"


    @_query("red_service", with_views(f"SELECT service_name, {_HOUR}, {_RED} FROM spans WHERE {_SPAN_IN} GROUP BY ALL", "spans"))
    def _(spark, d):
        return _red(T.red(_spans(spark, d), ["service_name"], *_SPAN, "HOURLY"))


    @_query("red_service_sketch", with_views(f"SELECT service_name, count(*) AS count, count(*) FILTER (WHERE span_status = 'ERROR') AS errors, true AS within FROM spans WHERE {_SPAN_IN} GROUP BY 1", "spans"))
    def _(spark, d):
        rows = _spans(spark, d).where((F.col("ts_start_ns") >= _SPAN[0]) & (F.col("ts_end_ns") <= _SPAN[1]))
        kept = T.red_sketches(rows, ["service_name"], "HOURLY")
        whole = kept.groupBy("service_name").agg(F.sum("count").alias("count"), F.sum("errors").alias("errors"), K.merged(F.col("sketch")).alias("sketch"))
        levels = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
        read = K.quantiles(whole, levels)
        timed = rows.where("span_status = 'OK' AND ts_end_ns > ts_start_ns").select("service_name", (F.col("ts_end_ns") - F.col("ts_start_ns")).alias("v"))
        # the shares of durations below each quantile and up to it have its level between them, but for the sketch's error
        both = timed.join(read, "service_name").groupBy("service_name").agg(*(F.avg((F.col("v") < F.col(p)).cast("int")).alias(f"{p}_below") for p in levels), *(F.avg((F.col("v") <= F.col(p)).cast("int")).alias(f"{p}_upto") for p in levels))
        ok = F.lit(True)
        for p, q in levels.items():
            ok = ok & (F.col(f"{p}_below") - 3 * K.error() <= q) & (F.col(f"{p}_upto") + 3 * K.error() >= q)
        return read.join(both, "service_name", "left").select("service_name", "count", "errors", F.coalesce(ok, F.col("p50").isNull()).alias("within"))


    @_query("red_peer", with_views(f"SELECT service_name, service_peer_name, {_HOUR}, {_RED} FROM spans WHERE {_SPAN_IN} AND service_peer_name <> '' GROUP BY ALL", "spans"))
    def _(spark, d):
        return _red(T.red(_spans(spark, d).where("service_peer_name <> ''"), ["service_name", "service_peer_name"], *_SPAN, "HOURLY"))


    @_query("red_operations", with_views(f"SELECT span_name, {_HOUR}, {_RED} FROM spans WHERE {_SPAN_IN} AND service_name = 'orders' GROUP BY ALL", "spans"))
    def _(spark, d):
        return _red(T.red_operations(_spans(spark, d), "orders", *_SPAN, "HOURLY"))


    @_query("red_totals", with_views(f"SELECT service_name, count(*) AS count, count(*) FILTER (WHERE span_status = 'ERROR') AS errors, round(1 - count(*) FILTER (WHERE span_status = 'ERROR') / count(*), 9) AS availability FROM spans WHERE {_SPAN_IN} GROUP BY 1", "spans"))
    def _(spark, d):
        return T.red_totals(_spans(spark, d), ["service_name"], *_SPAN).withColumn("availability", F.round("availability", 9))


    @_query("operation_count", with_views(f"SELECT count(DISTINCT span_name) AS operations FROM spans WHERE {_SPAN_IN} AND service_name = 'orders' AND span_name <> ''", "spans"))
    def _(spark, d):
        return T.operation_count(_spans(spark, d), "orders", *_SPAN)


    @_query("service_list", with_views(f"SELECT DISTINCT service_name FROM spans WHERE {_SPAN_IN}", "spans"))
    def _(spark, d):
        return T.services(_spans(spark, d), *_SPAN)


    @_query("span_search", with_views("SELECT trace_id, span_id, ts_start_ns, service_name FROM spans WHERE service_name LIKE 'store-%' AND ts_end_ns - ts_start_ns >= 45000000 AND flag = 'R' AND tax = 0.05 ORDER BY ts_start_ns DESC, trace_id, span_id LIMIT 1000", "spans"))
    def _(spark, d):
        condition = T.matching(min_duration_ns=45_000_000, service_name="store-*", attributes={"flag": "R"}, numbers={"tax": 0.05})
        return T.search(_spans(spark, d), condition).select("trace_id", "span_id", "ts_start_ns", "service_name")


    @_query("span_count", with_views(f"SELECT count(*) AS spans FROM spans WHERE ts_start_ns >= {_SPAN[0]} AND ts_end_ns <= {_SPAN[1]} AND kind = 'SERVER' AND http_status_code = 500", "spans"))
    def _(spark, d):
        return T.count(_spans(spark, d), T.matching(*_SPAN, kind="SERVER", http_status_code=500))


    @_query("span_numeric_series", with_views("SELECT a AS attribute, ts_start_ns - ts_start_ns % 3600000000000 AS bucket_ns, round(avg(v), 9) AS value FROM (SELECT ts_start_ns, unnest(['total', 'tax', 'duration']) AS a, unnest([total, tax, (ts_end_ns - ts_start_ns)::DOUBLE]) AS v FROM spans) WHERE v IS NOT NULL GROUP BY ALL", "spans"))
    def _(spark, d):
        return T.numeric_series(_spans(spark, d), ["total", "tax", "duration"], "AVG", "HOURLY").withColumn("value", F.round("value", 9))


    @_query("span_distribution", with_views("SELECT a AS attribute, v AS value, count(*) AS spans FROM (SELECT unnest(['flag', 'priority', 'span_status']) AS a, unnest([flag, priority, span_status]) AS v FROM spans) WHERE v <> '' GROUP BY ALL", "spans"))
    def _(spark, d):
        return T.distribution(_spans(spark, d), ["flag", "priority", "span_status"])


    @_query("span_attribute_catalog", with_views("SELECT attribute_name, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS attribute_type FROM (SELECT unnest(['priority', 'flag', 'total', 'tax']) AS attribute_name, unnest(['string', 'string', 'number', 'number']) AS kind, unnest([nullif(priority, '') IS NOT NULL, nullif(flag, '') IS NOT NULL, total IS NOT NULL, tax IS NOT NULL]) AS there FROM spans) WHERE there GROUP BY attribute_name", "spans"))
    def _(spark, d):
        return T.attribute_catalog(_spans(spark, d))


    @_query("span_attribute_hints", with_views("SELECT unnest(['kind', 'service_name']) AS attribute_name UNION SELECT attribute_name FROM (SELECT unnest(['priority', 'flag', 'total', 'tax']) AS attribute_name, unnest([nullif(priority, '') IS NOT NULL, nullif(flag, '') IS NOT NULL, total IS NOT NULL, tax IS NOT NULL]) AS there FROM spans) WHERE there", "spans"))
    def _(spark, d):
        return T.attribute_hints(_spans(spark, d), ["kind", "service_name"])


    @_query("span_number_summary", with_views("SELECT round(avg(tax), 9) AS avg, round(quantile_cont(tax, 0.25), 9) AS p25, round(quantile_cont(tax, 0.5), 9) AS p50, round(quantile_cont(tax, 0.75), 9) AS p75, round(quantile_cont(tax, 0.9), 9) AS p90 FROM spans", "spans"))
    def _(spark, d):
        return T.number_summary(_spans(spark, d), "tax").select(*(F.round(c, 9).alias(c) for c in ("avg", "p25", "p50", "p75", "p90")))


    @_query("span_value_hints", with_views("SELECT DISTINCT priority AS value FROM spans WHERE priority <> ''", "spans"))
    def _(spark, d):
        return T.value_hints(_spans(spark, d), "priority")


    @_query("span_filter", with_views("SELECT service_name, span_status, count(*) AS count FROM spans WHERE ts_end_ns - ts_start_ns > 20000000 AND kind <> 'SERVER' AND flag IN ('R', 'A') AND tax IS NOT NULL AND NOT starts_with(service_name, 'store-4') GROUP BY ALL", "spans"))
    def _(spark, d):
        f = Q.SPANS
        condition = Q.where(f, "duration", ">", 20_000_000) & Q.where(f, "kind", "!=", "SERVER") & Q.where(f, "flag", "in", "R", "A") & Q.where(f, "tax", "exists") & Q.where(f, "service", "!prefix", "store-4")
        return Q.count_by(_spans(spark, d), f, ["service_name", "status"], condition).withColumnRenamed("status", "span_status")


    @_query("span_filter_typed", with_views("SELECT db_operation_name, db_namespace, http_host, rpc_method, count(*) AS count FROM spans WHERE (db_collection_name = 'lineitem' AND db_response_returned_rows >= 2) OR http_origin = 'shop-1' OR (rpc_response_status_code IS NOT NULL AND rpc_response_status_code <> 0 AND rpc_method <> 'Ship/R') GROUP BY ALL", "spans"))
    def _(spark, d):
        f = Q.SPANS
        stored = Q.where(f, "db.collection", "=", "lineitem") & Q.where(f, "db_response_returned_rows", ">=", 2)
        called = Q.where(f, "rpc.status_code", "exists") & Q.where(f, "rpc.status_code", "!=", 0) & Q.where(f, "rpc.method", "!=", "Ship/R")
        return Q.count_by(_spans(spark, d), f, ["db_operation_name", "db_namespace", "http_host", "rpc_method"], stored | Q.where(f, "http.origin", "=", "shop-1") | called)


    @_query("span_free_text", with_views("SELECT service_name, count(*) AS count FROM spans WHERE contains(service_name, 'line 3') OR contains(trace_id, 'line 3') OR contains(span_id, 'line 3') OR contains(span_name, 'line 3') OR contains(db_query_text, 'line 3') OR contains(rpc_method, 'line 3') GROUP BY 1", "spans"))
    def _(spark, d):
        return Q.count_by(_spans(spark, d), Q.SPANS, ["service_name"], Q.text(Q.SPANS, "line 3"))


    @_query("span_search_typed", with_views("SELECT trace_id, span_id, db_namespace, db_operation_name, db_query_text FROM spans WHERE db_namespace = 'ns-1' AND db_operation_name LIKE 'INS%' AND db_response_returned_rows = 2 ORDER BY ts_start_ns DESC, trace_id, span_id LIMIT 1000", "spans"))
    def _(spark, d):
        condition = T.matching(db_namespace="ns-1", db_operation_name="INS*", db_response_returned_rows=2)
        return T.search(_spans(spark, d), condition).select("trace_id", "span_id", "db_namespace", "db_operation_name", "db_query_text")


    @_query("span_contributions", with_views("SELECT unnest(['', 'slow', 'store', 'bad']) AS condition, unnest([count(*) FILTER (WHERE a AND b AND c), count(*) FILTER (WHERE b AND c), count(*) FILTER (WHERE a AND c), count(*) FILTER (WHERE a AND b)]) AS rows FROM (SELECT ts_end_ns - ts_start_ns > 30000000 AS a, starts_with(service_name, 'store-1') AS b, span_status = 'ERROR' AS c FROM spans)", "spans"))
    def _(spark, d):
        f = Q.SPANS
        return Q.contributions(_spans(spark, d), {"slow": Q.where(f, "duration", ">", 30_000_000), "store": Q.where(f, "service", "prefix", "store-1"), "bad": Q.where(f, "status", "=", "ERROR")})


    @_query("flame_graph", with_views("SELECT trace_id, span_id, parent_span_id, CASE WHEN parent_span_id = '' THEN 0 ELSE 1 END AS depth, ts_start_ns - min(ts_start_ns) OVER (PARTITION BY trace_id) AS offset_ns, greatest(0, ts_end_ns - ts_start_ns) AS duration_ns, row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY ts_start_ns, span_id) AS place FROM spans", "spans"))
    def _(spark, d):
        return T.flame_graph(_spans(spark, d))

    return _QUERIES, _SQL
