"""Ingestion by Structured Streaming: payloads to typed tables, and rollups with late data.

Each batch is written to all its tables from one cached set of payloads, into a folder named
by the batch, so a batch that is run again replaces its own files; the checkpoint moves on
only after all writes.

Beside the samples a batch writes what describes them: its streams with their least and
greatest time, the attributes of its spans with their kinds, and the events that summaries of
rate, errors and duration read in place of spans, with a sketch of the durations of each minute.  Readers merge these rows, which gives the
same whatever the batches; compact() puts those of many batches together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemark.operators import metrics as M
from telemark.operators import traces as T
from telemark.sources import otlp

DAY_MS = 86_400_000

Tables = dict[str, Callable[[DataFrame], DataFrame]]

METRIC_TABLES: Tables = {"gauges": otlp.gauges, "sums": otlp.sums, "histograms": otlp.histograms, "exponential_histograms": otlp.exponential_histograms, "exemplars": otlp.exemplars}
LOG_TABLES: Tables = {"logs": otlp.logs}
SPAN_TABLES: Tables = {"spans": otlp.spans}

#: For each table, further tables that a batch's rows of it make.
DESCRIBED: dict[str, Tables] = {
    "gauges": {"streams": lambda r: M.streams(r, "GAUGE", "ts_ms", "ts_ms")},
    "sums": {"streams": lambda r: M.streams(r, "SUM", "ts_start_ms", "ts_end_ms")},
    "histograms": {"streams": lambda r: M.streams(r, "HISTO", "ts_start_ms", "ts_end_ms")},
    "exponential_histograms": {"streams": lambda r: M.streams(r, "HISTO", "ts_start_ms", "ts_end_ms")},
    "spans": {"span_attributes": T.attribute_kinds, "red_events": T.red_events, "red_sketches": lambda r: T.red_sketches(r, ["service_name", "service_peer_name"])},
}
#: How rows of several batches become one set of rows.
MERGED: Tables = {"streams": M.merged_streams, "span_attributes": lambda r: r.select("attribute_name", "kind").distinct()}


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder, one payload a line."""
    return spark.readStream.format("text").load(path).withColumnRenamed("value", "payload")


def payload_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A Kafka topic; it needs the Kafka connector on the class path."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return source.load().select(F.col("value").cast("string").alias("payload"))


def _day(df: DataFrame) -> Column:
    for c, unit in (("ts_ms", DAY_MS), ("ts_end_ms", DAY_MS), ("ts_ns", DAY_MS * 1_000_000), ("ts_start_ns", DAY_MS * 1_000_000)):
        if c in df.columns:
            return F.floor(F.col(c) / unit).cast("long")
    raise ValueError("no time column")


def write_tables(tables: Tables, root: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        payloads = batch.select("payload").persist()
        try:
            for name, rows_of in tables.items():
                rows = rows_of(payloads)
                rows = rows.withColumn("p_day", _day(rows))
                rows.repartition("p_day", F.pmod(F.xxhash64(*[c for c in ("lkey", "trace_id", "log_stream") if c in rows.columns]), F.lit(16))).write.mode("overwrite").partitionBy("p_day").parquet(f"{root}/{name}/batch={batch_id}")
                for other, describe in DESCRIBED.get(name, {}).items():
                    more = describe(rows_of(payloads))
                    more = more.withColumn("p_day", _day(more)).repartition("p_day") if other not in MERGED else more
                    out = more.write.mode("overwrite")
                    (out.partitionBy("p_day") if other not in MERGED else out).parquet(f"{root}/{other}/batch={batch_id}/source={name}")
        finally:
            payloads.unpersist()

    return write


def ingest(payloads: DataFrame, tables: Tables, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write a stream of payloads to its tables; with `every` for good, without it all that is there."""
    writer = payloads.writeStream.foreachBatch(write_tables(tables, root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def table(spark: SparkSession, root: str, name: str, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """A table; the days are a partition, so that a window of days reads those alone."""
    rows = spark.read.parquet(f"{root}/{name}")
    rows = rows if first_day is None else rows.where(F.col("p_day") >= first_day)
    return rows if last_day is None else rows.where(F.col("p_day") <= last_day)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _described(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, int | None]:
    """The rows of the last compaction and of the batches after it; the last batch."""
    rows, packed = _read(spark, f"{root}/{name}"), _read(spark, f"{root}/{name}_compacted")
    if rows is None:
        raise ValueError(f"nothing was ingested to {root}/{name}")
    last = rows.agg(F.max("batch")).first()[0]
    rows = rows.drop("source")
    if packed is None:
        return rows.drop("batch"), last
    upto = packed.agg(F.max("upto")).first()[0]
    return packed.where(F.col("upto") == upto).drop("upto").unionByName(rows.where(F.col("batch") > upto).drop("batch")), last


def compact(spark: SparkSession, root: str, name: str) -> None:
    """Merge the rows of all batches so far; readers take the new rows in their place once they are all written."""
    rows, last = _described(spark, root, name)
    MERGED[name](rows).write.mode("overwrite").parquet(f"{root}/{name}_compacted/upto={last}")


def stream_index(spark: SparkSession, root: str) -> DataFrame:
    """The index that discovery works on, from what was kept at ingest: no sample is read."""
    return M.merged_streams(_described(spark, root, "streams")[0])


def attribute_catalog(spark: SparkSession, root: str) -> DataFrame:
    """attribute_name, attribute_type of all spans so far; a name seen with another kind in a later batch is mixed from then on."""
    return T.catalog_of(_described(spark, root, "span_attributes")[0])


def red_events(spark: SparkSession, root: str, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """What the summaries of rate, errors and duration read."""
    return table(spark, root, "red_events", first_day, last_day)


def red_sketches(spark: SparkSession, root: str, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    """Counts and sketches by service, peer and minute, for traces.red_merged()."""
    return table(spark, root, "red_sketches", first_day, last_day)


def red_rollup(spans: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """service_name, start, count, errors by minute, of a stream of spans; spans later than `late` are left out."""
    timed = spans.withColumn("at", F.timestamp_micros(F.floor(F.col("ts_start_ns") / 1000).cast("long"))).withWatermark("at", late)
    g = timed.groupBy(F.window("at", width).alias("w"), "service_name").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("span_status") == "ERROR").alias("errors"))
    return g.select("service_name", F.col("w.start").alias("start"), "count", "errors")
