"""The data model: samples, vectors, label keys, attribute access.

A *sample* relation holds raw points: metric, labels (map), lkey, ts_ms, value, is_stale.
A *vector* holds one row for each series and evaluation step: metric, labels, lkey, t,
src_ts, value, drop_name.  `lkey` is the canonical text of the labels: maps can't be joined
or compared, so series are matched by it, and the map is only carried along.  A derived
series keeps its metric name until materialize(), with drop_name set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = ["metric", "labels", "lkey", "ts_ms", "value", "is_stale"]
VECTOR = ["metric", "labels", "lkey", "t", "src_ts", "value", "drop_name"]

#: Labels that describe a metric, not a series; derived series lose them.
METADATA_LABELS = ("__type__", "__unit__")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label(labels: str | Column, name: str) -> Column:
    """A label's value; a missing label counts as the empty string."""
    return F.coalesce(F.get(F.map_values(F.map_filter(col(labels), lambda k, _: k == name)), F.lit(0)), F.lit(""))


def label_map(**labels: Column) -> Column:
    return F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), v.cast("string"))))


def label_key(labels: str | Column) -> Column:
    """Canonical text of a label map: keys in order, empty labels left out."""
    kept = F.map_filter(col(labels), lambda _, v: v != "")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def labels_of(key: str | Column) -> Column:
    """The label map of a canonical text.

    Aggregates carry the text alone: a map in an aggregate's buffer would force Spark to sort
    where it could hash.
    """
    return F.from_json(col(key), "map<string,string>")


def keep_labels(labels: str | Column, names: list[str]) -> Column:
    return F.map_filter(col(labels), lambda k, _: k.isin(*names) if names else F.lit(False))


def drop_labels(labels: str | Column, names: list[str]) -> Column:
    return F.map_filter(col(labels), lambda k, _: ~k.isin(*names) if names else F.lit(True))


def put_label(labels: str | Column, name: str, value: Column) -> Column:
    """The map with one label set; an empty value removes it."""
    rest = F.map_filter(col(labels), lambda k, _: k != name)
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def samples(df: DataFrame) -> DataFrame:
    """Fill in what a sample relation may leave out: lkey and is_stale."""
    if "lkey" not in df.columns:
        df = df.withColumn("lkey", label_key("labels"))
    if "is_stale" not in df.columns:
        df = df.withColumn("is_stale", F.lit(False))
    return df.select(*SAMPLE)


def attr_str(attributes: str | Column, key: str) -> Column:
    """A string attribute; absent counts as the empty string, as in comparisons with it."""
    return F.coalesce(F.try_element_at(col(attributes), F.lit(key)), F.lit(""))


def attr_num(attributes: str | Column, key: str) -> Column:
    """A numeric attribute; absent counts as 0."""
    return F.coalesce(F.try_element_at(col(attributes), F.lit(key)), F.lit(0.0))


def has_attr(attributes: str | Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(col(attributes), key), F.lit(False))


def materialize(vector: DataFrame) -> DataFrame:
    """The result of a query: dropped names gone, and an error where two series became one."""
    name = F.when(F.col("drop_name"), F.lit(None)).otherwise(F.col("metric"))
    out = vector.withColumn("metric", name)
    out = out.groupBy("metric", "lkey", "t").agg(F.first("src_ts").alias("src_ts"), F.first("value").alias("value"), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("vector cannot contain metrics with the same labelset: "), F.col("lkey")))).otherwise(F.col("value"))
    return out.select("metric", labels_of("lkey").alias("labels"), "lkey", "t", "src_ts", checked.cast("double").alias("value"))
