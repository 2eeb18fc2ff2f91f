"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here to a folder below the warehouse only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def _shuffles_go_at_once(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is run in here when it has ended, not whenever the driver forgets them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Parquet tables of one run, in a folder of its own: written once, read again, not computed again.

    A lost executor loses none of them.  Each is removed by drop(); what a
    returned DataFrame still reads stays until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self._root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._root}/{name}"
        with _shuffles_go_at_once(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
