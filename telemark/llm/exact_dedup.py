"""Exact dedup: of documents whose normalised texts are equal, one stays.

Method: a content sort.  Texts are normalised (A-Z lower-cased, null counts as empty), dealt
out by ranges whose splitters Spark samples, and sorted there, externally, by all their bytes,
so that equal texts are next to one another; neighbours are compared in full, and of each run
of equal ones the row with the largest id (`keep="largest"`) or the smallest stays.  Built from
DataFrame functions alone.

Splitters are the first `HEAD` characters and a hash of the text, so what is sampled is small
however long the texts are, and texts that begin alike are still dealt to many tasks; equal
texts have equal splitters.  Only whole texts are compared.

Skew: a text with more than `ROWS` rows or `BYTES` bytes, and more than a share of
1 / MOST_HOT of all of them, so one of 2 * MOST_HOT at most, gets a number of further
splitters from its rows' ids.  Its runs are put together afterwards by the SHA-256 of the text:
a broadcast of one row for each such text.

Cases: a null text equals an empty one; a null id comes after every other, so its row stays
only where no other has one; of repeated rows (same id, equal text) one stays; an empty table
gives no rows; other columns are ignored by report() and kept by keep_one(), whatever their
names.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.llm._tables import Scratch

HEAD = 32
MOST_HOT = 200_000
ROWS = 200
BYTES = 64 << 20


class Keep(NamedTuple):
    """How the rows of a run are ordered; the first one stays."""

    largest: bool = True

    def order(self, c: str) -> Column:
        return F.col(c).desc_nulls_last() if self.largest else F.col(c).asc_nulls_last()

    def best(self, c: str) -> Column:
        return F.max(c) if self.largest else F.min(c)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _salts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """mark, salts of the texts that very many rows share: 2 * MOST_HOT at most, as each has over 1 / MOST_HOT of all rows or bytes."""
    counts = scratch.write(texts.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "counts")
    n, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    rows, most = max(ROWS, n // MOST_HOT), max(BYTES, size // MOST_HOT)
    hot = counts.where((F.col("n") > 1) & ((F.col("n") > rows) | (F.col("bytes") > most)))
    return hot.select("mark", F.ceil(F.greatest(F.col("n") / rows, F.col("bytes") / most)).cast("int").alias("salts"))


def _runs(docs: DataFrame, keep: Keep, scratch: Scratch, id_col: str, text_col: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with their run's size and best id, place in the run and hot; for each hot text the sizes' sum and the best id)."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole else F.lit(None)
    # equal normalised texts have equal lower-case ones, and Spark's lower() is far faster than translate()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), own.alias("own"))
    rows = rows.withColumns({"mark": F.xxhash64(F.lower("text")), "head": normalised(F.substring("text", 1, HEAD))})
    hot = F.broadcast(_salts(rows.select("mark", F.octet_length("text").alias("size")), scratch))
    salt = F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    dealt = rows.join(hot, "mark", "left").withColumn("salt", salt).drop("salts").repartitionByRange("head", "mark", "salt")
    run = Window.partitionBy("head", "norm", "mark", "salt").orderBy(keep.order("id"))
    all_of_it = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = dealt.withColumn("norm", normalised(F.col("text"))).select(
        "id", "own", F.sha2("norm", 256).alias("sha"), (F.col("salt") >= 0).alias("hot"), F.row_number().over(run).alias("place"), F.count(F.lit(1)).over(all_of_it).alias("n"), F.first("id").over(all_of_it).alias("best")
    )
    out = scratch.write(out.where("place = 1") if whole else out, "runs")
    totals = out.where("hot and place = 1").groupBy("sha").agg(F.sum("n").alias("all_n"), keep.best("best").alias("all_best"))
    return out, F.broadcast(totals)


def report(docs: DataFrame, keep: Keep = Keep(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256: one row per document."""
    rows, totals = _runs(docs, keep, Scratch(docs.sparkSession, "exact"), id_col, text_col, whole=False)
    joined = rows.join(totals, "sha", "left")
    best = F.when(F.col("all_n").isNull(), F.col("best")).otherwise(F.col("all_best"))
    return joined.select(
        F.col("id").alias("doc_id"), best.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), ((F.col("place") == 1) & F.col("best").eqNullSafe(best)).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, keep: Keep = Keep(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    rows, totals = _runs(docs, keep, Scratch(docs.sparkSession, "exact"), id_col, text_col, whole=True)
    joined = rows.join(totals, "sha", "left").where(F.col("all_n").isNull() | F.col("best").eqNullSafe(F.col("all_best")))
    return joined.select("own.*")


def oracle_sql() -> str:
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM texts"""
