"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.llm._tables import Scratch

#: A node with more than this share of all links is a hub, so there are fewer hubs than its inverse.
HUB_SHARE = 1 / 2000


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """The links with m, the least `b` of all links with the same `a`.

    Hubs' minima are partial aggregates that are broadcast, under 1 / HUB_SHARE rows by
    their definition, so that a hub's links stay where they are; all other links are
    shuffled by `a`.
    """
    hubs = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("m")).where(F.col("n") > total * HUB_SHARE)
    hubs = F.broadcast(hubs.select("a", "m"))
    rest = links.join(hubs, "a", "left_anti").withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return links.join(hubs, "a").select(*links.columns, "m").unionByName(rest)


def components(links: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for all nodes of the links a, b (any order).

    Each round hangs the larger neighbours of every node on its smallest one, then the
    smaller ones; the links end as stars around the components' smallest nodes, after
    about as many rounds as the logarithm of the longest path.  The links stay in a
    shared table between rounds, and only their number and a checksum reach the driver.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.write(links, f"{name}-0")
    total, mark = links.count(), None
    for k in range(1, most):
        if not total:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = scratch.write(large, f"{name}-{k}-large")
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = _with_least(large, total).select(F.explode(ends).alias("x")).select("x.*").where("a <> b").distinct()
        links = scratch.write(small, f"{name}-{k}")
        for done in (f"{name}-{k - 1}", f"{name}-{k}-large"):
            scratch.drop(done)
        now = tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == mark:
            break
        total, mark = now[0], now
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
