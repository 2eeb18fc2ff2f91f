"""Centroid clustering of vectors of 64 integers by bit planes.

Method: each component x becomes the integer floor(scale * x).  Bit j of all 64 components of a
vector is one 64-bit number, its plane j; as many planes are kept as the widest component of the
table needs, the last one counting negatively (two's complement).  The dot product of a vector
and a centroid is the sum, over all pairs of their planes, of the popcount of both planes' AND
times both planes' weights; so products, norms and squared distances are exact integers.  A
round assigns every vector to its nearest centroid (the smaller number on ties) and replaces
each centroid that has vectors by the floors of their componentwise means, whose sums are
popcounts by component.  A centroid without vectors stays.

The planes are written once to the shared folder.  A round sends the centroids to the tasks and
gets the sums back, `clusters` * 64 numbers, added up by Spark; no vector is shuffled, so it
doesn't matter how many are equal or in one cluster.  When a round changes no centroid, further
ones wouldn't either, and are left out.

The first centroids are the vectors with the smallest SHA-256 of "<seed>:<vec_id>".

Cases: vectors that are null, not of 64 components, or hold null or non-finite ones take no
part; rows that share an id or a vector all count; equal ids are taken in the order of their
vectors, null ids last; fewer vectors than clusters give as many centroids; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm._tables import Scratch
from telemark.llm._vectors import finite, floors, matrix

WIDTH = 64
#: Vectors that a task handles at a time.
CHUNK = 4096


class Lloyd(NamedTuple):
    scale: int = 1024
    clusters: int = 8
    rounds: int = 10
    seed: int = 3


def planes_of(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of 64 integers to rows of n planes: bit i of plane j is bit j of component i."""
    bits = (x[:, None, :] >> np.arange(n)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(n: int) -> np.ndarray:
    out = np.int64(1) << np.arange(n, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of planes with all others, by weighted popcounts."""
    w = weights(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for j, plane in enumerate(a.T):
        for k, other in enumerate(b.T):
            out += np.bitwise_count(plane[:, None] & other[None, :]).astype(np.int64) * (w[j] * w[k])
    return out


def norms(a: np.ndarray) -> np.ndarray:
    w = weights(a.shape[1])
    out = np.zeros(len(a), np.int64)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j]) * (w[j] * w[j])
        for k in range(j):
            out += np.bitwise_count(a[:, j] & a[:, k]) * (2 * w[j] * w[k])
    return out


def assigned(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector and the squared distance, both from planes."""
    distance = norms(vectors)[:, None] - 2 * dots(vectors, centroids) + norms(centroids)[None, :]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def sums_of(vectors: np.ndarray) -> np.ndarray:
    """Componentwise sums of the rows: how many have each bit, weighted."""
    n = vectors.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(vectors).view(np.uint8).reshape(len(vectors), n, 8), axis=2, bitorder="little")
    return (bits.sum(axis=0, dtype=np.int64) * weights(n)[:, None]).sum(axis=0)


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for first in range(0, len(whole), CHUNK):
            batch = whole.slice(first, CHUNK)
            yield batch, np.frombuffer(b"".join(batch.column("planes").to_pylist()), "<u8").reshape(-1, n)


def _pack(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), CHUNK):
                batch = whole.slice(first, CHUNK)
                planes = planes_of(matrix(batch.column("ints")), n)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p.tobytes() for p in planes], pa.binary())], names=["id", "planes"])

    return run


def _sums(n: int, centroids: np.ndarray):
    """One row for each cluster and component of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = planes_of(centroids, n)
        totals, counts = np.zeros((len(centroids), WIDTH), np.int64), np.zeros(len(centroids), np.int64)
        for _, vectors in _chunks(batches, n):
            best, _ = assigned(vectors, packed)
            for c in np.unique(best):
                totals[c] += sums_of(vectors[best == c])
            counts += np.bincount(best, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, WIDTH)), pa.array(np.tile(np.arange(WIDTH), len(used))), pa.array(totals[used].ravel()), pa.array(np.repeat(counts[used], WIDTH))], names=["cluster", "i", "total", "n"])

    return run


def _nearest(n: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = planes_of(centroids, n)
        for batch, vectors in _chunks(batches, n):
            best, distance = assigned(vectors, packed)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, how: Lloyd = Lloyd(), id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance of every vector, in a written table; the final centroids, a row each)."""
    scratch = Scratch(vectors.sparkSession, "clustering")
    rows = finite(vectors, id_col, vector_col).where(F.size("vector") == WIDTH).select("id", floors(F.col("vector"), how.scale).alias("ints"))
    wide = rows.agg(F.max(F.array_max("ints")), F.min(F.array_min("ints"))).first()
    first = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.col("id").cast("string")), 256)
    start = rows.orderBy(first.asc_nulls_last(), F.col("id").asc_nulls_last(), "ints").limit(how.clusters).select("ints").collect()
    centroids = np.array([r["ints"] for r in start], np.int64).reshape(-1, WIDTH)
    kind = dict(rows.dtypes)["id"]
    if not len(centroids):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    n = max(int(wide[0]).bit_length(), int(-wide[1] - 1).bit_length() if wide[1] < 0 else 0) + 1
    planes = scratch.write(rows.mapInArrow(_pack(n), f"id {kind}, planes binary"), "planes")
    for _ in range(how.rounds):
        part = planes.mapInArrow(_sums(n, centroids), "cluster long, i long, total long, n long")
        new = centroids.copy()
        for r in part.groupBy("cluster", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r["cluster"], r["i"]] = r["total"] // r["n"]
        if (new == centroids).all():
            break
        centroids = new
    return scratch.write(planes.mapInArrow(_nearest(n, centroids), f"id {kind}, cluster int, distance long"), "assigned"), centroids


def report(vectors: DataFrame, how: Lloyd = Lloyd(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector."""
    spark = vectors.sparkSession
    rows, centroids = cluster(vectors, how, id_col, vector_col)
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect()) if len(centroids) else {}  # a row for each cluster
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, sums[c], sum(sums.values()), marks[c]) for c in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(how: Lloyd = Lloyd()) -> str:
    """Rounds of joins with the centroids, component by component."""
    out = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({how.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
each AS MATERIALIZED (SELECT vec_id, unnest(range({WIDTH})) AS i, unnest(v) AS x FROM kept),
first AS (SELECT vec_id, v, row_number() OVER (ORDER BY sha256('{how.seed}:' || vec_id)) - 1 AS cluster FROM kept),
c0 AS MATERIALIZED (SELECT cluster, unnest(range({WIDTH})) AS i, unnest(v) AS x FROM first WHERE cluster < {how.clusters})"""
    for r in range(how.rounds + 1):
        out += f""",
d{r} AS MATERIALIZED (
  SELECT vec_id, cluster, d FROM (
    SELECT e.vec_id, c.cluster, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM each e JOIN c{r} c USING (i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)"""
        if r < how.rounds:
            out += f""",
m{r} AS (
  SELECT cluster, i, CAST(CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((count(*) - 1 - sum(x)) // count(*)) END AS BIGINT) AS x
  FROM each JOIN d{r} USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster, i))"""
    last = how.rounds
    return out + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, mark AS centroid_sha256
FROM d{last} JOIN (SELECT cluster, sha256(string_agg(x, ',' ORDER BY i)) AS mark FROM c{last} GROUP BY cluster) USING (cluster)"""


