"""Vector codes: each part of a vector is replaced by the index of its nearest codebook entry.

Method: each component x becomes the integer floor(scale * x), and a vector is cut into `parts`
equal parts, whose positions have a codebook each.  The distinct parts of a position, with their
numbers of vectors, are sorted by their components: the leaves of a lexicographic trie, in
depth-first order.  An inner node is a prefix that some of them share, and holds the vector of
its squared distances to all entries over the dimensions so far; a child adds its own
dimension to its parent's.  A leaf takes the argmin (the lower index on ties) and adds its
components, times its number of vectors, to the entry's sums.  The traversal goes depth-first
in runs of `RUN` leaves, with one array operation for each depth of a run, and keeps the path's
accumulated vectors for the next run, so memory is bounded.

The distinct parts are dealt out by ranges, so that common prefixes meet in one task, and written
once to the shared folder.  A round sends the codebooks to the tasks (parts * entries *
components numbers) and gets as many sums back, added up by Spark; then each entry that has
parts becomes the floors of their means.  A round that changes nothing is the last.  A part that
very many vectors have is one leaf.  Codes come from the same traversal over the distinct parts
of each batch of vectors.

The first entries of every codebook are the parts of the vectors with the smallest ids.

Cases: vectors that are null, hold null or non-finite components, or have another number of
components than most (the smaller on ties) take no part; a number of components that `parts`
doesn't divide is an error; equal ids are taken in the order of their vectors, null ids last;
fewer vectors than entries give as many entries; rows without a label are one group; an empty
table gives no rows; other columns are ignored.
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

RUN = 4096
#: Labels whose sums are broadcast; with more, the sums are joined by a shuffle.
MOST_LABELS = 100_000


class Codes(NamedTuple):
    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6


class Trie:
    """Depth-first traversal of sorted distinct parts against one codebook (a row for each entry)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self._path: np.ndarray | None = None  # the last leaf, and the distances of each node on the way to it
        self._stack: list[np.ndarray] = []
        self.nodes = 0

    def run(self, leaves: np.ndarray) -> np.ndarray:
        """Distances of each of the leaves (distinct, in order, after those of the runs before) to all entries."""
        before = np.concatenate((leaves[:1] if self._path is None else self._path[None], leaves[:-1]))
        fresh = np.logical_or.accumulate(leaves != before, axis=1)
        if self._path is None:
            fresh[0] = True
        of = np.zeros(len(leaves), np.int64)  # each leaf's node of the depth so far; node 0 is the one on the path before
        sums, stack = np.zeros((1, len(self.entries)), np.int64), []
        for k in range(leaves.shape[1]):
            new = np.flatnonzero(fresh[:, k])
            step = leaves[new, k, None] - self.entries[None, :, k]
            on_path = self._stack[k][None] if self._stack else np.zeros((1, len(self.entries)), np.int64)
            sums = np.concatenate((on_path, sums[of[new]] + step * step))
            of = np.cumsum(fresh[:, k])
            stack.append(sums[of[-1]].copy())
            self.nodes += len(new)
        self._path, self._stack = leaves[-1].copy(), stack
        return sums[of]


def _summed(codebooks: np.ndarray):
    """Rows position, part, n in order to sums of each entry and component of a task's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, entries, width = codebooks.shape
        totals, counts = np.zeros((positions, entries, width), np.int64), np.zeros((positions, entries), np.int64)
        for whole in batches:
            at = whole.column("position").to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(whole)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                p, trie = int(at[a]), Trie(codebooks[at[a]])
                for first in range(a, b, RUN):
                    some = whole.slice(first, min(RUN, b - first))
                    leaves, n = matrix(some.column("part")), some.column("n").to_numpy()
                    best = trie.run(leaves).argmin(axis=1)
                    for e in np.unique(best):
                        mine = best == e
                        totals[p, e] += (leaves[mine] * n[mine, None]).sum(axis=0)
                        counts[p, e] += n[mine].sum()
        p, e = np.nonzero(counts)
        columns = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), totals[p, e].ravel(), np.repeat(counts[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["position", "entry", "i", "total", "n"])

    return run


def _coded(codebooks: np.ndarray):
    """Rows id, x0, ints to id, x0, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, _, width = codebooks.shape
        for whole in batches:
            for first in range(0, len(whole), RUN):
                batch = whole.slice(first, RUN)
                x = matrix(batch.column("ints"))
                codes, error = np.zeros((len(x), positions), np.uint8), np.zeros(len(x), np.int64)
                for p in range(positions):
                    leaves, of = np.unique(x[:, p * width : (p + 1) * width], axis=0, return_inverse=True)
                    distance = Trie(codebooks[p]).run(leaves)
                    codes[:, p] = distance.argmin(axis=1)[of.ravel()]
                    error += distance.min(axis=1)[of.ravel()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x0"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["id", "x0", "code", "error"])

    return run


def learn(rows: DataFrame, width: int, how: Codes, scratch: Scratch) -> np.ndarray:
    """Codebooks (position, entry, component) of rows id, ints; width is that of a part."""
    start = rows.orderBy(F.col("id").asc_nulls_last(), "ints").limit(how.entries).select("ints").collect()
    codebooks = np.array([r["ints"] for r in start], np.int64).reshape(len(start), how.parts, width).transpose(1, 0, 2)
    cut = F.array(*[F.slice("ints", p * width + 1, width) for p in range(how.parts)])
    parts = rows.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    leaves = scratch.write(parts.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "leaves")
    for _ in range(how.rounds):
        sums = leaves.mapInArrow(_summed(codebooks), "position long, entry long, i long, total long, n long")
        new = codebooks.copy()
        for r in sums.groupBy("position", "entry", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r["position"], r["entry"], r["i"]] = r["total"] // r["n"]
        if (new == codebooks).all():
            break
        codebooks = new
    scratch.drop("leaves")
    return codebooks


def encode(vectors: DataFrame, how: Codes = Codes(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, x0 (the label), code, error of every vector, in a written table; the codebooks)."""
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = finite(vectors, id_col, vector_col, label_col)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    if size % how.parts:
        raise ValueError(f"{size} components can't be cut into {how.parts} equal parts")
    rows = rows.where(F.size("vector") == size).select("id", "x0", floors(F.col("vector"), how.scale).alias("ints"))
    if not size:
        return rows.limit(0).select("id", "x0", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((how.parts, 0, 0), np.int64)
    rows = scratch.write(rows, "ints")
    codebooks = learn(rows, size // how.parts, how, scratch)
    types = dict(rows.dtypes)
    return scratch.write(rows.mapInArrow(_coded(codebooks), f"id {types['id']}, x0 {types['x0']}, code string, error long"), "coded"), codebooks


def report(vectors: DataFrame, how: Codes = Codes(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per vector."""
    rows, codebooks = encode(vectors, how, id_col, vector_col, label_col)
    mark = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    totals = Scratch(vectors.sparkSession, "codes").write(rows.groupBy("x0").agg(F.sum("error").alias("label_error")), "labels")
    totals = F.broadcast(totals) if totals.count() <= MOST_LABELS else totals
    joined = rows.join(totals, rows["x0"].eqNullSafe(totals["x0"]))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(mark).alias("codebooks_sha256"))


def oracle_sql(how: Codes = Codes(), size: int = 64) -> str:
    """Rounds of joins with the codebooks, component by component."""
    width = size // how.parts
    out = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({how.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
flat AS (SELECT vec_id, unnest(range({size})) AS k, unnest(v) AS x FROM kept),
each AS MATERIALIZED (SELECT vec_id, k // {width} AS p, k % {width} AS i, x FROM flat),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept),
c0 AS MATERIALIZED (SELECT p, e, i, x FROM each JOIN first USING (vec_id) WHERE e < {how.entries})"""
    for r in range(how.rounds + 1):
        out += f""",
d{r} AS MATERIALIZED (
  SELECT vec_id, p, e, d FROM (
    SELECT a.vec_id, a.p, c.e, CAST(sum((a.x - c.x) * (a.x - c.x)) AS BIGINT) AS d FROM each a JOIN c{r} c USING (p, i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
        if r < how.rounds:
            out += f""",
m{r} AS (
  SELECT p, e, i, CAST(CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((count(*) - 1 - sum(x)) // count(*)) END AS BIGINT) AS x
  FROM each JOIN d{r} USING (vec_id, p) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (p, e, i))"""
    last = how.rounds
    return out + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{last} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) FROM c{last}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
