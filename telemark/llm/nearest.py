"""Approximate nearest neighbours by cosine, with cross-polytope hashing.

Method: a pseudo-rotation is three rounds of random signs and a fast Hadamard transform; a
unit vector hashes to the signed axis nearest to the rotated vector.  A table concatenates
as many of these hashes (the last one over fewer axes) as make about one cell for each
`cell` vectors, by default about as many cells as a cell has vectors, whatever their number.  A
query probes the cells whose axes have the largest sum of coordinates, and its candidates of
all tables are ranked by their exact cosine on the original vectors.

How many cells a query probes follows from the data: of `calibration` queries (a fixed
bound) the true neighbours are found by comparison with all vectors, and the least number of
probes is taken at which the tables hold `recall` of them.  Vectors in clusters need a few
cells; vectors without any structure need a large part of them, as no index of cells can do
better there.  Queries that find too few candidates probe eight times as many cells, and
again, until they have enough or all cells were probed.

Skew: equal vectors are one candidate, and one query, from the start; only their smallest ids
come back at the end, so a vector that a third of all rows share costs one row.  A cell of
more than `block` vectors is dealt out in blocks; a query goes to all blocks of its cells.
Vectors and queries of a block meet in one sorted run; no pairs are emitted, but the nearest
few of each query and block.

The cosine is computed in double precision as the sum of products over both norms, always in
the same order of operations, so equal vectors get equal scores and ties go to the smaller id.
Equal vectors are recognised by 128 bits of hashes.

Cases: vectors that are null, zero, of another dimension than most, or hold null or
non-finite components take no part, nor do rows without an id; rows that share an id are one
candidate, by the nearest of them, and never their own query's; a query id with several vectors
is a query by each, of which the nearest results count; fewer candidates than k are all
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.llm._tables import Scratch


class Polytopes(NamedTuple):
    tables: int = 2
    cell: int | None = None  #: vectors of a cell; None: the square root of their number
    block: int = 8192
    recall: float = 0.95
    calibration: int = 100


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, width = x.shape[1], 1
    while width < n:
        x = x.reshape(len(x), -1, 2, width)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(-1, n)
        width *= 2
    return x


class Table(NamedTuple):
    """One hash table: its number and the axes that each of its hashes looks at."""

    number: int
    axes: tuple[int, ...]

    def coordinates(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each hash, the rows' rotated coordinates and their opposites, as unit vectors."""
        n = 1 << max(0, (x.shape[1] - 1).bit_length())
        y = np.zeros((len(x), n))
        y[:, : x.shape[1]] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        for i, axes in enumerate(self.axes):
            for signs in np.random.default_rng((self.number, i)).choice([-1.0, 1.0], (3, n)):
                y = _hadamard(y * signs) / np.sqrt(n)
            yield np.concatenate((y[:, :axes], -y[:, :axes]), axis=1)

    @property
    def cells(self) -> int:
        return int(np.prod([2 * a for a in self.axes], dtype=object)) if self.axes else 1

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for both in self.coordinates(x):
            out = out * both.shape[1] + both.argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """The cells of the largest sums, best first; the best prefixes are enough to extend."""
        rows = np.arange(len(x))[:, None]
        score, cells = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for both in self.coordinates(x):
            score = (score[:, :, None] + both[:, None, :]).reshape(len(x), -1)
            cells = (cells[:, :, None] * both.shape[1] + np.arange(both.shape[1])).reshape(len(x), -1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :most]
            score, cells = score[rows, best], cells[rows, best]
        return cells


def make_tables(vectors: int, dimension: int, p: Polytopes) -> list[Table]:
    """Tables of about vectors / cell cells."""
    n, axes, left = 1 << max(0, (dimension - 1).bit_length()), [], vectors / (p.cell or max(1.0, vectors**0.5))
    while left > 1:
        axes.append(min(n, 1 << max(0, int(np.ceil(np.log2(left / 2))))))
        left /= 2 * axes[-1]
    return [Table(t, tuple(axes)) for t in range(p.tables)]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A row for each vector, from lists or bytes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), kind) if pa.types.is_binary(column.type) else column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _placed(tables: list[Table], kind: str, most: int | None):
    """Rows id, cls, vector to one for each table and cell: their own, or the `most` best to probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = 1000 if most is None else max(1, min(1000, (1 << 16) // most))
            for first in range(0, len(whole), step):
                batch = whole.slice(first, step)
                x = _matrix(batch.column("vector"), kind)
                raw = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                for t in tables:
                    cells = t.cell_of(x)[:, None] if most is None else t.probes(x, most)
                    row = pa.array(np.repeat(np.arange(len(batch)), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t.number, np.int32)), pa.array(cells.ravel()), batch.column("id").take(row), batch.column("cls").take(row), raw.take(row)], names=["tab", "cell", "id", "cls", "vector"])

    return run


def nearest_in(queries: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of the k nearest different ids for each query, smaller ids first on ties."""
    norms = [np.sqrt((v * v).sum(axis=1)) for v in (queries, x)]
    rough = (queries @ x.T) / (norms[0][:, None] * norms[1])
    k_rows = min(len(x), k + len(ids) - len(np.unique(ids)))
    floor = np.partition(rough, len(x) - k_rows, axis=1)[:, len(x) - k_rows]
    q, c = np.nonzero(rough >= floor[:, None] - 1e-9)
    score = (queries[q] * x[c]).sum(axis=1) / (norms[0][q] * norms[1][c])
    order = np.lexsort((-score, ids[c], q))  # of rows with one id the nearest
    fresh = np.ones(len(order), bool)
    fresh[1:] = (q[order][1:] != q[order][:-1]) | (ids[c[order]][1:] != ids[c[order]][:-1])
    q, c, score = (v[order[fresh]] for v in (q, c, score))
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[near], c[near], score[near]


def _ranked(kind: str, k: int):
    """Runs of a block's vectors, then its queries (rows come sorted) to the k nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, members = None, [], None
        for whole in batches:
            for first in range(0, len(whole), 2000):
                batch = whole.slice(first, 2000)
                keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tab", "cell", "block", "is_query")], axis=1)
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                    if tuple(keys[a, :3]) != key:
                        key, held, members = tuple(keys[a, :3]), [], None
                    part = batch.slice(a, b - a)
                    ids, cls, x = part.column("id").to_numpy(), part.column("cls").to_numpy(), _matrix(part.column("vector"), kind)
                    if not keys[a, 3]:
                        held.append((ids, cls, x))
                        continue
                    if members is None and held:
                        members = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                        _, one = np.unique(np.column_stack((members[0], members[2])), axis=0, return_index=True) if len(np.unique(members[0])) < len(members[0]) else (None, slice(None))
                        members = tuple(c[one] for c in members)
                    for at in range(0, len(ids) if members else 0, 256):
                        q, c, score = nearest_in(x[at : at + 256], members[2], members[0], k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256][q]), pa.array(cls[at : at + 256][q]), pa.array(members[0][c]), pa.array(members[1][c]), pa.array(score)], names=["q_id", "q_cls", "id", "cls", "score"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector of the rows that take part: all of the most frequent dimension (the smallest on ties)."""
    simple = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if simple in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    inf = F.lit(float("inf"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < inf)) & F.exists("vector", lambda v: v != 0)
    rows = rows.where(fine)
    top = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (top[0]["n"] if top else -1))


def probes_needed(members: DataFrame, queries: DataFrame, tables: list[Table], kind: str, k: int, p: Polytopes) -> int:
    """The least number of probes with which the tables hold `recall` of the true neighbours of some queries."""
    sample = queries.orderBy(F.xxhash64("id", F.lit("calibration")), "id").limit(p.calibration).select("id", "vector").collect()
    ids = np.array([r["id"] for r in sample], np.int64)
    x = np.array([r["vector"] for r in sample], np.float64)
    if not len(ids):
        return 1
    shared = members.sparkSession.sparkContext.broadcast((ids, x))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, wanted = shared.value
        best: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, wanted.shape[1]))]
        for whole in batches:
            for first in range(0, len(whole), 2000):
                batch = whole.slice(first, 2000)
                there, v = batch.column("id").to_numpy(), _matrix(batch.column("vector"), kind)
                q, c, score = nearest_in(wanted, v, there, k + 1)
                other = there[c] != of[q]
                best = [np.concatenate(b) for b in zip(best, (q[other], there[c][other], score[other], v[c][other]), strict=True)]
                order = np.lexsort((best[1], -best[2], best[0]))
                best = [b[order] for b in best]
                keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
                best = [b[keep] for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2]), pa.array([v.tobytes() for v in best[3]], pa.binary())], names=["q", "id", "score", "vector"])

    near = members.select("id", "vector").mapInArrow(scan, "q long, id long, score double, vector binary")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "vector").collect()
    if not found:
        return 1
    q = np.array([r["q"] for r in found])
    v = np.frombuffer(b"".join(bytes(r["vector"]) for r in found), np.float64).reshape(len(found), -1)
    most = tables[0].cells
    ranks = np.full(len(found), most)
    for t in tables:
        own = t.cell_of(v)
        for one in np.unique(q):  # all cells of one query at a time
            mine = np.flatnonzero(q == one)
            rank = np.empty(most, np.int64)
            rank[t.probes(x[one : one + 1], most)[0]] = np.arange(1, most + 1)
            ranks[mine] = np.minimum(ranks[mine], rank[own[mine]])
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(p.recall * len(ranks))) - 1)])


def search(vectors: DataFrame, is_query: Column, k: int = 5, p: Polytopes = Polytopes(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; is_query is a condition on the column `id`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = usable(vectors, id_col, vector_col).withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit("second"), "vector")})
    kind = "<f4" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"

    # equal vectors: the smallest ids stand for all
    ids = rows.groupBy("h", "g", "id").agg(F.count(F.lit(1)).alias("n"))
    by_id = Window.partitionBy("h", "g").orderBy("id")
    first = ids.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    classes = first.groupBy("h", "g").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    classes = scratch.write(classes.select("h", "g", F.get("ids", F.lit(0)).alias("node"), "ids"), "classes")

    def one_each(some: DataFrame, of: DataFrame) -> DataFrame:
        """id, cls (0 for a vector of its own), vector: of equal vectors the row with the smallest id."""
        joined = some.join(of.select("h", "g", "node"), ["h", "g"], "left")
        cls = F.when(F.col("node").isNull(), F.lit(0).cast("long")).otherwise(F.col("h"))
        return joined.where("node is null or id = node").select("id", cls.alias("cls"), "vector")

    members = one_each(rows, classes)
    askers = rows.where(is_query)
    groups = scratch.write(askers.groupBy("h", "g").agg(F.min("id").alias("node"), F.count_distinct("id").alias("n")).where("n > 1").select("h", "g", "node"), "groups")
    queries = one_each(askers, groups)

    size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    tables = make_tables(size[0], size[1] or 1, p)
    fields = "tab int, cell long, id long, cls long, vector binary"
    placed = members.mapInArrow(_placed(tables, kind, None), fields)
    crowded = placed.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.block)
    crowded = scratch.write(crowded.select("tab", "cell", F.ceil(F.col("n") / p.block).cast("int").alias("blocks")), "crowded")

    def found(some: DataFrame, most: int) -> DataFrame:
        blocks = F.coalesce("blocks", F.lit(1))
        own = placed.join(crowded, ["tab", "cell"], "left").withColumns({"block": F.pmod(F.xxhash64("id"), blocks).cast("int"), "is_query": F.lit(0)})
        sent = some.mapInArrow(_placed(tables, kind, most), fields).join(crowded, ["tab", "cell"], "left").withColumns({"block": F.explode(F.sequence(F.lit(0), blocks - 1)), "is_query": F.lit(1)})
        key = ["tab", "cell", "block"]
        met = own.drop("blocks").unionByName(sent.drop("blocks")).repartition(*key).sortWithinPartitions(*key, "is_query", "id")
        near = met.mapInArrow(_ranked(kind, k + 1), "q_id long, q_cls long, id long, cls long, score double")
        best = near.groupBy("q_id", "q_cls", "id", "cls").agg(F.max("score").alias("score"))
        order = Window.partitionBy("q_id", "q_cls").orderBy(F.desc("score"), "id")
        return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)

    most = probes_needed(members, queries, tables, kind, k, p) if tables[0].cells > 1 else 1
    asked, parts, turn = queries, [], 0
    while True:
        part = scratch.write(found(asked, most), f"found-{turn}")
        if most >= tables[0].cells:
            parts.append(part)
            break
        full = part.where(F.col("r") == k + 1).select(F.col("q_id").alias("id"), F.col("q_cls").alias("cls"))
        parts.append(part.join(full.withColumnsRenamed({"id": "q_id", "cls": "q_cls"}), ["q_id", "q_cls"], "left_semi"))
        asked = scratch.write(asked.join(full, ["id", "cls"], "left_anti"), f"short-{turn}")
        if asked.isEmpty():
            break
        most, turn = min(8 * most, tables[0].cells), turn + 1
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)

    # back from the vectors to the ids that have them
    of_class = classes.select(F.col("node").alias("id"), F.col("h").alias("cls"), "ids")
    each = near.join(of_class, ["id", "cls"], "left").select("q_id", "q_cls", "score", F.explode(F.coalesce("ids", F.array("id"))).alias("vec_id"))
    who = askers.join(groups, ["h", "g"]).select(F.col("node").alias("q_id"), F.col("h").alias("q_cls"), F.col("id").alias("query_id")).distinct()
    several = each.join(who, ["q_id", "q_cls"], "left").select(F.coalesce("query_id", "q_id").alias("query_id"), "vec_id", "score")
    best = several.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
