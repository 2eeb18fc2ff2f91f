"""MinHash near-dedup over an LSH forest.

Documents are linked where their sets of word shingles have a Jaccard similarity of at
least `similarity`; every link is confirmed on the full sets, and a component keeps its
smallest doc_id.

Method: each set has a signature of `trees * depth` minima.  A tree is one sorted order of
the signatures, read from the tree's own first minimum on (around the end); a region of a
tree is all signatures that agree on its first `depth` minima.  In the sorted order the
neighbours have the longest common prefixes: each set takes the next one of its region as
candidate, so that a crowded region is compared at whatever depth tells its members apart.
The orders are dealt out by range, so that a crowded region may span many tasks.

Candidates are confirmed in two steps: first, for each set, its `nearest` most frequent
neighbours; then every region that still holds several components is compared in full,
on the sets themselves.  That step runs in blocks of at most about `block` members and
`block_bytes` of sets; only members outside the region's largest component are sent to all of its blocks, regions
with the same members count once, and a block returns one link for each two components that
it joins, not all pairs.  So no cap drops a candidate; what can be missed is a pair at the
threshold that no tree brings together: (1 - 0.8 ** depth) ** trees, 3e-6 with the defaults,
and falling fast above it.

Equal sets are one node from the start, so copies are never compared.

Cases: null, empty and blank texts have an empty set and are linked with nothing; fewer
words than a shingle make one shingle of all; rows of a null doc_id take no part in links,
have no component and are kept; an empty table gives no rows; other columns are ignored by
links() and kept by keep_one().  Rows that share a doc_id are one document for links(), so
all that is near any of its texts is one component.  keep_one() tells such rows apart by
their texts (the second and further ones by a hash of id and text in place of the id), so a
text is dropped for a near copy alone; of equal rows one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telemark.llm import _text as K
from telemark.llm._components import components
from telemark.llm._tables import Scratch, keyed, map_batches

LEVELS = (10, 20, 40, 80)


class Forest(NamedTuple):
    shingle: int = 5
    similarity_percent: int = 80
    trees: int = 32
    depth: int = 5
    block: int = 512
    block_bytes: int = 16 << 20
    nearest: int = 2


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = K.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(block: K.Block, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles in ascending order, and the rows' offsets."""
    block = block._replace(data=K.lower_ascii(block.data))
    w = K.words(block, K.SPACED)
    roll = K.Roll(K.word_hashes(block, w))
    rows, count = len(block.offsets) - 1, np.diff(w.offsets)
    grams = roll.grams(shingle)
    row_of = np.repeat(np.arange(rows), count)
    at = np.flatnonzero(row_of[: len(grams)] == row_of[shingle - 1 : shingle - 1 + len(grams)])
    short = np.flatnonzero((count > 0) & (count < shingle))
    values = np.concatenate((grams[at], roll.between(w.offsets[short], w.offsets[short + 1])))
    owner = np.concatenate((row_of[at], short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        fresh = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
        values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(rows + 1))


def _signatures(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(forest.trees * forest.depth)
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                rows = batch.slice(block.first, len(block.offsets) - 1)
                values, offsets = shingle_sets(block, forest.shingle)
                size = np.diff(offsets)
                full = np.flatnonzero(size > 0)
                starts = offsets[:-1][full]
                sums = [np.zeros(len(size), np.uint64) for _ in range(2)]
                signature = np.zeros((len(size), len(a)), np.uint32)
                if len(full):
                    sums[0][full] = np.add.reduceat(K.mix(values), starts)
                    sums[1][full] = np.add.reduceat(K.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    high = (values >> np.uint64(32)).astype(np.uint32)
                    for k in range(len(a)):
                        v = high * a[k] + b[k]
                        v ^= v >> np.uint32(16)  # a linear function alone makes the minima too alike
                        v *= np.uint32(0x85EBCA6B)
                        signature[full, k] = np.minimum.reduceat(v, starts)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(size, pa.int64()), *(pa.array(x.view(np.int64)) for x in sums), pa.array([x.tobytes() for x in signature], pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "signature"])

    return run


def _paths(forest: Forest):
    """A row for each tree: the size of the set, the region and ever longer prefixes of the tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = forest.trees * forest.depth
        for whole in batches:
            for first in range(0, len(whole), 2000):
                batch = whole.slice(first, 2000)
                signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, n).astype(np.uint64)
                tree = np.arange(forest.trees)
                state = np.broadcast_to(K.mix((tree + 1).astype(np.uint64)), (len(signature), forest.trees))
                out = []
                for d in range(max(LEVELS)):
                    state = K.mix(state ^ (signature[:, (tree * forest.depth + d) % n] + np.uint64(d << 33)))
                    if d + 1 == forest.depth or (d + 1 in LEVELS and d + 1 > forest.depth):
                        out.append(pa.array(state.ravel().view(np.int64)))
                each = [pa.array(np.repeat(batch.column(c).to_numpy(), forest.trees)) for c in ("node", "n_shingles")]
                yield pa.RecordBatch.from_arrays([*each, *out], names=["node", "n_shingles", "region", *(f"p{x}" for x in LEVELS if x > forest.depth)])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in a tree's order: each with the next of its region."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        region, node = batch.column("region").to_numpy(), batch.column("node").to_numpy()
        if held is not None:
            region, node = np.append(held[0], region), np.append(held[1], node)
        held = region[-1], node[-1]
        at = np.flatnonzero((region[1:] == region[:-1]) & (node[1:] != node[:-1]))
        x, y = node[at], node[at + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _confirmed(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                rows = batch.slice(first, 256)
                sets = []
                for column in ("text_a", "text_b"):
                    of_row = []
                    for block in K.blocks(rows.column(column)):
                        values, offsets = shingle_sets(block, forest.shingle)
                        of_row += np.split(values, offsets[1:-1])
                    sets.append(of_row)
                linked = []
                for x, y in zip(*sets, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * common >= forest.similarity_percent * (len(x) + len(y) - common) and len(x) > 0)
                yield rows.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _sets(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                values, offsets = shingle_sets(block, forest.shingle)
                parts = [v.tobytes() for v in np.split(values, offsets[1:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(block.first, len(parts)), pa.array(parts, pa.binary())], names=["node", "shingles"])

    return run


def common_counts(guests: list[np.ndarray], members: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each guest the number of values that it has in common with each member, exactly."""
    sets = [*members, *guests]
    sizes = np.array([len(x) for x in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a value of one set alone is in no intersection
    column = (np.cumsum(shared) - 1)[column][keep] if (keep := shared[column]).any() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)[keep]
    width, offsets = int(shared.sum()), np.searchsorted(owner, np.arange(len(sets) + 1))
    if not width:
        yield from (np.zeros(len(members), np.int64) for _ in guests)
    elif width <= 1 << 16:  # bit maps
        bits = np.zeros((len(sets), -(-width // 64) * 8), np.uint8)
        for k in range(0, len(sets), 64):
            flags = np.zeros((min(64, len(sets) - k), bits.shape[1] * 8), bool)
            part = slice(offsets[k], offsets[min(k + 64, len(sets))])
            flags[owner[part] - k, column[part]] = True
            bits[k : k + 64] = np.packbits(flags, axis=1)
        words = bits.view(np.uint64)
        for g in range(len(members), len(sets)):
            yield np.bitwise_count(words[: len(members)] & words[g]).sum(axis=1, dtype=np.int64)
    else:
        of_members = column[: offsets[len(members)]]
        for g in range(len(members), len(sets)):
            mark = np.zeros(width + 1, bool)
            mark[column[offsets[g] : offsets[g + 1]]] = True
            yield np.diff(np.concatenate(([0], np.cumsum(mark[of_members])))[offsets[: len(members) + 1]])


def _joined_parts(forest: Forest):
    """Blocks of a region to confirmed links between components, one for each two that they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                sides = [batch.column(c).slice(r, 1).flatten() for c in ("guests", "members")]
                node, part = ([s.field(c).to_numpy().copy() for s in sides] for c in ("node", "component"))
                sets = [[np.frombuffer(x, np.uint64) for x in s.field("shingles").to_pylist()] for s in sides]
                size = np.array([len(x) for x in sets[1]])
                a, b = [], []
                for g, common in enumerate(common_counts(*sets)):
                    linked = np.flatnonzero((100 * common >= forest.similarity_percent * (size + len(sets[0][g]) - common)) & (part[1] != part[0][g]))
                    for c, k in zip(*np.unique(part[1][linked], return_index=True), strict=True):
                        a.append(min(node[0][g], node[1][linked[k]]))
                        b.append(max(node[0][g], node[1][linked[k]]))
                        for p in part:
                            p[p == c] = part[0][g]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _mixed_regions(members: DataFrame, parts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members with their components, regions that hold several components: of equal regions one)."""
    placed = scratch.write(members.select("region", "node", "n_shingles").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    counts = placed.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), F.min("node").alias("first"), F.max("node").alias("last"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
    mixed = counts.groupBy("region").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.sum("w").alias("weight"), F.max_by("component", F.struct("n", "component")).alias("main"), F.min("first").alias("a"), F.max("last").alias("b"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"))
    return placed, mixed.where("parts > 1").groupBy("size", "x", "y").agg(F.min(F.struct("region", "weight", "main", "a", "b")).alias("r")).select("size", "r.*")


def _region_links(placed: DataFrame, mixed: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    blocks = F.greatest(F.ceil(F.col("size") / forest.block), F.ceil(F.col("weight") * 8 / forest.block_bytes)).cast("int")
    rows = placed.join(mixed.select("region", "size", "main", blocks.alias("blocks")), "region").join(sets, "node")
    blocks = F.col("blocks")
    one = F.struct("node", "component", "shingles")
    member = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    guest = rows.where("component <> main").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members_of = member.groupBy("region", "block").agg(F.collect_list(one).alias("members"))
    guests_of = guest.groupBy("region", "block", "part").agg(F.collect_list(one).alias("guests"))
    return map_batches(guests_of.join(members_of, ["region", "block"]).select("guests", "members"), _joined_parts(forest), "a long, b long").distinct()


def links(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: one row per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = scratch.write(map_batches(texts, _signatures(forest), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, signature binary"), "signatures")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    equal = usable.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))  # equal sets, equal signatures
    classes = scratch.write(equal.select("set_a", "set_b", F.col("rep.doc_id").alias("node"), F.col("rep.text_key").alias("text_key"), "n_shingles", "signature"), "classes")
    signatures = classes.select("node", "n_shingles", "signature")

    # an id that has several sets ties their classes together
    one = F.struct("set_a", "set_b")
    several = usable.groupBy("doc_id").agg(F.min(one).alias("x"), F.max(one).alias("y")).where("x <> y").select("doc_id")
    ties = usable.join(several, "doc_id", "left_semi").join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    names = ["region", *(f"p{x}" for x in LEVELS if x > forest.depth)]
    paths = map_batches(signatures, _paths(forest), "node long, n_shingles long, " + ", ".join(f"{x} long" for x in names))
    crowded = scratch.write(paths.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region"), "crowded")
    members = scratch.write(paths.join(crowded, "region", "left_semi").select("node", "n_shingles", *names), "members")
    ordered = members.repartitionByRange(*names).sortWithinPartitions(*names, "node")
    pairs = scratch.write(map_batches(ordered, _neighbours, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes")), "pairs")

    wanted = members.select("node").distinct().join(classes.select("node", F.col("text_key").alias("rep_key")), "node")
    found = scratch.write(texts.join(wanted, (texts["doc_id"] == wanted["node"]) & (texts["text_key"] == wanted["rep_key"])).select("node", "text").dropDuplicates(["node", "text"]), "texts")

    def confirm(some: DataFrame, name: str) -> DataFrame:
        a, b = found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), found.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return scratch.write(map_batches(some.join(a, "a").join(b, "b"), _confirmed(forest), "a long, b long"), name)

    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes"))
    order = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
    best = ends.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= forest.nearest)
    tried = scratch.write(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    parts = scratch.write(components(confirm(tried, "links-1").unionByName(ties), scratch, "parts-1"), "parts")

    placed, mixed = _mixed_regions(members, parts, scratch)
    mixed = scratch.write(mixed, "mixed")
    larger = mixed.where("size = 2").join(tried, ["a", "b"], "left_anti").select(*mixed.columns).unionByName(mixed.where("size > 2"))
    wanted = placed.join(larger.select("region"), "region", "left_semi").select("node").distinct()
    sets = scratch.write(map_batches(found.join(wanted, "node", "left_semi"), _sets(forest), "node long, shingles binary"), "sets")
    more = scratch.write(_region_links(placed, larger, sets, forest), "links-2")

    # the second time only whole components are joined
    of_a, of_b = (parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    between = more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between, scratch, "parts-2").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    alone = joined.join(parts.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
    parts = parts.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(alone)

    for name in ("crowded", "members", "pairs", "texts", "tried", "placed", "mixed", "sets"):  # all that reads them is written
        scratch.drop(name)
    of_class = classes.join(parts, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "text_key", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", linked.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """The documents that are kept, with all their columns, and all rows without a doc_id."""
    row = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    texts = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    each = texts.groupBy("doc_id").agg(F.min("text_key").alias("x"), F.max("text_key").alias("y")).where("doc_id is not null and x <> y")
    each = Scratch(docs.sparkSession, "ids").write(each.select("doc_id", "x"), "several")  # of known size: where it is small, no text is shuffled for it
    own = F.when(F.col("x").isNull() | (F.col("text_key") == F.col("x")), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text_key", F.lit("near")))
    texts = texts.join(each, "doc_id", "left").select("row", own.alias("node"), "text_key", "text")
    found = links(texts.select(F.col("node").alias("doc_id"), "text"), forest).where("kept and doc_id is not null").select(F.col("doc_id").alias("node"), "text_key")
    known = texts.join(found, ["node", "text_key"], "left_semi").dropDuplicates(["node"])
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return known.select(*columns).unionByName(docs.where("doc_id is null"))
