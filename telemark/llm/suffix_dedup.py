"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere are removed.

Method: column-wise construction of the Burrows-Wheeler transform of a collection of
strings, with its common prefixes.  Round j inserts the symbol before each string's
suffix of length j; the transform and the prefix lengths lie in sequential files that each
round reads once and writes anew.  When all symbols are in, a string that starts at a
suffix occurs twice exactly where the common prefix with a neighbour is long enough.

Spark deals out the collection: each window of `length` bytes goes to its least gram of
`anchor` bytes, so equal windows have equal anchors at equal places; consecutive windows
of one anchor form one stretch.  Anchors that occur once hold no repeat and end there.
Equal stretches are aggregated to one row with their number; only stretches that differ
around one anchor need a transform.  Whole anchor groups are gathered to collections of
some thousand strings, sorted runs of one partition (the sequential files are temporary
ones of the task, made again with it); within a group the anchor counts as
one symbol, as all its strings agree on it, so there are at most 2 * (length - anchor) + 1
rounds whatever the length of the texts.

An anchor with more than `group_limit` different stretches doesn't go through the transform,
whose collection it would outgrow: its windows are dealt out by hashes of their 200 bytes, so
that no task holds them all, with the same result.

Cases: null and empty texts have no bytes and the digest of the empty string; texts under
the length are never cut; repeated rows repeat each other's bytes and are all cut; an empty
table gives no rows; other columns are ignored; doc_id may be null.  Stretches are compared
by a 64-bit hash of their bytes (and their anchors' marks) where they are equal as a whole, by
their symbols otherwise (but for anchors over the limit, see above).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm import _text as K
from telemark.llm._tables import Scratch, keyed, same_row

LENGTH = 200
ANCHOR = 100
GROUP_LIMIT = 50_000
COLLECTION = 1_000
SEGMENT = 1 << 18
_SHIFT = 19  # bits of a place in a segment, and of one mark

_SEEDS = "doc_id long, text_key long, anchor long, body long, first int, windows int, before int"
_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _seeds(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                rows = batch.slice(block.first, len(block.offsets) - 1)
                s = K.stretches(K.ByteMarks(block.data), block.offsets, length, anchor)
                body = K.byte_hashes(block.data.tobytes(), s.start, s.start + s.windows - 1 + length)
                row = pa.array(s.row)
                ints = [s.start - block.offsets[s.row], s.windows, s.anchor - s.start]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(row), rows.column("text_key").take(row), pa.array(s.key.view(np.int64)), pa.array(body.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in ints)], names=["doc_id", "text_key", "anchor", "body", "first", "windows", "before"])

    return run


def _fetch(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for batch in batches:
        for block in K.blocks(batch.column("text")):
            rows = batch.slice(block.first, len(block.offsets) - 1)
            wanted = rows.column("wanted")
            of = np.repeat(np.arange(len(rows)), np.diff(wanted.offsets.to_numpy()))
            items = wanted.flatten()
            at = block.offsets[of] + items.field("first").to_numpy().astype(np.int64)
            to = at + items.field("windows").to_numpy().astype(np.int64) - 1 + length
            data = block.data.tobytes()
            cut = [data[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(items.field(c) for c in ("anchor", "body", "copies", "windows", "before")), pa.array(cut, pa.binary())], names=["anchor", "body", "copies", "windows", "before", "content"])


class _Column:
    """An array in a sequential file: read from front to back, replaced by its successor."""

    def __init__(self, kind: type, values: np.ndarray):
        self.kind, self.n = kind, len(values)
        self.file, self.next = tempfile.TemporaryFile(buffering=0), tempfile.TemporaryFile(buffering=0)
        self.file.write(values.astype(kind).tobytes())
        self.rewind()

    def rewind(self) -> None:
        self.file.seek(0)

    def read(self, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read(n * np.dtype(self.kind).itemsize), self.kind)

    def write(self, values: np.ndarray) -> None:
        self.next.write(values.tobytes())

    def turn(self) -> None:
        self.file, self.next = self.next, self.file
        self.n = self.file.tell() // np.dtype(self.kind).itemsize
        self.next.seek(0)
        self.next.truncate()
        self.rewind()

    def close(self) -> None:
        self.file.close()
        self.next.close()


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] for each query, both ends included."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1  # floor of the binary logarithm
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def _scan(bwt: _Column, lcp: _Column, rows: np.ndarray, counts: np.ndarray, strings: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the next suffixes go (rows are those of their tails, ascending), and the common prefixes that change."""
    base = strings + np.concatenate(([0], np.cumsum(counts[1:])))
    base = np.concatenate(([0], base[:-1]))  # of symbol c: rows whose first symbol is smaller
    assert segment <= 1 << (_SHIFT - 1)
    short = np.uint32 if len(counts) <= 1 << (32 - _SHIFT) else np.uint64
    one, shifts = short(1), short(_SHIFT)
    seen = np.zeros(len(counts), np.int64)
    since = np.full(len(counts), 255, np.uint8)  # least prefix since the symbol's last row
    fresh = np.zeros(len(counts), bool)  # whether that row is one of ours
    places = np.empty(len(rows), np.int64)
    at, value = [], []
    bwt.rewind()
    lcp.rewind()
    for start in range(0, bwt.n, segment):
        b, prefix = bwt.read(segment), lcp.read(segment)
        lo, hi = np.searchsorted(rows, [start, start + len(b)])
        # symbol, place and whether the row is ours in one number, so that one plain sort gives the stable order
        packed = b.astype(short) << shifts
        packed |= np.arange(0, 2 * len(b), 2, dtype=short)
        packed[rows[lo:hi] - start] |= one
        packed.sort()
        symbol_at = lambda x: (packed[x] >> shifts).astype(np.int64)
        row_at = lambda x: ((packed[x] & ((one << shifts) - one)) >> one).astype(np.int64)
        edges = np.searchsorted(packed, np.arange(len(counts), dtype=short) << shifts)
        sizes = np.diff(np.append(edges, len(b)))
        symbols = np.flatnonzero(sizes)
        begins, sizes = edges[symbols], sizes[symbols]
        shift = np.zeros(len(counts), np.int64)  # from a row's place in this order to that of its next suffix
        shift[symbols] = base[symbols] + seen[symbols] - begins
        ours = np.flatnonzero((packed & one).astype(bool))
        places[lo + np.searchsorted(rows[lo:hi], row_at(ours) + start)] = ours + shift[symbol_at(ours)]
        # the prefixes of the rows after ours change as well
        behind_ours = ours[ours + 1 < len(b)] + 1
        behind_ours = behind_ours[symbol_at(behind_ours) == symbol_at(behind_ours - 1)]
        asked = np.unique(np.concatenate((ours, behind_ours, begins[fresh[symbols]])))
        s = symbol_at(asked)
        asked, s = asked[s > 0], s[s > 0]
        first = asked == edges[s]
        inner, outer = asked[~first], asked[first]
        at.append(inner + shift[s[~first]])
        value.append(_range_minima(prefix, row_at(inner - 1) + 1, row_at(inner)) + np.uint8(1))
        s = s[first]
        at.append(outer + shift[s])
        if start:
            ahead = np.minimum.accumulate(prefix)
            value.append(np.where(seen[s] > 0, np.minimum(since[s], ahead[row_at(outer)]) + np.uint8(1), 0).astype(np.uint8))
        else:
            value.append(np.zeros(len(outer), np.uint8))
        if start + len(b) < bwt.n:
            behind = np.full(len(b) + 1, 255, np.uint8)
            behind[:-1] = np.minimum.accumulate(prefix[::-1])[::-1]
            last = begins + sizes - 1
            since = np.minimum(since, behind[0])
            since[symbols] = behind[row_at(last) + 1]
            fresh[symbols] = (packed[last] & one) > 0
            seen[symbols] += sizes
    return places, np.concatenate(at), np.concatenate(value)


def _insert(column: _Column, places: np.ndarray, values: np.ndarray, at: np.ndarray, changed: np.ndarray, segment: int) -> None:
    """The column with the values at their places (ascending) between the old ones, then the changes."""
    column.rewind()
    total = column.n + len(places)
    for start in range(0, total, segment):
        end = min(total, start + segment)
        lo, hi = np.searchsorted(places, [start, end])
        out = np.empty(end - start, column.kind)
        old = np.ones(end - start, bool)
        old[places[lo:hi] - start] = False
        out[old] = column.read(end - start - (hi - lo))
        out[places[lo:hi] - start] = values[lo:hi]
        here = (at >= start) & (at < end)
        out[at[here] - start] = changed[here]
        column.write(out)
    column.turn()


def repeated_suffixes(symbols: np.ndarray, lengths: np.ndarray, threshold: int, segment: int = SEGMENT) -> np.ndarray:
    """Of each string (a row, aligned to the right, symbols from 1 on) and suffix length: whether its first `threshold` symbols start elsewhere too."""
    strings, most = symbols.shape
    kind = np.uint16 if symbols.max(initial=0) < 65536 else np.uint32
    last = np.where(lengths > 0, symbols[:, -1], 0) if most else np.zeros(strings, np.int64)
    bwt, lcp = _Column(kind, last), _Column(np.uint8, np.zeros(strings, np.uint8))
    counts = np.bincount(last, minlength=int(symbols.max(initial=0)) + 1)
    try:
        ids = np.flatnonzero(lengths > 0)
        rows = ids.copy()
        for j in range(1, most + 1):
            places, at, value = _scan(bwt, lcp, rows, counts, strings, segment)
            order = np.argsort(places)
            ids, rows = ids[order], places[order]
            left = lengths[ids] - j
            new = np.where(left > 0, symbols[ids, most - j - 1] if j < most else 0, 0)
            _insert(bwt, rows, new.astype(kind), np.zeros(0, np.int64), np.zeros(0, kind), segment)
            _insert(lcp, rows, np.zeros(len(rows), np.uint8), at, value, segment)
            counts += np.bincount(new, minlength=len(counts))
            ids, rows = ids[left > 0], rows[left > 0]
            if not len(ids):
                break
        whole, prefix = bwt.read(bwt.n), np.append(lcp.read(lcp.n), 0)
    finally:
        bwt.close()
        lcp.close()
    order = np.argsort(whole, kind="stable")
    step = np.empty(len(whole), np.int64)
    step[order] = np.arange(len(whole)) + strings - int((whole == 0).sum())
    twice = np.maximum(prefix[:-1], prefix[1:]) >= threshold
    out = np.zeros((strings, most + 1), bool)
    ids = np.flatnonzero(lengths > 0)
    at = ids.copy()
    for j in range(1, most + 1):  # from the empty suffixes to ever longer ones
        at = step[at]
        out[ids, j] = twice[at]
        go = lengths[ids] > j
        ids, at = ids[go], at[go]
    return out


def _repeats(length: int, gram: int, collection: int, segment: int):
    """Whole anchor groups (rows come sorted by anchor) to the runs of repeated windows of each stretch."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        windows, before = (t.column(c).to_numpy().astype(np.int64) for c in ("windows", "before"))
        content = t.column("content").to_pylist()
        numbers: dict[bytes, int] = {}  # by the anchor's bytes: its mark may be that of another one, too
        group = [numbers.setdefault(x[b : b + gram], len(numbers)) for x, b in zip(content, before.tolist(), strict=True)]
        lengths = np.array([len(x) for x in content]) - gram + 1
        most = int(lengths.max())
        symbols = np.zeros((len(content), most), np.int64)
        for i, text in enumerate(content):
            row, b = symbols[i, most - lengths[i] :], before[i]
            codes = np.frombuffer(text, np.uint8)
            row[:b] = codes[:b]
            row[b + 1 :] = codes[b + gram :]
            row += 1
            row[b] = 257 + group[i]
        found = repeated_suffixes(symbols, lengths, length - gram + 1, segment)
        copies = t.column("copies").to_numpy()
        runs = []
        for i, n in enumerate(windows.tolist()):
            flags = np.ones(n, bool) if copies[i] > 1 else found[i, lengths[i] - np.arange(n)]
            runs.append([{"lo": int(a), "hi": int(b)} for a, b in zip(*K.runs(flags), strict=True)])
        return pa.RecordBatch.from_arrays([t.column("anchor").combine_chunks(), t.column("body").combine_chunks(), pa.array(runs, _RUNS)], names=["anchor", "body", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for k in range(0, len(batch), collection):
                held.append(batch.slice(k, collection))
                size += len(held[-1])
                if size >= collection:
                    t = pa.Table.from_batches(held)
                    keys = t.column("anchor").to_numpy()
                    last = int(np.searchsorted(keys, keys[-1]))
                    if last:
                        yield solve(t.slice(0, last))
                        held = t.slice(last).to_batches()
                        size = len(t) - last
        if size:
            yield solve(pa.Table.from_batches(held))

    return run


def _by_window(stretches: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different stretches: each window goes its own way, by its hash."""

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("windows").to_numpy()
            grams = [K.byte_hashes(x, np.arange(k), np.arange(k) + length).view(np.int64) for x, k in zip(batch.column("content").to_pylist(), n.tolist(), strict=True)]
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("anchor", "body", "copies")] + [pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])), pa.array(np.concatenate(grams))], names=["anchor", "body", "copies", "place", "gram"])

    each = stretches.mapInArrow(windows_of, "anchor long, body long, copies long, place int, gram long")
    often = each.groupBy("anchor", "gram").agg(F.sum("copies").alias("n")).where("n > 1")
    spans = F.transform(F.collect_list("place"), lambda p: F.struct(p.alias("lo"), (p + 1).alias("hi")))
    return each.join(often, ["anchor", "gram"], "left_semi").groupBy("anchor", "body").agg(spans.alias("runs"))


def _cut(length: int, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in K.blocks(batch.column("text")):
            rows = batch.slice(block.first, len(block.offsets) - 1)
            marks = rows.column("repeated")
            of = np.repeat(np.arange(len(rows)), np.diff(marks.offsets.to_numpy()))
            items = marks.flatten()
            lo, hi = (block.offsets[of] + items.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
            gone = K.cover(lo, hi - 1 + length, len(block.data))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = block.offsets[:-1][np.diff(block.offsets) > 0]
            begins[inner] = gone[inner]
            removed, spans = (np.diff(np.concatenate(([0], np.cumsum(x)))[block.offsets]) for x in (gone, begins))
            kept = block.data[~gone].tobytes()
            at = np.concatenate(([0], np.cumsum(np.diff(block.offsets) - removed))).tolist()
            parts = [kept[a:b] for a, b in zip(at, at[1:], strict=False)]
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
            text = [pa.array(parts, pa.binary())] if with_text else []
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (np.diff(block.offsets), removed, spans)), sha, *text], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])


def repeated_windows(texts: DataFrame, scratch: Scratch, length: int, anchor: int, group_limit: int, collection: int, segment: int) -> DataFrame:
    """doc_id, text_key, lo, hi: runs of window starts whose windows start elsewhere too."""
    seeds = texts.mapInArrow(_seeds(length, anchor), _SEEDS)
    # written, so that the join reads plain shuffles on both sides and a frequent anchor can be split there
    often = scratch.write(seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "often")
    seeds = scratch.write(seeds.join(often, "anchor", "left_semi"), "seeds")

    one = seeds.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key", "first", "windows", "before")).alias("rep"))
    sizes = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_bodies"), F.min("copies").alias("fewest"))
    distinct = scratch.write(one.join(sizes, "anchor").select("anchor", "body", "copies", "n_bodies", "fewest", "rep.*"), "bodies")
    alone = distinct.where("n_bodies = 1").select("anchor", "body", F.array(F.struct(F.lit(0).alias("lo"), F.col("windows").alias("hi"))).alias("runs"))

    # where all of an anchor's stretches occur more than once, every window does
    every = distinct.where("n_bodies > 1 and fewest > 1").select("anchor", "body", F.array(F.struct(F.lit(0).alias("lo"), F.col("windows").alias("hi"))).alias("runs"))
    many = distinct.where("n_bodies > 1 and fewest = 1")
    wanted = many.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "body", "copies", "first", "windows", "before")).alias("wanted"))
    found = texts.join(wanted, same_row(texts, wanted)).select(texts["doc_id"], texts["text_key"], "text", "wanted")
    content = found.mapInArrow(lambda batches: _fetch(length, batches), "anchor long, body long, copies long, windows int, before int, content binary")
    content = content.dropDuplicates(["anchor", "body"])  # repeated rows of one document bring the same stretch again
    hot = distinct.where(F.col("n_bodies") > group_limit).select("anchor").distinct()
    cool = content.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    solved = cool.mapInArrow(_repeats(length, anchor, collection, segment), "anchor long, body long, runs array<struct<lo:int,hi:int>>")
    runs = alone.unionByName(every).unionByName(solved).unionByName(_by_window(content.join(hot, "anchor", "left_semi"), length))
    runs = scratch.write(runs.where(F.size("runs") > 0), "runs")
    for name in ("often", "bodies"):  # all that reads them is written
        scratch.drop(name)
    each = seeds.join(runs, ["anchor", "body"]).select("doc_id", "text_key", "first", F.explode("runs").alias("r"))
    return each.select("doc_id", "text_key", (F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + F.col("r.hi")).alias("hi"))


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT, collection: int = COLLECTION, segment: int = SEGMENT, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the kept bytes: one row per document."""
    texts = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = repeated_windows(texts, Scratch(docs.sparkSession, "suffix"), length, anchor, group_limit, collection, segment)
    marks = marks.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("repeated"))  # equal rows mark the same
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    joined = texts.join(marks, same_row(texts, marks), "left").select(texts["doc_id"], "text", F.coalesce("repeated", none).alias("repeated"))
    return joined.mapInArrow(lambda batches: _cut(length, with_text, batches), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
