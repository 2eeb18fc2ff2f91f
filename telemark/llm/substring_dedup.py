"""Substring dedup: passages of `window` words that an earlier document has too are removed.

Method: seed and extend.  Each document is winnowed: every window of `window` words
is dealt to its least gram of `anchor` words, so windows that are equal have the same
anchor at the same distance.  Documents are joined on these anchors; around each shared
anchor the words are extended to the left and to the right one at a time, splitting the
documents into classes that still agree, and a window is covered by an earlier document
where its class has a smaller doc_id.  Overlapping covered windows are joined to maximal
repeats, which are cut out.

Skew: equal stretches around one anchor (copies) are first aggregated to one row with
the smallest doc_id; anchors that no second stretch shares never meet text again.  An
anchor with more than `group_limit` different stretches isn't extended in one task: its
windows are dealt out by hashes of their words, so that no task holds them all, with the
same result.  A window may be 61 words longer than the anchor at most (a stretch's windows
are the bits of one number).

Cases: null text and null doc_id (the latter counts as larger than any id, and null ids
don't cover each other); repeated rows of one doc_id never cover each other; texts with
fewer words than the window are never cut; an empty table gives no rows; other columns
are ignored.  Words are compared by 64-bit hashes, whole stretches by a further one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm import _text as K
from telemark.llm._tables import Scratch, keyed, same_row

WINDOW = 50
ANCHOR = 25
GROUP_LIMIT = 20_000

_SEEDS = "doc_id long, text_key long, anchor long, body long, first int, windows int, before int"


def _word_rolls(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for block in K.blocks(batch.column("text")):
            w = K.words(block, K.SPACED)
            hashes = K.word_hashes(block, w)
            yield batch.slice(block.first, len(block.offsets) - 1), block, w, hashes


def _seeds(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, w, hashes in _word_rolls(batches):
            roll = K.Roll(hashes)
            s = K.stretches(roll, w.offsets, window, anchor)
            body = roll.between(s.start, s.start + s.windows - 1 + window)
            row = pa.array(s.row)
            ints = [(s.start - w.offsets[s.row]), s.windows, s.anchor - s.start]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(row), rows.column("text_key").take(row), pa.array(s.key.view(np.int64)), pa.array(body.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in ints)], names=["doc_id", "text_key", "anchor", "body", "first", "windows", "before"])

    return run


def _fetch(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the wanted stretches of each text, as bytes."""
    for rows, _, w, hashes in _word_rolls(batches):
        wanted = rows.column("wanted")
        of = np.repeat(np.arange(len(rows)), np.diff(wanted.offsets.to_numpy()))
        items = wanted.flatten()
        first, windows = (items.field(c).to_numpy().astype(np.int64) for c in ("first", "windows"))
        at = w.offsets[of] + first
        cut = [hashes[a:b].tobytes() for a, b in zip(at.tolist(), (at + windows - 1 + window).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(items.field(c) for c in ("anchor", "body", "owner", "windows", "before")), pa.array(cut, pa.binary())], names=["anchor", "body", "owner", "windows", "before", "content"])


def _classes(group: np.ndarray, columns: np.ndarray) -> list[np.ndarray]:
    """Class numbers after 0, 1, 2 ... further words: rows are together while all words so far agree."""
    out = [np.unique(group, return_inverse=True)[1]]
    for j in range(columns.shape[1]):
        both = K.mix(columns[:, j] ^ K.mix(out[-1].astype(np.uint64) + np.uint64(j << 40)))
        out.append(np.unique(both, return_inverse=True)[1])
    return out


def _extended(anchor: np.ndarray, owner: np.ndarray, windows: np.ndarray, before: np.ndarray, content: list[np.ndarray], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window of the row, smallest owner) of every window, by extension from the anchors both ways."""
    n, width = len(anchor), window - gram
    # words next to the anchor, from near to far; places beyond a stretch differ from all others
    left = K.mix(np.arange(n * width, dtype=np.uint64) + np.uint64(1)).reshape(n, width)
    right = K.mix(np.arange(n * width, dtype=np.uint64) + np.uint64(1 << 50)).reshape(n, width)
    for i, words in enumerate(content):
        b, rest = before[i], len(words) - before[i] - gram
        left[i, :b] = words[:b][::-1]
        right[i, :rest] = words[before[i] + gram :]
    to_left, to_right = _classes(anchor, left), _classes(anchor, right)
    rows, places, least = [], [], []
    for k in range(width + 1):  # the window that takes k words before the anchor
        has = np.flatnonzero((before >= k) & (before - k < windows))
        if not len(has):
            continue
        both = to_left[k][has].astype(np.int64) * n + to_right[width - k][has]
        _, cls = np.unique(both, return_inverse=True)
        first = np.full(cls.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, cls, owner[has])
        rows.append(has)
        places.append(before[has] - k)
        least.append(first[cls])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(least)


def _extend(window: int, gram: int, batch_rows: int = 4096):
    """Whole anchor groups (rows come sorted by anchor) to the least owner of each of a stretch's windows."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        anchor, owner, windows, before = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "owner", "windows", "before"))
        content = [np.frombuffer(x, np.uint64) for x in t.column("content").to_pylist()]
        rows, places, least = _extended(anchor, owner, windows, before, content, window, gram)
        order = np.lexsort((places, rows))
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(windows))).astype(np.int32), pa.array(least[order]))
        return pa.RecordBatch.from_arrays([t.column("anchor").combine_chunks(), t.column("body").combine_chunks(), lists], names=["anchor", "body", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= batch_rows:
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


def _cut(window: int, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, block, w, _ in _word_rolls(batches):
        marks = rows.column("covered")
        n = len(rows)
        of = np.repeat(np.arange(n), np.diff(marks.offsets.to_numpy()))
        items = marks.flatten()
        first, windows, bits = (items.field(c).to_numpy().astype(np.int64) for c in ("first", "windows", "bits"))
        which = np.repeat(np.arange(len(first)), windows)
        place = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        on = (bits[which] >> (windows[which] - 1 - place)) & 1 == 1
        lo = (w.offsets[of] + first)[which[on]] + place[on]
        gone = K.cover(lo, lo + window, len(w.starts))
        total = np.concatenate(([0], np.cumsum(gone)))
        n_words, n_removed = np.diff(w.offsets), np.diff(total[w.offsets])
        data = block.data.tobytes()
        starts, ends = w.starts.tolist(), w.ends.tolist()
        kept = []
        for r in range(n):
            a, b = w.offsets[r], w.offsets[r + 1]
            keep = (np.flatnonzero(~gone[a:b]) + a).tolist() if n_removed[r] else range(a, b)
            kept.append(b" ".join([data[starts[i] : ends[i]] for i in keep]))
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        text = [pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())] if with_text else []
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), sha, *text], names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])


def shared_stretches(docs: DataFrame, scratch: Scratch, window: int, anchor: int) -> DataFrame:
    """The seeds whose anchor occurs more than once in the corpus."""
    seeds = docs.mapInArrow(_seeds(window, anchor), _SEEDS)
    # written, so that the join reads plain shuffles on both sides and a frequent anchor can be split there
    often = scratch.write(seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "often")
    return scratch.write(seeds.join(often, "anchor", "left_semi"), "seeds")


def covered_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, text_key, text; stretches of windows with a bit for each that an earlier one has)."""
    if window - anchor > 61:
        raise ValueError("window - anchor must be 61 at most")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    texts = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    seeds = shared_stretches(texts, scratch, window, anchor)
    top = (1 << 63) - 1
    owned = seeds.withColumn("owner", F.coalesce("doc_id", F.lit(top)))
    one = owned.groupBy("anchor", "body").agg(F.min(F.struct("owner", "doc_id", "text_key", "first", "windows", "before")).alias("rep"))
    sizes = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_bodies"))
    distinct = scratch.write(one.join(sizes, "anchor").select("anchor", "body", "n_bodies", "rep.*"), "bodies")

    # copies alone: every window's first owner is the stretch's first owner
    alone = distinct.where("n_bodies = 1").select("anchor", "body", F.array_repeat("owner", F.col("windows")).alias("least"))

    many = distinct.where("n_bodies > 1")
    wanted = many.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "body", "owner", "first", "windows", "before", "n_bodies")).alias("wanted"))
    first_rows = texts.join(wanted, same_row(texts, wanted)).select(texts["doc_id"], texts["text_key"], "text", "wanted")
    content = first_rows.mapInArrow(lambda batches: _fetch(window, batches), "anchor long, body long, owner long, windows int, before int, content binary")
    content = content.dropDuplicates(["anchor", "body"])  # repeated rows of one document bring the same stretch again
    hot = sizes.where(F.col("n_bodies") > group_limit).select("anchor")
    hot_stretches = content.join(hot, "anchor", "left_semi")
    cool = content.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    extended = cool.mapInArrow(_extend(window, anchor), "anchor long, body long, least array<long>")

    least = scratch.write(alone.unionByName(extended).unionByName(_by_window(hot_stretches, window)), "least")
    for name in ("often", "bodies"):  # all that reads them is written
        scratch.drop(name)
    joined = owned.join(least, ["anchor", "body"])
    # a stretch's windows as bits, the first one highest
    bits = F.aggregate("least", F.lit(0).cast("long"), lambda m, o: m * 2 + F.when(o < F.col("owner"), 1).otherwise(0))
    marks = joined.select("doc_id", "text_key", "first", "windows", bits.alias("bits")).where("bits > 0")
    return texts, marks


def _by_window(stretches: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many different stretches: each window goes its own way, by its hash."""

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, bodies, owners, n = (batch.column(c).to_numpy() for c in ("anchor", "body", "owner", "windows"))
            grams = [K.Roll(np.frombuffer(x, np.uint64)).grams(window).view(np.int64) for x in batch.column("content").to_pylist()]
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)) for x in (anchors, bodies, owners)] + [pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])), pa.array(np.concatenate(grams))], names=["anchor", "body", "owner", "place", "gram"])

    each = stretches.mapInArrow(windows_of, "anchor long, body long, owner long, place int, gram long")
    least = each.groupBy("anchor", "gram").agg(F.min("owner").alias("least"))
    return each.join(least, ["anchor", "gram"]).groupBy("anchor", "body").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "least"))), lambda x: x["least"]).alias("least"))


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text: one row per document."""
    texts, marks = covered_windows(docs, window, anchor, group_limit)
    marks = marks.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "windows", "bits")).alias("covered"))  # equal rows mark the same
    none = F.array().cast("array<struct<first:int,windows:int,bits:bigint>>")
    joined = texts.join(marks, same_row(texts, marks), "left").select(texts["doc_id"], texts["text_key"], "text", F.coalesce("covered", none).alias("covered"))
    return joined.mapInArrow(lambda batches: _cut(window, with_text, batches), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
