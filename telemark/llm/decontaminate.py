"""Benchmark decontamination: n-grams of test items are looked for in training texts.

Method: the normalised n-grams of the test items form a hash set that is broadcast;
every task scans the token windows of its own texts against it, hits are verified
on the words themselves, and spans or documents are removed.  No row is shuffled.

The set is broadcast only below `set_limit` rows and SET_BYTES bytes.  A larger set is dealt
into blocks of at most about that many, each of which is broadcast and scanned in turn;
the blocks' findings are then joined by document.  The ids of a window that very many items
share are dealt into parts, so that no row is long.

Words: A-Z lower-cased, then maximal runs of letters a-z, digits and characters
over U+007F.  An item of fewer than n words, but not none, is one window.

Cases: null text has no words; null item texts give no windows; an item without an id hits
words but isn't listed; repeated items are found under each of their ids; repeated documents each give a row; an empty
benchmark hits nothing; other columns are ignored by report() and kept by the removers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.llm import _text as K
from telemark.llm._tables import Scratch, map_batches

WINDOW = 10
SET_LIMIT = 500_000
SET_BYTES = 64 << 20
_PARTS = 1024

ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FOUND = "doc_id long, text_key long, n_words long, hit_starts array<long>, hit_ends array<long>, byte_starts array<long>, byte_ends array<long>, items array<string>"


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row for each distinct window and part of its items: gram (words joined by a space), length, items."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(lowered, F.lit(ITEM_WORDS), F.lit(0)).alias("w"))
    starts = listed.where(F.size("w") > 0).select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))).alias("at"))
    grams = starts.select("item_id", F.slice("w", F.col("at"), n).alias("g"))
    return grams.groupBy(F.array_join("g", " ").alias("gram"), F.pmod(F.xxhash64("item_id"), F.lit(_PARTS)).alias("part")).agg(F.first(F.size("g")).alias("length"), F.sort_array(F.collect_set("item_id")).alias("items"))


class _Set:
    """The broadcast form: for each window length, a table of hash bits and the windows by their bytes."""

    def __init__(self, rows: list):
        self.by_length: dict[int, dict[bytes, list[str]]] = {}
        for r in rows:
            self.by_length.setdefault(r["length"], {}).setdefault(r["gram"].encode(), []).extend(r["items"])
        self.bits = {}
        for length, grams in self.by_length.items():
            hashes = _gram_hashes(list(grams))
            size = 1 << max(16, int(len(grams) * 16).bit_length())
            table = np.zeros(size, bool)
            table[hashes & np.uint64(size - 1)] = True
            self.bits[length] = table


def _gram_hashes(grams: list[bytes]) -> np.ndarray:
    out = []
    for block in K.blocks(pa.array(grams, pa.large_binary())):
        w = K.words(block, K.SPACED)
        roll = K.Roll(K.word_hashes(block, w))
        out.append(roll.between(w.offsets[:-1], w.offsets[1:]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _single_spaced(block: K.Block, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each starts and ends there."""
    keep = K.ALNUM[block.data]
    out = np.where(keep, block.data, 32).astype(np.uint8)
    size = w.ends - w.starts
    starts = np.cumsum(size + 1) - (size + 1)
    text = np.full(int((size + 1).sum()), 32, np.uint8)
    text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = out[keep]
    return text, starts, starts + size


def _scan(batches: Iterator[pa.RecordBatch], grams, carried: list[str]) -> Iterator[pa.RecordBatch]:
    wanted: _Set = grams.value
    for batch in batches:
        for block in K.blocks(batch.column("text")):
            block = block._replace(data=K.lower_ascii(block.data))
            rows = len(block.offsets) - 1
            w = K.words(block, K.ALNUM)
            roll = K.Roll(K.word_hashes(block, w))
            row_of = np.repeat(np.arange(rows), np.diff(w.offsets))
            found: list[tuple[int, int, list[str]]] = []
            text = None
            for length, table in wanted.bits.items():
                if len(w.starts) < length:
                    continue
                hashes = roll.grams(length)
                at = np.flatnonzero(table[hashes & np.uint64(len(table) - 1)])
                at = at[row_of[at] == row_of[at + length - 1]]
                if not len(at):
                    continue
                if text is None:
                    spaced, lo, hi = _single_spaced(block, w)
                    text = spaced.tobytes()
                known = wanted.by_length[length]
                for i, a, b in zip(at.tolist(), lo[at].tolist(), hi[at + length - 1].tolist(), strict=True):
                    if (items := known.get(text[a:b])) is not None:
                        found.append((i, i + length, items))
            spans: list[list[list]] = [[[], [], [], []] for _ in range(rows)]
            items_of: list[set] = [set() for _ in range(rows)]
            if found:
                mask = K.cover(np.array([f[0] for f in found]), np.array([f[1] for f in found]), len(w.starts))
                mask_edges = np.zeros(len(mask) + 1, bool)
                mask_edges[w.offsets] = True
                for a, b in zip(*K.runs(mask), strict=True):
                    cuts = [a, *(np.flatnonzero(mask_edges[a + 1 : b]) + a + 1).tolist(), b]
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        r = int(row_of[x])
                        for values, v in zip(spans[r], (x - w.offsets[r], y - w.offsets[r], w.starts[x] - block.offsets[r], w.ends[y - 1] - block.offsets[r]), strict=True):
                            values.append(int(v))
                for i, _, items in found:
                    items_of[row_of[i]].update(items)
            here = batch.slice(block.first, rows)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [here.column("doc_id"), here.column("text_key"), pa.array(np.diff(w.offsets), pa.int64()), *(pa.array([s[k] for s in spans], longs) for k in range(4)), pa.array([sorted(x) for x in items_of], pa.list_(pa.string())), *(here.column(c) for c in carried)],
                names=["doc_id", "text_key", "n_words", "hit_starts", "hit_ends", "byte_starts", "byte_ends", "items", *carried],
            )


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_limit: int = SET_LIMIT, carry: list[str] | None = None) -> DataFrame:
    """A row for each document: its words, the hit stretches (in words and in bytes) and the items found.

    The columns to carry go along as _c0, _c1 and so on.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "items")
    windows = scratch.write(item_windows(benchmark, n), "windows")
    size = F.length("gram") + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x))
    rows, held = windows.agg(F.count(F.lit(1)), F.sum(size)).first()
    sides = max(1, -(-rows // set_limit), -(-(held or 0) // SET_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry or [])))
    side = F.pmod(F.xxhash64("gram"), F.lit(sides))

    def scan(k: int, carried: list[str]) -> DataFrame:
        grams = spark.sparkContext.broadcast(_Set((windows.where(side == k) if sides > 1 else windows).toArrow().to_pylist()))
        fields = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in carried)
        return map_batches(texts.select("doc_id", "text_key", "text", *carried), lambda batches: _scan(batches, grams, carried), _FOUND + fields)

    carried = [f"_c{i}" for i in range(len(carry or []))]
    found = scan(0, carried)
    if sides == 1:
        scratch.drop("windows")
        return found
    lists = [c for c in found.columns if c not in ("doc_id", "text_key", "n_words", *carried)]
    more = scan(1, [])
    for k in range(2, sides):
        more = more.unionByName(scan(k, []))
    scratch.drop("windows")
    more = more.where(F.size("hit_starts") > 0).groupBy("doc_id", "text_key").agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in lists))
    joined = found.alias("f").join(more.alias("m"), F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_key") == F.col("m.text_key")), "left")
    both = [F.concat(c, F.coalesce(f"more_{c}", F.array())).alias(c) for c in lists]
    return joined.select("f.doc_id", "f.text_key", "n_words", *both[:-1], F.array_sort(F.array_distinct(both[-1])).alias("items"), *carried)


def _n_hit() -> Column:
    """Words under the union of the stretches, which overlap where several blocks of the set were scanned."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(zero, s["hit_ends"] - F.greatest(s["hit_starts"], a["to"]))).alias("n"), F.greatest(a["to"], s["hit_ends"]).alias("to"))
    return F.aggregate(F.array_sort(F.arrays_zip("hit_starts", "hit_ends")), start, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_limit: int = SET_LIMIT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated: one row per document."""
    found = find_hits(docs, benchmark, n, set_limit)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", digest.alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def _carried(docs: DataFrame) -> list[Column]:
    return [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_hit_share: float = 0.0, set_limit: int = SET_LIMIT) -> DataFrame:
    """The rows whose hit words are at most that share of their words, all columns kept; rows without words stay."""
    found = find_hits(docs, benchmark, n, set_limit, docs.columns)
    return found.where(_n_hit() <= F.col("n_words") * max_hit_share).select(*_carried(docs))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_limit: int = SET_LIMIT) -> DataFrame:
    """All rows and columns, each text without its hit stretches (first to last hit byte of each)."""
    found = find_hits(docs, benchmark, n, set_limit, docs.columns)
    rows = found.select(*_carried(docs), F.array_sort(F.arrays_zip("byte_starts", "byte_ends")).alias("_spans"))
    raw = F.encode("text", "UTF-8")
    zero = F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("long").alias("to"))
    step = lambda a, s: F.struct(F.concat(a["kept"], F.substring(raw, (a["to"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), s["byte_starts"] - a["to"]).cast("int"))).alias("kept"), F.greatest(a["to"], s["byte_ends"]).alias("to"))
    rest = lambda a: F.concat(a["kept"], F.substring(raw, (a["to"] + 1).cast("int"), F.octet_length("text")))
    cut = F.decode(F.aggregate("_spans", zero, step, rest), "UTF-8")
    return rows.withColumn("text", F.when(F.size("_spans") == 0, F.col("text")).otherwise(cut)).drop("_spans")
