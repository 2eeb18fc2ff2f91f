"""Quality classifier: a generalised additive model with pairwise interactions.

Method: numeric features of the whole text are cut into bins; cyclic boosting visits one
feature after another and adds a shallow tree's values, at a small rate, to that feature's
lookup table; the pairs of features whose residuals a two-way split fits best then get
two-dimensional tables in the same way.  A text's score is the logistic function of the sum
of its bins' table entries, added up for whole batches at once.

Learning takes a hash sample of about `sample` labelled documents; twice as many different
feature rows are the most that reaches the driver, however often a document or a label is
repeated.  Counts and features cover whole texts.

Cases: null and empty texts have features of zero and a score like any other; labelled
documents without a text row, or with a null label, are left out; several labels of one
document each count; without any label, or with one kind alone, the score is the share of
label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.llm import _text as K

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "mark_share", "space_share", "high_share",
    "distinct_words", "adjacent_same", "distinct_triples", "symbol_words", "log_lines", "line_bytes", "distinct_lines", "end_marks", "short_words",
)


class Settings(NamedTuple):
    sample: int = 8_000
    bins: int = 32
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 6
    rate: float = 0.1
    leaves: int = 3
    least_rows: int = 20


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_MARK, _SPACE = _class(b".,;:?'\"-()"), _class(b" \t\n\r\x0b\x0c")
_SYMBOL = _class(b"!#$%&*+/<=>@[\\]^_`{|}~")
_HIGH, _END, _LINE = _class(bytes(range(128, 256))), _class(b".?!"), ~_class(b"\n")


def _distinct_share(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row over all of its values; 0 where it has none."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[fresh], minlength=rows) / np.maximum(np.bincount(owner, minlength=rows), 1)


def features(block: K.Block) -> np.ndarray:
    """A row of FEATURES for each text of the block."""
    data, offsets = block.data, block.offsets
    rows, size = len(offsets) - 1, np.diff(offsets)

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])

    share = lambda table: per_row(table[data]) / np.maximum(size, 1)
    w = K.words(block, K.SPACED)
    count = np.diff(w.offsets)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(rows), count)
    hashes = K.word_hashes(block, w)
    lengths = w.ends - w.starts
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    triples = K.Roll(hashes).grams(3)
    inside = np.flatnonzero(owner[: len(triples)] == owner[2 : 2 + len(triples)])
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    symbol_words = symbols[w.ends] > symbols[w.starts]
    lines = K.words(block, _LINE)
    line_count = np.diff(lines.offsets)
    line_owner = np.repeat(np.arange(rows), line_count)
    of_words = lambda mask: np.bincount(owner, weights=mask, minlength=rows) / some
    columns = [
        np.log1p(size), np.log1p(count), of_words(lengths), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARK), share(_SPACE), share(_HIGH),
        _distinct_share(hashes, owner, rows), of_words(same), _distinct_share(triples[inside], owner[inside], rows), of_words(symbol_words),
        np.log1p(line_count), np.bincount(line_owner, weights=lines.ends - lines.starts, minlength=rows) / np.maximum(line_count, 1),
        _distinct_share(K.word_hashes(block, lines), line_owner, rows), of_words(_END[data[w.ends - 1]]) if len(data) else np.zeros(rows), of_words(lengths <= 3),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


class Additive:
    """Bin edges and lookup tables of features and of pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, s: Settings):
        n, k = x.shape if len(x) else (0, len(FEATURES))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        mean = (y.sum() + 1) / (n + 2) if n else 0.5
        self.base = float(np.log(mean / (1 - mean)))
        if n and 0 < y.sum() < n:
            self._fit(x, y, s)
        elif n:
            self.base = 30.0 if y.sum() else -30.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for i, j, table in self.pairs:
            out += table[b[:, i], b[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int) -> np.ndarray:
        """Leaf values by bin of a tree of few leaves, grown by the best split of sums of gradients and curvatures."""
        parts = [(0, len(g))]
        gain_of = lambda a, b: a * a / (b + 1.0)
        while len(parts) < leaves:
            best = (1e-9, None, 0)
            for lo, hi in parts:
                if hi - lo < 2:
                    continue
                left_g, left_h, left_n = (np.cumsum(v[lo:hi])[:-1] for v in (g, h, n))
                total_g, total_h, total_n = g[lo:hi].sum(), h[lo:hi].sum(), n[lo:hi].sum()
                gain = gain_of(left_g, left_h) + gain_of(total_g - left_g, total_h - left_h) - gain_of(total_g, total_h)
                gain[(left_n < least) | (total_n - left_n < least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (lo, hi), lo + at + 1)
            if best[1] is None:
                break
            parts.remove(best[1])
            parts += [(best[1][0], best[2]), (best[2], best[1][1])]
        out = np.zeros(len(g))
        for lo, hi in parts:
            out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
        return out

    def _fit(self, x: np.ndarray, y: np.ndarray, s: Settings) -> None:
        b = self.bins(x)
        logits = np.full(len(y), self.base)
        for _ in range(s.rounds):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-logits))
                sums = [np.bincount(b[:, j], weights=v, minlength=len(table)) for v in (y - p, p * (1 - p), np.ones(len(y)))]
                update = s.rate * self._tree(*sums, s.leaves, s.least_rows)
                table += update
                logits += update[b[:, j]]
        p = 1 / (1 + np.exp(-logits))
        ranked = sorted(combinations(range(len(self.tables)), 2), key=lambda ij: -self._corner(b, *ij, y - p, p * (1 - p), s)[0])
        self.pairs = [(i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))) for i, j in ranked[: s.pairs]]
        for _ in range(s.pair_rounds):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-logits))
                _, u, v, values = self._corner(b, i, j, y - p, p * (1 - p), s)
                update = np.zeros_like(table)
                for q, (rows, cols) in enumerate(((slice(0, u), slice(0, v)), (slice(0, u), slice(v, None)), (slice(u, None), slice(0, v)), (slice(u, None), slice(v, None)))):
                    update[rows, cols] = s.rate * values[q]
                table += update
                logits += update[b[:, i], b[:, j]]

    def _corner(self, b: np.ndarray, i: int, j: int, g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, int, int, list[float]]:
        """The split into four quadrants with the most gain: gain, both cuts, values."""
        shape = len(self.tables[i]), len(self.tables[j])
        if min(shape) < 2:
            return 0.0, 1, 1, [0.0] * 4
        flat = b[:, i] * shape[1] + b[:, j]
        sums = [np.bincount(flat, weights=v, minlength=shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1) for v in (g, h, np.ones(len(g)))]
        quadrants = []
        for c in sums:
            a = c[:-1, :-1]
            top, left, total = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
            quadrants.append((a, top - a, left - a, total - top - left + a))
        gain = sum(qg * qg / (qh + 1.0) for qg, qh in zip(quadrants[0], quadrants[1], strict=True))
        gain = np.where(np.minimum.reduce(quadrants[2]) >= s.least_rows, gain, 0)
        u, v = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[u, v]:
            return 0.0, 1, 1, [0.0] * 4
        return float(gain[u, v]), int(u) + 1, int(v) + 1, [float(qg[u, v] / (qh[u, v] + 1.0)) for qg, qh in zip(quadrants[0], quadrants[1], strict=True)]


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in K.blocks(batch.column("text")):
            rows = batch.slice(block.first, len(block.offsets) - 1)
            x = features(block)
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality") -> Additive:
    """From a hash sample of the labels: they, at most twice `sample` rows, are sent to all tasks, not the texts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    share = min(1.0, s.sample / max(1, known.count()))
    draw = F.xxhash64("doc_id", "label", F.lit("quality"))
    drawn = known.where(F.pmod(draw, F.lit(1 << 20)) < share * (1 << 20)).orderBy(draw, "doc_id", "label").limit(2 * s.sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("label", "text")
    rows = texts.mapInArrow(_with_features, "label int, features array<double>").distinct().orderBy(F.xxhash64("features", "label"), "features", "label").limit(2 * s.sample).collect()
    data = np.array(sorted([*r["features"], r["label"]] for r in rows)) if rows else np.zeros((0, len(FEATURES) + 1))
    return Additive(data[:, :-1], data[:, -1], s)


def score(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                rows = batch.slice(block.first, len(block.offsets) - 1)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(shared.value.scores(features(block)))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the labels of rows that aren't held out."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), s)
    return score(docs, model, threshold).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")
