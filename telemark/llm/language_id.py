"""Language ID: a byte convolutional network, trained here and applied to whole texts.

Method: one-hot bytes (A-Z lower-cased), filters of several widths, the maximum of each
filter over a window of `window` bytes, and a softmax over the languages, trained with
numpy on windows of a bounded sample of labelled rows.  A text is cut into windows of that
length, all of them are scored in batches, and the text's language is the one with the
largest mean log-probability, by which the score is made as well.

Learning takes rows with a text and a language from a hash sample of about `per_language`
documents for each of the `most_languages` most frequent languages, `windows_each` different
windows of each at most; twice their number is the most that reaches the driver, however often
a row is repeated and however many values the column has.  Prediction reads the text and nothing else.

Noise is a class of its own, learnt from windows of random bytes and of random printable
characters, as many as a language has windows.  It never is a prediction: `lang_pred` and
`score` are those among the languages, `noise` says that no language was likelier than noise,
and keep_known() drops such texts.  No threshold is set by hand.

Cases: a null text, or one without any letter, is `und` with score 0; without a labelled
row everything is `und`; with one language all texts with letters get it; repeated rows are
predicted alike; very long texts are scored window by window; other columns are kept by
keep_known(), whatever their names; predict() replaces columns named as those that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemark.llm import _text as K
from telemark.llm._tables import map_batches

UNKNOWN = "und"
_ADDED = ("lang_pred", "score", "noise")


class Shape(NamedTuple):
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    per_language: int = 600
    most_languages: int = 256
    windows_each: int = 3
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02


class Network:
    """For each width a table of weights by place and byte; then a dense layer on the maxima, to the languages and noise."""

    def __init__(self, languages: list[str], shape: Shape):
        rng = np.random.default_rng(7)
        self.languages, self.shape = languages, shape
        self.tables = [[rng.normal(0, 0.1, (256, shape.filters)).astype(np.float32) for _ in range(w)] for w in shape.widths]
        features = shape.filters * len(shape.widths)
        self.bias = np.zeros(features, np.float32)
        self.dense = rng.normal(0, 0.3, (features, len(languages) + 1)).astype(np.float32)
        self.out = np.zeros(len(languages) + 1, np.float32)

    def _maxima(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        found, at = [], []
        for tables, width in zip(self.tables, self.shape.widths, strict=True):
            n = x.shape[1] - width + 1
            total = tables[0][x[:, :n]]
            for j in range(1, width):
                total += tables[j][x[:, j : j + n]]
            if places:
                best = total.argmax(axis=1)
                at.append(best)
                found.append(np.take_along_axis(total, best[:, None, :], 1)[:, 0])
            else:
                found.append(total.max(axis=1))
        return np.concatenate(found, axis=1), at

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self._maxima(x)[0] + self.bias, 0) @ self.dense + self.out
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        flat = [t for tables in self.tables for t in tables] + [self.bias, self.dense, self.out]
        first, second = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
        step, filters = 0, self.shape.filters
        for epoch in range(self.shape.epochs):
            rate = self.shape.rate * (1 - epoch / self.shape.epochs)
            order = rng.permutation(len(x))
            for k in range(0, len(order), self.shape.batch):
                rows = order[k : k + self.shape.batch]
                xs, n = x[rows], len(rows)
                maxima, at = self._maxima(xs, places=True)
                hidden = np.maximum(maxima + self.bias, 0)
                z = hidden @ self.dense + self.out
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                back = (p @ self.dense.T) * (hidden > 0)
                grads = []
                for i, width in enumerate(self.shape.widths):
                    d = back[:, i * filters : (i + 1) * filters]
                    for j in range(width):
                        g = np.zeros((256, filters), np.float32)
                        np.add.at(g, (xs[np.arange(n)[:, None], at[i] + j], np.arange(filters)[None, :]), d)
                        grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                for w, g, m, v in zip(flat, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _windows(block: K.Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows of all rows, and the number of each row's."""
    size = np.diff(block.offsets)
    count = -(-size // window)
    row = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
    out = np.zeros((len(row), window), np.uint8)
    padded = np.concatenate((K.lower_ascii(block.data), np.zeros(window, np.uint8)))
    begins = block.offsets[row] + start
    views = np.lib.stride_tricks.sliding_window_view(padded, window)
    out[:] = views[begins]
    left = size[row] - start
    for k in np.flatnonzero(left < window):
        out[k, left[k] :] = 0
    return out, count


def _sampled(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                windows, count = _windows(block, shape.window)
                first = np.cumsum(count) - count
                at, row = [], []
                for r, n in enumerate(count.tolist()):
                    for k in sorted({n * i // shape.windows_each for i in range(shape.windows_each)} if n else ()):
                        at.append(first[r] + k)
                        row.append(block.first + r)
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row, pa.int64())), pa.array([windows[k].tobytes() for k in at], pa.binary())], names=["lang", "window"])

    return run


def _noise(n: int, window: int) -> np.ndarray:
    """Windows of random bytes and of random printable characters in turn, A-Z lower-cased."""
    rng = np.random.default_rng(13)
    out = rng.integers(0, 256, (n, window), np.uint8)
    out[1::2] = rng.integers(32, 127, out[1::2].shape, np.uint8)
    return K.lower_ascii(out.ravel()).reshape(n, window)


def train(labelled: DataFrame, shape: Shape = Shape()) -> Network | None:
    """A network for the most frequent languages of the rows lang, text; None if there is no such row with a letter."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(shape.most_languages).collect()
    if not counts:
        return None
    listed = F.array(*(F.struct(F.lit(r["lang"]).alias("lang"), F.lit(min(1.0, shape.per_language / r["n"])).alias("share")) for r in counts))
    shares = labelled.sparkSession.range(1).select(F.inline(listed))  # createDataFrame() would start Python workers of another kind on the executors, which stay
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    windows = map_batches(drawn.select("lang", "text"), _sampled(shape), "lang string, window binary").distinct()
    sample = windows.orderBy(F.xxhash64("window", "lang"), "window", "lang").limit(2 * shape.per_language * shape.windows_each * len(counts)).collect()
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    network = Network(languages, shape)
    sample = sorted(sample, key=lambda r: (bytes(r["window"]), r["lang"]))
    x = np.frombuffer(b"".join(r["window"] for r in sample), np.uint8).reshape(-1, shape.window)
    noise = _noise(-(-len(x) // len(languages)), shape.window)
    known = np.array([languages.index(r["lang"]) for r in sample])
    network.train(np.concatenate((x, noise)), np.concatenate((known, np.full(len(noise), len(languages)))))
    return network


def predict(docs: DataFrame, network: Network | None, carry: list[str] | None = None) -> DataFrame:
    """All rows, with the columns to carry (or all), `lang_pred`, `score` and `noise` (columns of those names are replaced)."""
    rows = docs.drop(*_ADDED)
    carried = carry or rows.columns
    if network is None:
        return rows.select(*carried).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "noise": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([*net.languages, UNKNOWN])
        classes = len(names)
        for batch in batches:
            known = batch.column("_has_letter").to_numpy(zero_copy_only=False)
            for block in K.blocks(batch.column("text"), 1 << 18):
                n = len(block.offsets) - 1
                ok = known[block.first : block.first + n]
                windows, count = _windows(block, net.shape.window)
                logs = [net.log_probabilities(windows[k : k + 64]) for k in range(0, len(windows), 64)]
                total = np.concatenate((np.zeros((1, classes)), np.cumsum(np.concatenate(logs), axis=0, dtype=np.float64))) if logs else np.zeros((1, classes))
                ends = np.cumsum(count)
                mean = (total[ends] - total[ends - count]) / np.maximum(count, 1)[:, None]
                noise = ok & (mean[:, -1] > mean[:, :-1].max(axis=1))
                mean = mean[:, :-1]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = np.where(ok, p.argmax(axis=1), len(names) - 1)
                score = np.where(ok, p.max(axis=1), 0.0)
                kept = [batch.column(c).slice(block.first, n) for c in carried]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(noise)], names=[*carried, *_ADDED])

    given = rows.select(*dict.fromkeys([*carried, "text"])).withColumn("_has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = T.StructType([*(rows.schema[c] for c in carried), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("noise", T.BooleanType())])
    return map_batches(given, run, out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, shape: Shape = Shape(), carry: list[str] | None = None) -> DataFrame:
    """All rows, the columns to carry (or all; doc_id among them) with lang_pred, score, noise and held_out; learns from the rows that aren't held out."""
    network = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"), shape)
    return predict(docs, network, carry).withColumn("held_out", held_out(F.col("doc_id")))


def keep_known(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The rows, all columns kept, whose language is known; texts that are more like noise than like any language go."""
    read = ("doc_id", "lang", "text")
    names = {c: c if c in read else f"_c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(c).alias(name) for c, name in names.items()))
    found = identify(inner, shape, list(names.values())).where((F.col("lang_pred") != UNKNOWN) & ~F.col("noise"))
    return found.select(*(F.col(name).alias(c) for c, name in names.items()))
