"""Packing of tokenised documents into sequences of at most `size` tokens.

Method: sum-of-squares online packing.  A level array counts the open sequences at each
fill; every document goes to the level at which the sum of the squared counts ends least,
the fullest one on ties.  Documents of a whole sequence or more first fill sequences of
their own, and only the rest is placed.  Each task packs its own rows, so nothing is
shuffled; sequence numbers start at the task's number times 2 ** 32.

When a task has seen its rows, or has `most_open` open sequences, the open ones are
merged: the least filled are cut to fill the gaps of the fullest, and a last remainder is
cut into powers of two, which need no padding.  So a task pads next to nothing, and holds
at most `most_open` sequences whatever its number of rows.

Tokens are those of the tokenizer file for the whole text, without special tokens added,
then `end_id`.  As that tokenizer drops white space and never joins across it, words are
looked up in a table of at most `TABLE_WORDS` words, and only new ones are encoded.  The
table is a few flat arrays (about 40 bytes a word, kept by the Python worker for its next
task) and knows a word by a hash of 64 bits; when it is full it starts anew.

Cases: null and empty texts are the end token alone; doc_id may be null or repeat, each row
is packed for itself; a text of any length is cut; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm import _text as K
from telemark.llm._tables import map_batches

SIZE = 4096
END_ID = 2
MOST_OPEN = 4096
TABLE_WORDS = 1_200_000
SLICE = 1 << 20
#: Token ids of one batch of rows on their way back to Spark.
FLUSH_IDS = 1 << 20

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[list(b".,;:!?%&$#*")] = True


class WordTable:
    """Hashes of words to their token ids, in flat arrays of bounded size."""

    def __init__(self, most: int, kind: type):
        self.most = most
        self._bits = max(4, (3 * most // 2).bit_length())  # at most two thirds full
        self._keys = np.zeros(1 << self._bits, np.uint64)
        self._entry = np.zeros(1 << self._bits, np.int32)
        self._start = np.zeros(most + 1, np.int64)
        self._ids = np.zeros(1 << 16, kind)
        self.words = 0

    def clear(self) -> None:
        self._keys[:] = 0
        self.words = 0

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash; -1 where it isn't known."""
        out = np.full(len(hashes), -1, np.int64)
        slot, left = self._slot(hashes), np.arange(len(hashes))
        while len(left):
            keys = self._keys[slot]
            hit = keys == hashes
            out[left[hit]] = self._entry[slot[hit]]
            on = np.flatnonzero(~hit & (keys != 0))
            left, hashes, slot = left[on], hashes[on], (slot[on] + 1) & (len(self._keys) - 1)
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Different hashes, none of them known."""
        first, total = self.words, int(self._start[self.words])
        ends = total + np.cumsum(sizes)
        if len(hashes):
            while ends[-1] > len(self._ids):
                self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
            self._ids[total : ends[-1]] = ids
            self._start[first + 1 : first + 1 + len(hashes)] = ends
        self.words += len(hashes)
        entry, slot = np.arange(first, self.words, dtype=np.int32), self._slot(hashes)
        while len(hashes):
            free = np.flatnonzero(self._keys[slot] == 0)
            self._keys[slot[free]] = hashes[free]  # of several for one slot, one stays
            mine = self._keys[slot] == hashes
            self._entry[slot[mine]] = entry[mine]
            hashes, entry, slot = hashes[~mine], entry[~mine], (slot[~mine] + 1) & (len(self._keys) - 1)

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries one after another, and where each entry's begin."""
        first = self._start[entries]
        sizes = self._start[entries + 1] - first
        begins = np.concatenate(([0], np.cumsum(sizes)))
        return self._ids[np.repeat(first - begins[:-1], sizes) + np.arange(begins[-1])], begins


class WordIds:
    """Token ids of blocks of texts, by words."""

    def __init__(self, path: str, most: int = TABLE_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocab = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.table = WordTable(most, np.uint16 if len(self._ends) <= 1 << 16 else np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Words of letters are encoded at once, joined by spaces and parted at the word ends; others one by one."""
        letters = np.array([w.isalpha() for w in words], bool)
        for part in (letters, ~letters):
            at = np.flatnonzero(part)
            if not len(at):
                continue
            some = [words[i] for i in at.tolist()]
            if part is letters:
                ids, _ = self._encoded([" ".join(some)])
                ends = np.flatnonzero(self._ends[ids]) + 1
                if len(ends) == len(some):
                    self.table.add(hashes[at], ids, np.diff(ends, prepend=0))
                    continue
            self.table.add(hashes[at], *self._encoded(some))

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> K.Words:
        """Words between white space, parted between a letter and a mark as well: the tokenizer does so anyway, and there are fewer different ones."""
        w = K.words(K.Block(0, data, offsets), K.SPACED)
        parted = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1
        parted = parted[~np.isin(parted, offsets)] if len(parted) and len(offsets) > 2 else parted
        starts, ends = np.sort(np.concatenate((w.starts, parted))), np.sort(np.concatenate((w.ends, parted)))
        return K.Words(starts, ends, np.searchsorted(starts, offsets))

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and where each text's begin."""
        data = K.lower_ascii(data)
        w = self._words(data, offsets)
        hashes = K.word_hashes(K.Block(0, data, offsets), w) | np.uint64(1)  # 0 is an empty slot
        entries = self.table.find(hashes)
        if (entries < 0).any():
            missing = np.flatnonzero(entries < 0)
            new, at = np.unique(hashes[missing], return_index=True)
            if self.table.words + len(new) > self.table.most:
                self.table.clear()
                missing = np.arange(len(hashes))
                new, at = np.unique(hashes, return_index=True)
            if len(new) > self.table.most:  # more different words than the table holds
                return self._whole(data, offsets)
            at = missing[at]
            text = data.tobytes()
            self._learn(new, [text[a:b].decode() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
            entries = self.table.find(hashes)
        ids, begins = self.table.ids_of(entries)
        return ids.astype(np.uint32), begins[w.offsets]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, cuts = data.tobytes(), offsets.tolist()
        ids, sizes = self._encoded([text[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)])
        return ids, np.concatenate(([0], np.cumsum(sizes)))

    def of(self, block: K.Block) -> Iterator[np.ndarray]:
        """The ids of each text of a block."""
        text = block.data.tobytes()
        if any(s in text for s in self._special):  # their markers count before letters are lower-cased
            parts = [(self._whole if any(s in text[a:b] for s in self._special) else self._plain)(block.data[a:b], np.array([0, b - a])) for a, b in zip(block.offsets.tolist(), block.offsets[1:].tolist(), strict=False)]
            yield from (ids for ids, _ in parts)
        elif len(block.offsets) == 2 and len(text) > SLICE:
            yield np.concatenate([self._plain(block.data[a:b], np.array([0, b - a]))[0] for a, b in _slices(text)])
        else:
            ids, begins = self._plain(block.data, block.offsets)
            yield from (ids[a:b] for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False))


def _slices(text: bytes) -> Iterator[tuple[int, int]]:
    """A long text cut at spaces, so that a slice's arrays stay small."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield at, end
        at = end


_known: dict[str, WordIds] = {}


def token_ids(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text of a column; a null text has none."""
    if path not in _known:
        _known[path] = WordIds(path)
    for block in K.blocks(texts, SLICE):
        yield from _known[path].of(block)


class Packer:
    """Sum-of-squares placement; a piece is (document, start, ids, tokens of the document)."""

    def __init__(self, size: int, first: int, most_open: int):
        self.size, self.next, self.most_open = size, first, most_open
        self.counts = np.zeros(size + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(size)]
        self.open = 0
        self.done: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self._close([(doc, start, ids[start : start + self.size], total)])
            start += self.size
        if start < total:
            self._place((doc, start, ids[start:].copy(), total))  # a view would hold the whole text's ids while it waits
            if self.open > self.most_open:
                self.merge(last=False)

    def _place(self, piece: tuple) -> None:
        s, n = len(piece[2]), self.counts
        cost = 2 * (n[s:] - n[: self.size - s + 1] + 1)
        cost[-1] = 1 - 2 * n[self.size - s]  # fills the sequence
        cost[1:][n[1 : self.size - s + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[s] + 1  # a new sequence
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))
        pieces = self.levels[level].pop() if level else []
        if level:
            n[level] -= 1
            self.open -= 1
        pieces.append(piece)
        if level + s == self.size:
            self._close(pieces)
        else:
            n[level + s] += 1
            self.levels[level + s].append(pieces)
            self.open += 1

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, ids))
            at += len(ids)
        self.next += 1

    def merge(self, last: bool = True) -> None:
        """Close all open sequences; the least filled are cut to fill the others."""
        rows = [[level, pieces] for level in range(self.size - 1, 0, -1) for pieces in self.levels[level]]
        self.levels = [[] for _ in range(self.size)]
        self.counts[:] = 0
        self.open = 0
        lo, hi = 0, len(rows) - 1
        while lo < hi:
            gap = self.size - rows[lo][0]
            if not gap:
                lo += 1
                continue
            doc, start, ids, total = rows[hi][1].pop()
            take = min(gap, len(ids))
            if take < len(ids):
                rows[hi][1].append((doc, start, ids[:-take], total))
            rows[lo][1].append((doc, start + len(ids) - take, ids[len(ids) - take :], total))
            rows[lo][0] += take
            rows[hi][0] -= take
            hi -= not rows[hi][0]
        for level, pieces in rows[: hi + 1]:
            if level == self.size:
                self._close(pieces)
            elif last:
                self._by_powers(level, pieces)
            else:
                self.counts[level] += 1
                self.levels[level].append(pieces)
                self.open += 1

    def _by_powers(self, level: int, pieces: list[tuple]) -> None:
        pieces = pieces[::-1]
        for power in [1 << k for k in range(level.bit_length() - 1, -1, -1) if level >> k & 1]:
            out = []
            while power:
                doc, start, ids, total = pieces.pop()
                if len(ids) > power:
                    pieces.append((doc, start + power, ids[power:], total))
                    ids = ids[:power]
                out.append((doc, start, ids, total))
                power -= len(ids)
            self._close(out)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, most_open: int = MOST_OPEN, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId() << 32, most_open)

        def flushed() -> Iterator[pa.RecordBatch]:
            rows, packer.done = packer.done[::-1], []
            while rows:
                part, n = [], 0
                while rows and n < FLUSH_IDS:
                    part.append(rows.pop())
                    n += len(part[-1][7])
                columns = list(zip(*part, strict=True))
                ids = []
                if with_ids:
                    cuts = np.concatenate(([0], np.cumsum(columns[2]))).astype(np.int32)
                    ids = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(columns[7]).view(np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        end = np.array([end_id], np.uint32)
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                for doc, ids in zip(batch.column("doc_id").to_pylist(), token_ids(tokenizer_path, batch.column("text")), strict=True):
                    packer.add(doc, np.concatenate((ids, end)))
                if sum(len(x[7]) for x in packer.done) > FLUSH_IDS:
                    yield from flushed()
        packer.merge()
        yield from flushed()

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, fields)
