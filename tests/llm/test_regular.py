"""Texts of two alternating parts in an order that polynomials modulo 2 ** 64 can't tell from its complement."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_text import regular
from tokenizers import Tokenizer

from telemark.llm import _text, near_dedup, packing, substring_dedup, suffix_dedup


def pair(n, a="a", b="b", sep=""):
    return [sep.join((x, y)[i] for i in regular(n)) for x, y in ((a, b), (b, a))]


@pytest.mark.parametrize("rest", ["", " ".join(f"w{i}" for i in range(60))])
def test_long_words(spark, rest):
    """Documents that differ in one word of 1,024 letters."""
    one, other = (f"{' '.join(f'x{i}' for i in range(24))} {w} {' '.join(f'y{i}' for i in range(25))}{' | ' + rest if k else ''}" for k, w in enumerate(pair(1024)))
    df = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.dedup(df).collect()} == {0}
    alone = spark.createDataFrame(list(enumerate(pair(1024))), "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.links(alone, near_dedup.Forest(shingle=4)).collect()} == {(0, 0), (1, 1)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], np.uint32).tobytes()) for i, t in enumerate(pair(1024))}
    packed = packing.pack(alone.coalesce(1), public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    got = {i: zlib.crc32(np.concatenate([np.array(r["ids"], np.uint32) for r in sorted(packed, key=lambda r: r["start"]) if r["doc_id"] == i]).tobytes()) for i in want}
    assert got == want


def test_words_in_regular_order(spark):
    texts = pair(64, "ka", "to", " ") + pair(128, "ka", "to", " ")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for limit in (1000, 1):
        for r in substring_dedup.dedup(df, group_limit=limit).collect():
            w = texts[r["doc_id"]].split()
            gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < r["doc_id"] for p in range(k, k + 50)}
            assert r["n_removed"] == len(gone)


@pytest.mark.parametrize("limit", [1000, 1])
def test_bytes(spark, limit):
    """Of 200 to 300 bytes, alone at their anchors, equal around one, and at one mark with others."""
    texts = [t for n in (200, 256, 300) for t in pair(n)] + ["left " + t for t in pair(256)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = {}
    for t in texts:
        for k in range(len(t) - 199):
            count[t[k : k + 200]] = count.get(t[k : k + 200], 0) + 1
    for r in suffix_dedup.dedup(df, group_limit=limit).collect():
        t = texts[r["doc_id"]]
        gone = {p for k in range(len(t) - 199) if count[t[k : k + 200]] > 1 for p in range(k, k + 200)}
        kept = "".join(c for p, c in enumerate(t) if p not in gone)
        assert (r["n_removed"], r["kept_sha256"]) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_bytes_at_one_mark():
    """Where all anchors have one mark, the bytes decide."""
    class Blunt(_text.ByteMarks):
        def grams(self, k):
            return np.zeros_like(super().grams(k))

    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 123, 40).astype(np.uint8)).decode()
    texts = [base[:24], base[3:27], base[5:25] + "x", "q" + base[8:30], base[24:]]
    length, gram = 12, 6
    whole = np.frombuffer("".join(texts).encode(), np.uint8)
    assert not np.any(Blunt(whole).grams(gram))
    count = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    batches = []
    for i, t in enumerate(texts):
        offsets = np.array([0, len(t)])
        s = _text.stretches(Blunt(np.frombuffer(t.encode(), np.uint8)), offsets, length, gram)
        batches += [(i, t, *(int(x[k]) for x in (s.start, s.windows, s.anchor))) for k in range(len(s.start))]
    table = pa.RecordBatch.from_pydict({"anchor": [0] * len(batches), "body": list(range(len(batches))), "copies": [1] * len(batches), "windows": pa.array([b[3] for b in batches], pa.int32()), "before": pa.array([b[4] - b[2] for b in batches], pa.int32()), "content": [b[1][b[2] : b[2] + b[3] - 1 + length].encode() for b in batches]})
    out = next(suffix_dedup._repeats(length, gram, 1000, 1 << 18)(iter([table])))
    for b, runs in zip(batches, out.column("runs").to_pylist(), strict=True):
        found = {b[2] + p for r in runs for p in range(r["lo"], r["hi"])}
        assert found == {k for k in range(b[2], b[2] + b[3]) if count[b[1][k : k + length]] > 1}
