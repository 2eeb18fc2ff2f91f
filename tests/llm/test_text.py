"""The kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from telemark.llm import _text as K

SOME = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n,.\x1f\x0b", max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(SOME, st.integers(1, 60))
def test_words(texts, limit):
    for table, pattern in ((K.SPACED, "[^\x20\x09-\x0d]+"), (K.ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        got = []
        for block in K.blocks(pa.array(texts, pa.string()), limit):
            block = block._replace(data=K.lower_ascii(block.data))
            w = K.words(block, table)
            data = block.data.tobytes()
            for r in range(len(block.offsets) - 1):
                got.append([data[w.starts[k] : w.ends[k]].decode() for k in range(w.offsets[r], w.offsets[r + 1])])
        want = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_sliding_min(values, width):
    got = K.sliding_min(np.array(values, np.uint64), width).tolist()
    assert got == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=40), max_size=5))
def test_stretches_hold_every_window_once_and_alike(rows):
    window, anchor = 8, 4
    data = np.array([x for r in rows for x in r], np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    s = K.stretches(K.ByteMarks(data), offsets, window, anchor)
    held, seen = [], {}
    for a, n, p, key, row in zip(*(x.tolist() for x in s), strict=True):
        for q in range(a, a + n):
            held.append(q)
            assert offsets[row] <= q and q + window <= offsets[row + 1] and q <= p <= q + window - anchor
            text = data[q : q + window].tobytes()
            assert seen.setdefault(text, (p - q, key)) == (p - q, key)
    want = [q for r in range(len(rows)) for q in range(offsets[r], max(offsets[r], offsets[r + 1] - window + 1))]
    assert held == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 9))
def test_roll_is_a_polynomial_modulo_a_prime(units, k):
    """Equal stretches have equal hashes wherever they stand, and hashes follow the polynomial in plain integers."""
    prime, base = int(K.PRIME), K.Roll._BASE
    roll = K.Roll(np.array(units + units, np.uint64))
    n = len(units)
    assert roll.grams(k)[: max(0, n - k + 1)].tolist() == roll.grams(k)[n : n + max(0, n - k + 1)].tolist()
    spans = np.array([(a, b) for a in range(n) for b in range(a + 1, n + 1)], np.int64).reshape(-1, 2)
    plain = [sum(u * pow(base, i, prime) for i, u in enumerate(units[a:b])) % prime for a, b in spans.tolist()]
    want = K.mix(np.array(plain, np.uint64) + (spans[:, 1] - spans[:, 0]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert roll.between(spans[:, 0], spans[:, 1]).tolist() == want.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**61 - 2), min_size=1, max_size=9), st.integers(0, 2**61 - 2))
def test_products_modulo_the_prime(a, b):
    top = 2**61 - 2
    some = [*a, top, 0, 1]
    assert K.times(np.array(some, np.uint64), np.uint64(b)).tolist() == [x * b % (2**61 - 1) for x in some]
    assert int(K.times(np.array([top], np.uint64), np.uint64(top))[0]) == top * top % (2**61 - 1)


def regular(n):
    """0 and 1 by the parity of the ones in 0, 1, 2 ...: a sequence and its complement collide in any polynomial modulo 2 ** 64."""
    return [bin(i).count("1") & 1 for i in range(n)]


def test_words_of_regular_letters_differ():
    for n in (8, 64, 65, 256, 1024, 4096):
        pair = ["".join("ab"[x] for x in regular(n)), "".join("ba"[x] for x in regular(n))]
        block = next(K.blocks(pa.array([" ".join(pair * 2)])))
        h = K.word_hashes(block, K.words(block, K.SPACED)).tolist()
        assert h[0] == h[2] != h[1] == h[3]
        units = np.array(regular(n), np.uint64)
        mixed = [K.Roll(K.mix(x + np.uint64(7))) for x in (units, 1 - units)]
        assert mixed[0].grams(n).tolist() != mixed[1].grams(n).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=200), min_size=1, max_size=12))
def test_word_hashes_tell_words_apart(words):
    block = next(K.blocks(pa.array([" ".join(words)])))
    h = K.word_hashes(block, K.words(block, K.SPACED)).tolist()
    assert len(set(h)) == len(set(words)) == len(set(zip(words, h, strict=True)))
