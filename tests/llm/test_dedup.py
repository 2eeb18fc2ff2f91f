"""Substring, suffix-array and near-duplicate removal against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemark.llm import near_dedup, substring_dedup, suffix_dedup

SPACED = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("limit", [1000, 2])
def test_substring(docs, texts, limit):
    words = {i: SPACED.findall(t or "") for i, t in texts.items()}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    rows = substring_dedup.dedup(docs, group_limit=limit).collect()
    assert len(rows) == len(texts) + 1
    assert {r["doc_id"]: tuple(r)[1:] for r in rows if r["doc_id"] is not None} == want
    assert sum(v[1] for v in want.values()) > 200
    assert next(r["n_removed"] for r in rows if r["doc_id"] is None) == len(words[0])  # a row without an id comes after all


def test_substring_of_one_id_twice(spark, texts):
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[16])]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0, 0]


@pytest.mark.parametrize(("limit", "collection", "segment"), [(1000, 1000, 1 << 18), (2, 3, 37)])
def test_suffix(docs, texts, limit, collection, segment):
    data = [(i, (t or "").encode()) for i, t in [*texts.items(), (None, texts[0])]]
    count = {}
    for _, x in data:
        for k in range(len(x) - 199):
            count[x[k : k + 200]] = count.get(x[k : k + 200], 0) + 1
    want = []
    for i, x in data:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if count[x[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        spans = sum(1 for g, _ in itertools.groupby(gone.tolist()) if g)
        want.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = [(*tuple(r)[:5], bytes(r["kept"])) for r in suffix_dedup.dedup(docs, group_limit=limit, collection=collection, segment=segment).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_many_equal_rows_bring_each_mark_once(spark, texts, operator, monkeypatch):
    rows = [(1, texts[12])] + [(2, texts[12])] * 200 + [(3, texts[13])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    real = operator._cut

    def cut(window, with_text, batches):
        batches = list(batches)
        for b in batches:
            marks = b.column("covered" if operator is substring_dedup else "repeated")
            assert max(np.diff(marks.offsets.to_numpy())) < 60
        return real(window, with_text, iter(batches))

    monkeypatch.setattr(operator, "_cut", cut)
    out = operator.dedup(df, with_text=False).collect()
    most = {(r["doc_id"], r["n_removed"]) for r in out}
    words, size = len(texts[12].split()), len(texts[12].encode())
    assert len(out) == 202 and ((2, words) in most if operator is substring_dedup else {(1, size), (2, size)} <= most)
    assert len(most) == 3


@pytest.mark.parametrize("bits", [19, 31])
def test_transform_on_random_strings(monkeypatch, bits):
    """31 bits leave too few for the symbols in the short form."""
    monkeypatch.setattr(suffix_dedup, "_SHIFT", bits)
    rng = np.random.default_rng(1)
    for _ in range(30):
        most = int(rng.integers(1, 15))
        lengths = rng.integers(1, most + 1, int(rng.integers(1, 12)))
        lengths[0] = most
        symbols = np.zeros((len(lengths), most), np.int64)
        for i, n in enumerate(lengths):
            symbols[i, most - n :] = rng.integers(1, 3, n)
        threshold = int(rng.integers(1, 6))
        found = suffix_dedup.repeated_suffixes(symbols, lengths, threshold, segment=int(rng.integers(2, 50)))
        strings = [symbols[i, most - n :].tolist() for i, n in enumerate(lengths)]
        count = {}
        for s in strings:
            for q in range(len(s) - threshold + 1):
                count[tuple(s[q : q + threshold])] = count.get(tuple(s[q : q + threshold]), 0) + 1
        for i, s in enumerate(strings):
            for q in range(len(s)):
                assert found[i, len(s) - q] == (q + threshold <= len(s) and count[tuple(s[q : q + threshold])] > 1)


def sets_of(texts, n):
    out = {}
    for i, t in texts.items():
        w = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def least_reachable(sets):
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            part[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near(docs, texts):
    sets = sets_of(texts, 4)
    want = least_reachable(sets)
    rows = near_dedup.links(docs, near_dedup.Forest(shingle=4, block=2)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert len(set(want.values())) < len(texts) - 5


def test_near_chain_and_hub(spark):
    """A long chain of documents, each near the next only, and variants that are near their base only."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join([f"c{k}x{i}" if i < 8 * k else w for i, w in enumerate(base)])))
    hub = [f"h{i}" for i in range(200)]
    rows.append((100, " ".join(hub)))
    for k in range(1, 30):
        v = list(hub)
        for i in range(4):
            v[(k * 6 + i * 45) % 200] = f"v{k}x{i}"
        rows.append((100 + k, " ".join(v)))
    texts = dict(rows)
    want = least_reachable(sets_of(texts, 5))
    got = near_dedup.links(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Forest(block=4))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    kept = near_dedup.keep_one(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_of_repeated_ids(spark):
    """An id with two texts ties both components for links(); keep_one() looks at the texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (8, c), (8, c + " end"), (9, c), (1, "else " + b[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.links(df).collect()} == {(1, 1, True), (5, 1, False), (7, 1, False), (8, 8, True), (9, 8, False)}
    kept = sorted(map(tuple, near_dedup.keep_one(df).collect()))
    assert len(kept) == 4 and {t for _, t in kept} >= {a, b, "else " + b[::-1]} and kept[-1][0] in (8, 9)


@pytest.mark.parametrize("share", [1 / 2000, 0.2, 1.0])
def test_components_with_hubs(spark, monkeypatch, share, tmp_path):
    from telemark.llm import _components
    from telemark.llm._tables import Scratch

    monkeypatch.setattr(_components, "HUB_SHARE", share)
    rng = np.random.default_rng(5)
    pairs = [(500, int(i)) for i in range(501, 900)] + [(0, 950), (950, 940), (940, 930)] + [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(220)] + [(499, 500), (7, 7)]
    got = _components.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test"), "c")
    part = {x: x for p in pairs if p[0] != p[1] for x in p}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for x, y in pairs:
        if x != y:
            x, y = root(x), root(y)
            part[max(x, y)] = min(x, y)
    rows = got.collect()
    assert {r["node"]: r["component"] for r in rows} == {i: root(i) for i in part} and len(rows) == len(part)


def test_near_crowded_region_of_unlike_documents(spark):
    """Many documents that share most of their words, at similarities under the threshold, and a few true pairs among them."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base + [f"o{i}x{j}" for j in range(22)])) for i in range(150)]
    for i in range(0, 150, 10):
        w = rows[i][1].split()
        w[int(rng.integers(70, 80))] = "other"
        rows.append((1000 + i, " ".join(w)))
    want = least_reachable(sets_of(dict(rows), 5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for forest in (near_dedup.Forest(), near_dedup.Forest(block=16, block_bytes=40_000)):
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.links(df, forest).collect()} == want
    assert sum(i != c for i, c in want.items()) == 15


def test_common_counts_both_ways(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, int(n)).astype(np.uint64)) for n in rng.integers(0, 40, 9)]
    want = [[len(np.intersect1d(g, m)) for m in sets[4:]] for g in sets[:4]]
    assert [x.tolist() for x in near_dedup.common_counts(sets[:4], sets[4:])] == want
    far = [np.concatenate((x, np.arange(10**6, 10**6 + 70_000, dtype=np.uint64))) for x in sets]
    assert [(x - 70_000).tolist() for x in near_dedup.common_counts(far[:4], far[4:])] == want


def test_empty_tables(empty):
    assert substring_dedup.dedup(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0
    assert near_dedup.links(empty).count() == 0
    assert near_dedup.keep_one(empty).columns == empty.columns


def test_null_texts_alone(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert {r["kept"] for r in near_dedup.links(df).collect()} == {True}
    assert {r["kept_sha256"] for r in suffix_dedup.dedup(df).collect()} == {hashlib.sha256(b"").hexdigest()}
    assert {r["n_words"] for r in substring_dedup.dedup(df).collect()} == {0}
