"""Decontamination, packing, classifiers, neighbours, lines, chat and the pipeline."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from telemark.llm import chat, decontaminate, language_id, line_dedup, nearest, packing, quality
from telemark.llm import queries as registered

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(t):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("limit", [1000, 8])
def test_decontaminate(spark, docs, texts, limit):
    items = [(1, " ".join(texts[2].split()[5:22]).upper()), (2, "one, TWO!"), (3, None), (4, ""), (5, " ".join(texts[2].split()[5:22])), (None, texts[4])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])] |= {str(i)} if i else set()
    want = {}
    for i, t in texts.items():
        w, hit, found = item_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= x
                    hit |= set(range(k, k + n))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    rows = decontaminate.report(docs, benchmark, set_limit=limit).collect()
    assert len(rows) == len(texts) + 1
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in rows if r["doc_id"] is not None} == want
    clean = decontaminate.clean_documents(docs, benchmark, set_limit=limit)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} - {None} == {i for i, v in want.items() if not v[4]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, benchmark, set_limit=limit).collect()}
    assert {i for i in texts if cut[i] != texts[i]} == {i for i, v in want.items() if v[4]}
    assert all(len(item_words(cut[i])) == v[0] - v[1] for i, v in want.items())
    assert decontaminate.report(docs, benchmark.limit(0)).where("contaminated").count() == 0


def packed_pieces(rows, texts, size):
    """Each document's pieces give its ids back, and sequences are full or a power of two."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        x = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = x[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(part.tobytes()))
            assert "ids" not in r or r["ids"] == part.tolist()
            at += r["length"]
        assert at == len(x)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and (at == size or at & (at - 1) == 0)


@pytest.mark.parametrize(("size", "most_open"), [(256, 5), (4096, 4096), (4, 2)])
def test_packing(docs, texts, size, most_open):
    rows = packing.pack(docs, TOKENIZER, size=size, most_open=most_open).collect()
    packed_pieces(rows, {**texts, None: texts[0]}, size)


def test_packing_flushes_in_parts(docs, texts, monkeypatch):
    monkeypatch.setattr(packing, "FLUSH_IDS", 1000)
    packer = packing.Packer(64, 0, 8)
    for i in range(300):
        packer.add(i, np.arange(1 + i * 7 % 150, dtype=np.uint32))
    packer.merge()
    assert sum(len(x[7]) for x in packer.done) == sum(1 + i * 7 % 150 for i in range(300))
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


ODD = ["", " ", "a,b.c!! x%%%", "don't it's, we'll", "<|endoftext|> X<|ENDOFTEXT|>", "İstanbul Σας ﬁ ½ é", "a b", "１２ 3.5%", "x" * 3000, "a\x0bb\x0cc\x1cd", None, "a.", ".b", "e\u0301.e\u0301", "the a. the .b"]


@pytest.mark.parametrize("most", [5, 40, 100_000])
def test_tokens_of_odd_texts(most, monkeypatch):
    from tokenizers import Tokenizer

    import pyarrow as pa

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("abcdefg.é1", k=rng.randint(1, 9))) for _ in range(3000))
    texts = [*ODD, long, *ODD[::-1]]
    monkeypatch.setattr(packing, "_known", {TOKENIZER: packing.WordIds(TOKENIZER, most)})
    monkeypatch.setattr(packing, "SLICE", 700)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in packing.token_ids(TOKENIZER, pa.array(texts))] == want
    monkeypatch.setattr(packing, "SLICE", 1 << 20)
    huge = "kala muna, " * 200_000
    assert len(next(packing.token_ids(TOKENIZER, pa.array([huge])))) == 3 * 200_000


SPOKEN = {"aa": ["kala", "muna", "sato", "rami"], "bb": ["proz", "krit", "vlos", "drun"], "cc": ["ilée", "ouré", "éteau", "née"]}


def spoken(n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SPOKEN))
        rows.append((i, " ".join(rng.choices(SPOKEN[lang], k=rng.randint(4, 200))), lang))
    return rows


def test_language(spark):
    rows = [*spoken(), (900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (903, "kala muna rami", None), (None, "proz krit vlos", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(df, language_id.Shape(per_language=60)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert all((r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)) for r in found if r["doc_id"] is not None)
    right = [by[i]["lang_pred"] == lang for i, _, lang in spoken() if by[i]["held_out"]]
    assert sum(right) >= 0.95 * len(right)
    assert {by[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and by[903]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in found)
    kept = language_id.keep_known(df, language_id.Shape(per_language=60))
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    more = df.select("*", F.lit(77.0).alias("score"), F.lit("own").alias("lang_pred"), F.lit(True).alias("noise"), F.lit(3).alias("_has_letter"), F.lit(4).alias("held_out"))
    kept = language_id.keep_known(more, language_id.Shape(per_language=60))
    assert kept.columns == more.columns and kept.select("score", "lang_pred", "_has_letter", "held_out").distinct().collect() == [(77.0, "own", 3, 4)]
    assert {r["lang_pred"] for r in language_id.identify(df.where("lang is null")).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def plain_language(network, text):
    """(best language, its share, whether noise is likelier) by loops over the bytes of every window."""
    data, size = [b + 32 if 65 <= b <= 90 else b for b in text.encode()], network.shape.window
    total = [0.0] * len(network.out)
    windows = [data[k : k + size] for k in range(0, len(data), size)]
    for window in windows:
        window = window + [0] * (size - len(window))
        maxima = []
        for tables, width in zip(network.tables, network.shape.widths, strict=True):
            for f in range(network.shape.filters):
                maxima.append(max(sum(float(tables[j][window[k + j], f]) for j in range(width)) for k in range(size - width + 1)))
        hidden = [max(0.0, m + float(b)) for m, b in zip(maxima, network.bias, strict=True)]
        z = [float(o) + sum(h * float(network.dense[i, c]) for i, h in enumerate(hidden)) for c, o in enumerate(network.out)]
        norm = max(z) + np.log(sum(np.exp(v - max(z)) for v in z))
        total = [t + v - norm for t, v in zip(total, z, strict=True)]
    mean = [t / len(windows) for t in total]
    shares = [float(np.exp(v - max(mean[:-1]))) for v in mean[:-1]]
    best = max(range(len(shares)), key=shares.__getitem__)
    return network.languages[best], shares[best] / sum(shares), mean[-1] > max(mean[:-1])


def against_plain_language(network, found, texts):
    for i, text in texts.items():
        lang, share, noise = plain_language(network, text)
        assert (found[i]["lang_pred"], found[i]["noise"]) == (lang, noise) and abs(found[i]["score"] - share) < 1e-4


def test_language_against_loops(spark):
    """Whole texts, one of 40,000 bytes among them; noise goes, though it has letters, and repeated rows are alike."""
    rng = random.Random(3)
    junk = {700 + i: "".join(chr(rng.randint(33, 126)) for _ in range(700)) + "a" for i in range(5)}
    rows = [*spoken(), (800, "kala " * 8000 + "proz", "aa"), *((i, t, None) for i, t in junk.items())]
    df = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, lang string")
    shape = language_id.Shape(per_language=60)
    network = language_id.train(df.where(~language_id.held_out(F.col("doc_id"))), shape)
    all_rows = language_id.predict(df, network).collect()
    found = {r["doc_id"]: r for r in all_rows}
    assert len(all_rows) == len(rows) + 3 and len({(r["doc_id"], r["lang_pred"], r["score"], r["noise"]) for r in all_rows}) == len(rows)
    against_plain_language(network, found, {i: t for i, t, _ in [*rows[:10], rows[240], *rows[-2:]]})
    assert {r["doc_id"] for r in all_rows if r["noise"]} == set(junk)
    assert {r["doc_id"] for r in language_id.keep_known(df, shape).collect()} == {i for i, _, _ in rows} - set(junk)


def test_language_batches_are_bounded(spark, monkeypatch):
    """Whole texts go to Python in batches of a few MB, unless the session says otherwise; no Python workers are started besides those of mapInArrow."""
    import pyarrow as pa

    from telemark.llm import _tables

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    def refused(*args, **kinds):
        raise AssertionError("createDataFrame")

    fresh = spark.newSession()
    docs = fresh.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.expr("repeat(concat('some words of a text ', id, ' '), 400)").alias("text"))
    monkeypatch.setattr(type(fresh), "createDataFrame", refused)
    assert language_id.keep_known(docs).count() == 3000
    n, largest, total = docs.mapInArrow(sizes, "n long").agg(F.count("n"), F.max("n"), F.sum("n")).first()
    assert total > 5 * _tables.BATCH_BYTES and n > 5 and largest < 1.5 * _tables.BATCH_BYTES
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    fresh.conf.set(name, "1048576")
    assert language_id.keep_known(docs.limit(100)).count() == 100 and fresh.conf.get(name) == "1048576"


def test_language_column_of_junk(spark):
    """A value of its own for each row: only the most frequent languages are learnt, and no more rows are collected."""
    rows = [*spoken(), *((1000 + i, "kala muna", f"x{i}") for i in range(500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.train(df, language_id.Shape(per_language=20, most_languages=3, epochs=1))
    assert network.languages == sorted(SPOKEN)


SYMBOLS, MARKS, ENDS = (set(c.encode()) for c in ("!#$%&*+/<=>@[\\]^_`{|}~", ".,;:?'\"-()", ".?!"))


def plain_features(text):
    data = text.encode()
    split = re.compile("[^\x20\x09-\x0d]+").findall(text)
    words = [w.encode() for w in split]
    lines = [x.encode() for x in re.compile("[^\n]+").findall(text)]
    share = lambda test: sum(map(test, data)) / max(1, len(data))
    of_words = lambda values: sum(values) / max(1, len(words))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    symbol = SYMBOLS.__contains__
    return [
        np.log1p(len(data)), np.log1p(len(words)), of_words(map(len, words)), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(symbol), share(lambda b: b in MARKS), share(lambda b: b == 32 or 9 <= b <= 13), share(lambda b: b >= 128),
        len(set(words)) / max(1, len(words)), of_words(a == b for a, b in zip(words, words[1:], strict=False)), len(set(triples)) / max(1, len(triples)), of_words(any(map(symbol, w)) for w in words),
        np.log1p(len(lines)), sum(map(len, lines)) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), of_words(w[-1] in ENDS for w in words), of_words(len(w) <= 3 for w in words),
    ]


def plain_quality(model, text):
    x = plain_features(text)
    bins = [sum(1 for e in edges if e <= v) for edges, v in zip(model.edges, x, strict=True)]
    z = model.base + sum(float(t[b]) for t, b in zip(model.tables, bins, strict=True)) + sum(float(t[bins[i], bins[j]]) for i, j, t in model.pairs)
    return 1 / (1 + np.exp(-z))


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        w = rng.choices(SPOKEN["aa"] + SPOKEN["bb"] + [f"u{k}" for k in range(300)], k=rng.randint(5, 120))
        rows.append((i, " ".join(x if good else x + "$$%" for x in w), "p"))
        labels.append((i, int(good), None))
    rows += [(900, None, "p"), (901, "", "p")]
    labels += [(5000, 1, 0), (900, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.classify(docs, marks).collect()}
    assert len(found) == len(rows)
    truth = {i: q for i, q, _ in labels if i is not None and i < 400}
    held = [i for i in truth if found[i]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == found[i]["held_out"] for i in truth)
    assert sum(found[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert {r["score"] for r in quality.classify(docs, marks.limit(0)).collect()} == {0.5}
    assert {r["predicted"] for r in quality.classify(docs, marks.where("quality = 1")).collect()} == {1}
    assert quality.classify(docs.limit(0), marks).count() == 0
    odd = [(910, "One, two!\n\nThree (3) ÜÜ ÜÜ ÜÜ x"), (911, " \t\n"), (912, "kala " * 20_000 + "$$"), (912, "kala " * 20_000 + "$$")]
    odd = spark.createDataFrame([*rows[:20], *((i, t, "p") for i, t in odd), *rows[-2:]], docs.schema)
    model = quality.train(docs, marks.where(~quality.held_out(F.col("doc_id"))))
    assert model.pairs and odd.count() == 26
    against_plain_quality(model, odd, quality.score(odd, model).collect())


def against_plain_quality(model, docs, found):
    want = sorted(((r["doc_id"], plain_quality(model, r["text"] or "")) for r in docs.select("doc_id", "text").collect()), key=lambda r: r[0])
    got = sorted(((r["doc_id"], r["score"]) for r in found), key=lambda r: r[0])
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True))


def nearest_brute(rows, k):
    ids, x = [], []
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v):
            ids.append(i)
            x.append(v)
    ids, x = np.array(ids), np.array(x, np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x[q] * x).sum(axis=1) / (norm[q] * norm)
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), r, int(ids[j]), float(s[j])) for r, j in enumerate(best, 1)]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(2000, [0.0] * 8), (2050, None), (2100, [1.0] * 7), (2150, [float("nan")] * 8), (2200, [None] * 8), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, vector string")
    got = sorted(map(tuple, nearest.search(df, F.col("id") % 50 == 0, p=nearest.Polytopes(cell=25, block=16)).collect()))
    want = nearest_brute(rows, 5)
    exact = {(q, v): s for q, _, v, s in nearest_brute(rows, 1000)}
    assert all(s == exact[q, v] for q, _, v, s in got)
    assert {q for q, *_ in got} == {q for q, *_ in want} and len(got) == len(want)
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    assert [v for q, _, v, _ in got if q == 50] == [1000, 1001, 1002, 1003, 1004]  # ties to the smaller id
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["rank"], r["vec_id"]) for r in nearest.search(few, F.col("id") % 50 == 0).collect()) == [(1, 2), (2, 1)]
    assert nearest.search(few.limit(0), F.col("id") % 50 == 0).count() == 0


def test_nearest_with_copies_and_repeated_rows(spark):
    """A vector that many rows share, queries among them; repeated rows; an id with two vectors."""
    rng = np.random.default_rng(6)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(301)]
    rows += rows[:40] + [(50, rng.normal(size=8).tolist()), (7, hot), (7, hot)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    best = defaultdict(dict)
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    for a in np.flatnonzero(ids % 50 == 0):
        for b, s in enumerate((x[a] * x).sum(axis=1) / (norm[a] * norm)):
            if ids[a] != ids[b]:
                best[int(ids[a])][int(ids[b])] = max(s, best[int(ids[a])].get(int(ids[b]), -2))
    want = sorted((q, r, v, s) for q, near in best.items() for r, (v, s) in enumerate(sorted(near.items(), key=lambda e: (-e[1], e[0]))[:5], 1))
    every = nearest.Polytopes(cell=30, block=20, recall=1.0)
    assert sorted(map(tuple, nearest.search(df, F.col("id") % 50 == 0, p=every).collect())) == want


def test_nearest_looks_at_few_vectors_of_clusters(spark, monkeypatch):
    """Cells grow in number with the vectors: in clusters a query is compared with under a tenth of them."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(400, 64))
    x = (centres[rng.integers(0, 400, 20_000)] + 0.4 * rng.normal(size=(20_000, 64))).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    p = nearest.Polytopes()
    tables = nearest.make_tables(len(x), 64, p)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen = []
    real = nearest.probes_needed
    monkeypatch.setattr(nearest, "probes_needed", lambda *a: seen.append(real(*a)) or seen[-1])
    got = defaultdict(set)
    for r in nearest.search(df, F.col("id") % 50 == 0, p=p).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits, compared = 0, 0
    sizes = [np.bincount(t.cell_of(u), minlength=t.cells) for t in tables]
    for q in range(0, 20_000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
        compared += sum(int(n[t.probes(u[q : q + 1], seen[0])[0]].sum()) for t, n in zip(tables, sizes, strict=True))
    assert tables[0].cells >= 128 and hits >= 0.9 * 5 * 400 and compared / 400 < 2_000


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_nearest_recall_on_the_table(spark, monkeypatch, size):
    """With the query's own parameters; the table's vectors have no structure, so many cells are probed."""
    path = f"/root/testdata/{size}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    df = spark.read.parquet(path).select("vec_id", "embedding")
    table = df.toArrow()
    ids, x = table.column(0).to_numpy(), np.array(table.column(1).to_pylist(), np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked, real = [], nearest.probes_needed
    monkeypatch.setattr(nearest, "probes_needed", lambda *a: asked.append(real(*a)) or asked[-1])
    got = defaultdict(set)
    for r in registered.op8_nearest(spark, f"/root/testdata/{size}").collect():
        got[r["query_id"]].add(r["vec_id"])
    tables = nearest.make_tables(len(x), 64, nearest.Polytopes())
    sizes = [np.bincount(t.cell_of(u), minlength=t.cells) for t in tables]
    queries, hits, compared = np.flatnonzero(ids % 50 == 0), 0, 0
    for q in queries:
        s = u @ u[q]
        s[q] = -2
        hits += len(got[int(ids[q])] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        compared += sum(int(n[t.probes(u[q : q + 1], asked[0])[0]].sum()) for t, n in zip(tables, sizes, strict=True))
    print(size, "cells", tables[0].cells, "probes", asked[0], "recall", hits / 5 / len(queries), "comparisons", compared / len(queries), "of", len(x))
    assert set(got) == {int(ids[q]) for q in queries} and hits >= 0.9 * 5 * len(queries)
    assert tables[0].cells >= 16 and asked[0] < tables[0].cells


def against_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    key = lambda r: tuple(str(x) for x in r)
    order = [relation.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=key)


def test_lines(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        own = [" ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{k}{i}w" for k in range(rng.randint(4, 9))) for _ in range(4)]
        own = [re.sub("[0-9]", "q", x) + f" tail{chr(97 + i % 26)}" for x in own]
        if i % 2:
            own.insert(rng.randrange(4), f"Posted by user{i} on {i}.{i}.2020 in the forum")
        if i % 3 == 0:
            own.insert(0, "  Cookies\tare used here. ")
        rows.append((i, "\n".join(own), i))
    same = "first line of a copy\nsecond line of a copy\nthird"
    rows += [(100 + i, same, 0) for i in range(12)] + [(200, None, 1), (201, "", 2), (202, "\n \n", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int")
    out = line_dedup.report(df)
    against_sql(out.drop("kept_text"), line_dedup.oracle_sql(), documents=df.select("doc_id", "text"))
    by = {r["doc_id"]: r for r in out.collect()}
    assert all("Posted by" not in by[i]["kept_text"] for i in range(2, 40) if i % 2)
    assert "Posted by user1 on" in by[1]["kept_text"] and "Cookies" in by[0]["kept_text"] and "Cookies" not in by[3]["kept_text"]
    assert all(by[100 + i]["n_dropped"] == 0 for i in range(12))  # copies have the same surroundings
    assert (by[200]["n_lines"], by[200]["kept_text"], by[202]["kept_text"]) == (0, None, "\n \n")
    clean = line_dedup.clean(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    more = df.select("*", *(F.lit(7).alias(c) for c in ("n_lines", "n_dropped", "kept_text", "_drop_id", "text_key", "row", "places")))
    clean = line_dedup.clean(more)
    assert clean.columns == more.columns and clean.select(*more.columns[3:]).distinct().collect() == [(7,) * 7]
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} == {(i, r["kept_text"]) for i, r in by.items()}
    assert line_dedup.report(df.limit(0)).count() == 0
    assert line_dedup.report(df.unionByName(df)).count() == 2 * len(rows)


def test_chat(spark):
    rows = [(1, 0, "system", "Be <|end|> kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "héllo"), (1, 2, "bob", "héllo"), (1, 3, "ann|>", None), (1, 70, "  ", "x"), (2, None, None, ""), (2, 0, "a", "b")]
    rows += [(3, 5, f"s{i % 3}", f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for most in (None, chat.MOST_CHARS, 300):
        against_sql(chat.report_whole(df, most), chat.oracle_sql(most), conversations=df)
    found = chat.whole(df, None).collect()
    own = defaultdict(int)
    for r in found:
        for s in r["mask"]:
            assert r["text"][s["start"] : s["end"]].endswith(chat.END)
            assert r["text"][: s["start"]].endswith("<|assistant|>\n")
            own[r["conv_id"]] += 1
        assert r["text"].count("<|assistant|>") == len(r["mask"])
    assert own == {1: 6, 2: 2, 3: 100}
    ann = next(r for r in found if r["conv_id"] == 1 and r["speaker"] == "ann")
    assert ann["text"].startswith("<|user system|>\nBe < |end|> kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user bob|>\nhéllo<|end|>\n")
    assert chat.whole(df.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_registered_queries(spark):
    names = registered.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14))
    for name in ("op3_line_dedup", "op9_chat"):
        table = "documents" if "line" in name else "conversations"
        against_sql(names[name](spark, SF), registered.oracle_sql()[name], **{table: spark.read.parquet(f"{SF}/{table}.parquet")})
    assert names["op8_nearest"](spark, SF).count() == 50
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    network = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    found = {r["doc_id"]: r for r in names["op2_language_id"](spark, SF).collect()}
    short = docs.where("length(text) between 1 and 900").orderBy("doc_id").limit(10).collect()
    assert len(found) == docs.count() and len(short) == 10
    for r in short:
        lang, share, _ = plain_language(network, r["text"])
        assert found[r["doc_id"]]["lang_pred"] == lang and abs(found[r["doc_id"]]["score"] - share) < 1e-4
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    against_plain_quality(model, docs, names["op5_quality"](spark, SF).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_against_plain_python(spark):
    """Stage by stage on whole tables: each stage's rows are what brute force keeps of its input."""
    import corpus_pipeline
    from tests_plain import component_roots

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]

    def rows(df):
        out = df.collect()
        assert df.columns == columns
        return {r["doc_id"]: r for r in out}

    def frame(found):
        return spark.createDataFrame(list(found.values()), docs.schema)

    before = rows(docs)
    after = rows(stages["language_id"](spark, docs, SF))
    assert after == {i: r for i, r in before.items() if r["text"] and re.search(r"[^\W\d_]", r["text"])}

    before, after = after, rows(stages["line_dedup"](spark, frame(after), SF))
    con = duckdb.connect()
    con.register("documents", frame(before).toArrow())
    sha = {r[0]: r for r in con.sql("SELECT doc_id, n_dropped, kept_sha256 FROM (" + line_dedup.oracle_sql() + ")").fetchall()}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == sha[i][2] and r["n_chars"] == len(r["text"]) for i, r in after.items())
    assert all(sha[i][1] > 0 for i in set(before) - set(after))

    before, after = after, rows(stages["near_dedup"](spark, frame(after), SF))
    roots = component_roots({i: r["text"] for i, r in before.items()}, 5)
    assert set(after) == {i for i, root in roots.items() if i == root}

    before, after = after, rows(stages["decontaminate"](spark, frame(after), SF))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = item_words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = {i for i, r in before.items() if any(tuple(w[k : k + n]) in windows for w in [item_words(r["text"])] for n in sizes for k in range(len(w) - n + 1))}
    assert set(after) == set(before) - dirty and dirty

    packed = stages["packing"](spark, frame(after), SF).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    whole = corpus_pipeline.run(spark, SF)
    assert sum(r["length"] for r in packed) == whole.agg(F.sum("length")).first()[0]
