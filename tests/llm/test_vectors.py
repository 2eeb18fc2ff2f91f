"""Clusters, vector codes and exact copies against plain Python and against SQL."""

import hashlib
import math
import random
import string

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemark.llm import clustering, exact_dedup, queries, vector_codes

DIR = "/root/testdata/sf0.001"


def against_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, pa.Table.from_pandas(t.toPandas()) if hasattr(t, "toPandas") else t)
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    got = [r.asDict() for r in df.collect()]
    key = lambda r: tuple(str(r[c]) for c in sorted(rel.columns))
    assert sorted(map(key, got)) == sorted(map(key, want))


# -- clustering


def clusters_of(rows, how):
    """vec_id, cluster, distance, cluster inertia, inertia, centroid hash by nested loops."""
    kept = [(i, [math.floor(how.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"{how.seed}:{r[0]}"), r[1]))
    centroids = [v for _, v in first[: how.clusters]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(how.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centroids)]
    out = [(i, *nearest(v)) for i, v in kept]
    by = {}
    for _, c, d in out:
        by[c] = by.get(c, 0) + d
    return sorted(((i, c, d, by[c], sum(by.values()), sha(",".join(map(str, centroids[c])))) for i, c, d in out), key=str)


def vectors(rng, n, size=64, spread=1.0):
    return [[float(np.float32(rng.gauss(0, spread))) for _ in range(size)] for _ in range(n)]


def odd_rows(size=64):
    """With copies, repeated ids, null and non-finite components, other sizes, nulls and a wide component."""
    rng = random.Random(4)
    some = vectors(rng, 60, size)
    rows = [(i, v) for i, v in enumerate(some)]
    rows += [(100 + i, some[0]) for i in range(30)] + [(5, some[6]), (5, some[6]), (7, some[8]), (None, some[9])]
    rows += [(200, None), (201, []), (202, some[1][:-1] + [None]), (203, some[1][:-1] + [float("nan")]), (204, some[1][:-1] + [float("-inf")]), (205, some[1][: size // 2])]
    return rows + [(206, [-300.0] + some[2][1:]), (207, [0.0] * size), (-8, some[3][::-1])]


CLASHING = "vec_id long, embedding array<float>, label int, id string, vector int, planes string, ints int, x0 int, position int, n int"


def with_clashes(spark, rows, label=lambda i: None if i is None else i % 3):
    return spark.createDataFrame([(i, v, label(i), "x", 1, "y", 2, 3, 4, 5) for i, v in rows], CLASHING).repartition(3)


@pytest.mark.parametrize("how", [clustering.Lloyd(), clustering.Lloyd(scale=8, clusters=3, rounds=2, seed=9), clustering.Lloyd(clusters=200)])
def test_clusters(spark, how):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = clustering.report(with_clashes(spark, rows), how)
    assert sorted(map(tuple, got.collect()), key=str) == clusters_of(rows, how)


def test_clusters_of_few_and_none(spark):
    rows = odd_rows()
    for some in (rows[:3], [(None, rows[0][1]), (None, rows[1][1])], [(1, [0.0] * 64)] * 4, [(1, None)], []):
        df = with_clashes(spark, some)
        assert sorted(map(tuple, clustering.report(df).collect()), key=str) == clusters_of(some, clustering.Lloyd())


def test_clusters_against_sql_and_as_registered(spark):
    df = queries.op11_centroid_clusters(spark, DIR)
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    against_sql(df, clustering.oracle_sql(), embeddings=table)
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table.collect()]
    assert sorted(map(tuple, df.collect()), key=str) == clusters_of(rows, clustering.Lloyd())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 26).flatmap(lambda b: st.tuples(st.just(b + 1), st.lists(st.lists(st.integers(-(1 << b), (1 << b) - 1), min_size=64, max_size=64), min_size=1, max_size=4))))
def test_popcounts_are_exact(case):
    n, rows = case
    x = np.array(rows, np.int64)
    planes = clustering.planes_of(x, n)
    assert planes.shape == (len(x), n)
    assert clustering.dots(planes, planes).tolist() == (x @ x.T).tolist()
    assert clustering.norms(planes).tolist() == (x * x).sum(axis=1).tolist()
    assert clustering.sums_of(planes).tolist() == x.sum(axis=0).tolist()


def test_too_wide_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="more than 64 bits"):
        clustering.report(with_clashes(spark, [(1, [2.0**18] + [0.0] * 63)]))


# -- vector codes


def codes_of(rows, label, how):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in kept]
    size = min(sizes, key=lambda n: (-sizes.count(n), n), default=0)
    kept = [(i, [math.floor(how.scale * x) for x in v]) for i, v in kept if len(v) == size]
    w = size // how.parts
    part = lambda v, p: v[p * w : p * w + w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: how.entries]
    books = [[part(v, p) for _, v in first] for p in range(how.parts)]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(how.rounds):
        for p in range(how.parts):
            groups = {}
            for _, v in kept:
                groups.setdefault(nearest(p, part(v, p))[0], []).append(part(v, p))
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    mark = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], {}
    for i, v in kept:
        found = [nearest(p, part(v, p)) for p in range(how.parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
        by[label(i)] = by.get(label(i), 0) + out[-1][2]
    return sorted(((i, c, d, by[label(i)], mark) for i, c, d in out), key=str)


def label_of(i):
    return None if i is None or i % 4 == 0 else i % 3


@pytest.mark.parametrize(("how", "most"), [(vector_codes.Codes(), 100_000), (vector_codes.Codes(scale=2, parts=16, entries=5, rounds=3), 1), (vector_codes.Codes(scale=1, parts=1, entries=300, rounds=9), 1)])
def test_codes(spark, monkeypatch, how, most):
    monkeypatch.setattr(vector_codes, "RUN", 7)
    monkeypatch.setattr(vector_codes, "MOST_LABELS", most)
    rows = odd_rows()
    got = vector_codes.report(with_clashes(spark, rows, label_of), how)
    assert sorted(map(tuple, got.collect()), key=str) == codes_of(rows, label_of, how)


def test_codes_of_few_and_none(spark):
    rows = odd_rows()
    for some in (rows[:3], [(None, rows[0][1]), (None, rows[1][1])], [(1, [0.5] * 64)] * 4, [(1, None), (2, [])], []):
        got = vector_codes.report(with_clashes(spark, some, label_of))
        want = codes_of([r for r in some if r[1]], label_of, vector_codes.Codes())
        assert sorted(map(tuple, got.collect()), key=str) == want
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.report(with_clashes(spark, [(1, [0.5] * 63)]))


def test_codes_against_sql_and_as_registered(spark):
    df = queries.op13_vector_codes(spark, DIR)
    table = spark.read.parquet(f"{DIR}/embeddings.parquet")
    against_sql(df, vector_codes.oracle_sql(), embeddings=table)
    rows = table.collect()
    labels = {r["vec_id"]: r["label"] for r in rows}
    want = codes_of([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in rows], labels.get, vector_codes.Codes())
    assert sorted(map(tuple, df.collect()), key=str) == want


@settings(max_examples=80, deadline=None)
@given(st.sets(st.tuples(*[st.integers(-3, 3)] * 4), min_size=1, max_size=40), st.lists(st.tuples(*[st.integers(-5, 5)] * 4), min_size=1, max_size=5), st.integers(1, 9))
def test_trie_shares_prefixes(parts, entries, run):
    """Whatever the runs, distances are right and each prefix's are computed once."""
    leaves = np.array(sorted(parts), np.int64)
    trie = vector_codes.Trie(np.array(entries, np.int64))
    got = np.concatenate([trie.run(leaves[a : a + run]) for a in range(0, len(leaves), run)])
    assert got.tolist() == [[sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries] for x in leaves.tolist()]
    assert trie.nodes == len({x[:k] for x in parts for k in range(1, 5)})


# -- exact copies

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def copies_of(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for norm, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        stays = [True] + [False] * (len(ids) - 1)
        for k, i in zip(stays, sorted(ids, key=lambda i: (i is None, -(i or 0))), strict=True):
            out.append((i, best, len(ids), k, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def copy_rows():
    rng = random.Random(3)
    long = " ".join(rng.choice(["Ka", "to", "MI", "É"]) for _ in range(30_000))
    rows = [(i, f"Text {i % 17} of SOME") for i in range(120)] + [(200 + i, f"tExt {i % 17} of some") for i in range(40)]
    rows += [(300, long), (301, long.translate(LOWER)), (302, long + "x"), (303, "é"), (304, "É"), (305, "İ"), (306, "i̇"), (307, "ΑΣ"), (308, "ΑΣ"), (309, "ας")]
    rows += [(400, None), (401, ""), (402, " "), (None, "Text 3 of SOME"), (None, "alone"), (None, "ALONE"), (403, "a\x00b"), (404, "A\x00B")]
    return rows + [(5, "text 5 of some")] * 3 + [(10_000 + i, "HOT" if i % 2 else "hot") for i in range(150)] + [(10_003, "hot")] * 2


@pytest.mark.parametrize(("rows_at_most", "bytes_at_most"), [(200, 1 << 26), (4, 1 << 26), (200, 300)])
def test_copies(spark, monkeypatch, rows_at_most, bytes_at_most):
    monkeypatch.setattr(exact_dedup, "ROWS", rows_at_most)
    monkeypatch.setattr(exact_dedup, "BYTES", bytes_at_most)
    rows = copy_rows()
    df = spark.createDataFrame([(i, t, "a", "b", 3, t, t) for i, t in rows], "doc_id long, text string, id string, norm string, n int, sha string, `own.x` string").repartition(5)
    assert sorted(map(tuple, exact_dedup.report(df).collect()), key=str) == copies_of(rows)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, *_, k, _ in copies_of(rows) if k), key=str)
    texts = dict(rows)
    assert all(r["text"] == texts[r["doc_id"]] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] != 5 and r["doc_id"] != 10_003)
    least = exact_dedup.report(df, exact_dedup.Keep(largest=False))
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = sorted((min((i for i in ids if i is not None), default=None) for ids in groups.values()), key=str)
    assert sorted((r["keep_id"] for r in least.collect() if r["kept"]), key=str) == want


def test_copies_against_sql_and_as_registered(spark):
    df = queries.op12_exact_dedup(spark, DIR)
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    against_sql(df, exact_dedup.oracle_sql(), documents=table)
    assert sorted(map(tuple, df.collect()), key=str) == copies_of([(r["doc_id"], r["text"]) for r in table.collect()])
    rows = spark.createDataFrame(copy_rows(), "doc_id long, text string")
    against_sql(exact_dedup.report(rows).where("doc_id is not null"), f"SELECT * FROM ({exact_dedup.oracle_sql()}) WHERE doc_id IS NOT NULL", documents=pa.table(dict(zip(("doc_id", "text"), (list(c) for c in zip(*copy_rows(), strict=True)), strict=True))))


def test_no_copies_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n int")
    assert exact_dedup.report(none).count() == 0 and exact_dedup.keep_one(none).columns == none.columns
    nulls = spark.range(3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert sorted((r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.report(nulls).collect()) == [(None, 3, False), (None, 3, False), (None, 3, True)]


def test_copies_move_once_and_stay_in_the_jvm(spark):
    """Dealing out is the only exchange of texts; nothing runs in Python workers."""
    text = spark.createDataFrame(copy_rows(), "doc_id long, text string")
    plans = []
    real = exact_dedup.Scratch.write

    def write(self, df, name):
        plans.append(df._jdf.queryExecution().toString())
        return real(self, df, name)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(exact_dedup.Scratch, "write", write)
        exact_dedup.report(text)
    physical = plans[-1].split("== Physical Plan ==")[1]
    assert physical.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in physical
    assert not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow"))


