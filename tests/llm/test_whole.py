"""Cases in which an operator once did less than the whole job."""

import random

import pytest

from telemark.llm import chat, line_dedup, queries


def test_lines_recur_by_documents(spark):
    """Lines of a block, lines between blank ones and one-line documents go; copies of a whole text count once."""
    block = "This work is licensed freely\nUse it as you please\nThere is no warranty at all"
    apart = "All rights are reserved here"
    own = [f"{w} speaks alone of {w}" for w in ("ash", "birch", "cedar", "elm", "fir", "oak")]
    rows = [(i, f"{own[i]}\n{block}\nthus {own[i]}") for i in range(6)]
    rows += [(10 + i, f"so {own[i]}\n\n{apart}\n\nand {own[i]}") for i in range(6)]
    rows += [(20, apart), (30, "one line of four texts\nits first other line")]
    rows += [(30 + i, f"one line of four texts\n{own[i]} only") for i in range(1, 4)]
    rows += [(40 + i, "one line of four texts\nits first other line") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r["kept_text"] for r in line_dedup.report(df).collect()}
    texts = dict(rows)
    from test_rest import against_sql

    for some in (df, df.unionByName(df), spark.createDataFrame([*rows, (None, rows[1][1]), (None, None)], df.schema)):
        against_sql(line_dedup.report(some).drop("kept_text"), line_dedup.oracle_sql(), documents=some)
    assert by[0] == texts[0] and all(by[i] == f"{own[i]}\nthus {own[i]}" for i in range(1, 6))
    assert by[10] == texts[10] and all(by[10 + i] == f"so {own[i]}\n\n\nand {own[i]}" for i in range(1, 6))
    assert by[20] == ""
    assert all(by[i] == texts[i] for i in [*range(30, 34), *range(40, 46)])  # four different texts


def test_lines_of_one_id_count_once(spark):
    rows = [(1, f"a notice that stands here\n{w}") for w in ("ash", "birch", "cedar", "elm", "fir")]
    rows += [(i, f"a notice that stands here\n{i} {i}") for i in range(2, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.report(df).collect()} == {0}
    more = df.unionByName(spark.createDataFrame([(9, "a notice that stands here\nz")], df.schema))
    assert {(r["doc_id"], r["n_dropped"]) for r in line_dedup.report(more).collect()} == {(1, 0), (2, 1), (3, 1), (4, 1), (9, 1)}


def rendered(turns, most_chars):
    """By plain Python: speaker, text and masked spans of each section of (name, body) turns."""
    placed, at = [], 0
    for name, body in turns:
        placed.append((at, at + len(name) + len(body) + 18, name, body))
        at = placed[-1][1]
    out = []
    for section in sorted({a // most_chars for a, *_ in placed}):
        last = max((a // most_chars for a, *_ in placed if a // most_chars < section), default=-1)
        held = [(a // most_chars == section, name, body) for a, end, name, body in placed if a // most_chars == section or (a // most_chars == last and end > section * most_chars - most_chars // 4)]
        for speaker in {name for own, name, _ in held if own}:
            text, mask = "", []
            for own, name, body in held:
                text += "<|assistant|>\n" if name == speaker else f"<|user {name}|>\n"
                if own and name == speaker:
                    mask.append((len(text), len(text + body + chat.END)))
                text += body + chat.END + "\n"
            out.append((section, speaker, len(held), text, tuple(mask)))
    return sorted(out)


@pytest.mark.parametrize("most_chars", [None, chat.MOST_CHARS, 400])
def test_chat_renders_whole_conversations(spark, most_chars):
    rng = random.Random(8)
    sizes = {1: (0, 100), 2: (60, 11), 3: (-70, 140), None: (5, 70)}
    talks = {c: [(rng.choice(["ann", "bob", "cy"]), f"{k} " + "é" * rng.choice([1, 30, 90])) for k in range(n)] for c, (_, n) in sizes.items()}
    talks[3][50] = ("dee", "long " * 500)
    rows = [(c, sizes[c][0] + k, *t) for c, turns in talks.items() for k, t in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = chat.whole(df, most_chars).collect()
    for c, turns in talks.items():
        got = [(r["section"], r["speaker"], r["n_turns"], r["text"], tuple((m["start"], m["end"]) for m in r["mask"])) for r in found if r["conv_id"] == c]
        assert sorted(got) == rendered(turns, most_chars or 1 << 62)
        assert sum(len(r[4]) for r in got) == len(turns)


def test_chat_query_renders_long_conversations_whole(spark, tmp_path):
    rows = [(1, k, "ab"[k % 2], f"turn {k}") for k in range(100)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op9_chat(spark, str(tmp_path)).collect()
    assert sorted((r["speaker"], r["n_turns"]) for r in out) == [("a", 100), ("b", 100)]
