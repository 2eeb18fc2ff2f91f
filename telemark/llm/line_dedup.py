"""Line dedup: lines made from a template that recurs across documents are dropped.

Method: a log-template tree of fixed depth.  Level one is a line's number of tokens, the
next levels its first `lead` tokens; tokens with a digit are variable from the start.  In a
leaf a token stays in the template where at least `least` lines have it at that place, and
any other token becomes a variable field; lines of one leaf with the same template form its
group.  A template recurs if at least `least` documents have it, whatever lines stand around
it, and at least `constant_percent` of its tokens are constant, so prose that merely shares
some frequent words is left alone.  Copies of a whole text count as one document: they are
for near_dedup.  Of a recurring template the document with the smallest doc_id keeps its
lines, with keep_first; all other lines of it are dropped.

Built from DataFrame functions alone.  Leaves with too few lines are left out before any
token is looked at; equal lines are aggregated before tokens are counted, so a very common
line is one row with its number; counts are summed up before they are shuffled.

Cases: null text has no lines and stays null; empty and blank lines are never dropped; a
null doc_id counts as larger than any id; rows that share a doc_id are one document; repeated
rows are treated alike; an empty table gives no rows; other columns are ignored by report()
and kept by clean(), whatever their names.  Leaves, masked lines, templates and texts are
compared by 64-bit hashes (oracle_sql() compares them in full).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.llm._tables import Scratch, same_row

BLANKS = r"[\x09\x0B\x0C\x0D\x20]"
FIELD = "<*>"


class Tree(NamedTuple):
    lead: int = 2
    least: int = 5
    constant_percent: int = 60
    keep_first: bool = True


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _tokens(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit("\t\x0b\x0c\r ")), BLANKS + "+")


def _lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """A row for each line that isn't blank: doc_id, text_key, place, line, leaf."""
    each = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    each = each.where(F.btrim("line", F.lit("\t\x0b\x0c\r ")) != "")
    tokens = _tokens(F.col("line"))
    lead = [F.coalesce(_masked(F.get(tokens, F.lit(i))), F.lit("")) for i in range(tree.lead)]
    return each.withColumn("leaf", F.xxhash64(F.size(tokens), *lead))


def dropped_lines(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, text_key, place of the lines to drop."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = _lines(docs, tree)
    full = scratch.write(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= tree.least).select("leaf"), "leaves")
    seen = lines.join(full, "leaf", "left_semi").withColumn("masked", F.array_join(F.transform(_tokens(F.col("line")), _masked), " "))
    seen = scratch.write(seen.select("doc_id", "text_key", "place", "leaf", "masked", F.xxhash64("masked").alias("masked_key")), "lines")

    distinct = seen.groupBy("leaf", "masked_key").agg(F.count(F.lit(1)).alias("n"), F.min("masked").alias("masked"))
    tokens = scratch.write(distinct.select("leaf", "masked_key", "n", F.posexplode(F.split("masked", " ")).alias("at", "token")), "tokens")
    common = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("support")).where(F.col("support") >= tree.least).select("leaf", "at", "token")
    common = scratch.write(common, "common")
    kept = tokens.where(F.col("token") != FIELD).join(common, ["leaf", "at", "token"]).groupBy("leaf", "masked_key").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("constant"))
    sized = distinct.select("leaf", "masked_key", F.size(F.split("masked", " ")).alias("size")).join(kept, ["leaf", "masked_key"])
    templates = sized.where(F.size("constant") * 100 >= F.col("size") * tree.constant_percent).select("leaf", "masked_key", F.xxhash64("leaf", F.to_json("constant")).alias("template"))
    templates = scratch.write(templates, "templates")  # so that the next join reads plain shuffles, and splits a very common line

    top = F.lit((1 << 63) - 1)
    placed = scratch.write(seen.select("doc_id", "text_key", "place", "leaf", "masked_key").join(templates, ["leaf", "masked_key"]).withColumn("owner", F.coalesce("doc_id", top)).drop("leaf", "masked_key"), "placed")
    per_document = placed.select("template", "owner", "text_key").distinct().groupBy("template", "owner").agg(F.bit_xor(F.xxhash64("text_key")).alias("texts"))
    per_text = per_document.groupBy("template", "texts").agg(F.min("owner").alias("first"))  # copies of a whole text are one
    recurring = scratch.write(per_text.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") >= tree.least).select("template", "first"), "recurring")
    for name in ("leaves", "lines", "tokens", "common", "templates"):  # all that reads them is written
        scratch.drop(name)
    out = placed.join(recurring, "template")
    return (out.where("owner <> first") if tree.keep_first else out).select("doc_id", "text_key", "place")


def _cut(docs: DataFrame, tree: Tree) -> DataFrame:
    """row (all columns but the text), kept_text, n_lines, n_dropped."""
    drop = dropped_lines(docs, tree).groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))
    drop = drop.select(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key"), "places")
    texts = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("whole"), F.xxhash64("text").alias("key"))
    joined = texts.join(drop, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("key") == F.col("drop_key")), "left")
    lines = F.split("whole", "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
    kept = F.when(F.col("places").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("whole").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")
    return joined.select("row", F.col("whole").alias("text"), kept.alias("kept_text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def cleaned(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """All rows and columns, with `kept_text`, `n_lines` and `n_dropped` beside the text (in place of columns of those names)."""
    added = ("kept_text", "n_lines", "n_dropped")
    return _cut(docs, tree).select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added), *added)


def report(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, kept_sha256 (null text: that of the empty string): one row per document."""
    out = cleaned(docs.select("doc_id", "text"), tree)
    return out.select("doc_id", "n_lines", "n_dropped", "kept_text", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def clean(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """The documents with their remaining lines; those that lost lines and hold nothing but white space now are left out."""
    gone = (F.col("n_dropped") > 0) & ~F.coalesce(F.col("kept_text").rlike(r"\S"), F.lit(False))
    return _cut(docs, tree).where(~gone).select(*(F.col("kept_text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def oracle_sql(tree: Tree = Tree()) -> str:
    """report() without the text, over the table documents."""
    blank = r"\x09\x0B\x0C\x0D "
    lead = ", ".join(f"coalesce(string_split(masked, ' ')[{i + 1}], '')" for i in range(tree.lead))
    keep = "p.owner <> r.first" if tree.keep_first else "TRUE"
    return rf"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS owner, text, string_split(text, chr(10)) AS lines FROM documents),
places AS (SELECT r, owner, text, lines, unnest(range(1, len(lines) + 1)) AS place FROM cut WHERE text IS NOT NULL),
lines AS (SELECT r, owner, text, place, lines[place] AS line FROM places),
trimmed AS (SELECT r, owner, text, place, regexp_replace(line, '^[{blank}]+|[{blank}]+$', '', 'g') AS line FROM lines),
masked AS (
  SELECT r, owner, text, place, regexp_replace(regexp_replace(line, '[{blank}]+', ' ', 'g'), '[^ ]*[0-9][^ ]*', '{FIELD}', 'g') AS masked
  FROM trimmed WHERE line <> ''
),
seen AS (SELECT *, string_split(masked, ' ') AS t, concat_ws(' ', CAST(len(string_split(masked, ' ')) AS VARCHAR), {lead}) AS leaf FROM masked),
tokens AS (SELECT leaf, masked, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token, n FROM (SELECT leaf, masked, any_value(t) AS t, count(*) AS n FROM seen GROUP BY leaf, masked)),
common AS (SELECT leaf, pos, token FROM tokens GROUP BY leaf, pos, token HAVING sum(n) >= {tree.least} AND token <> '{FIELD}'),
templates AS (
  SELECT tokens.leaf, tokens.masked, tokens.leaf || '|' || string_agg(CASE WHEN common.token IS NULL THEN '{FIELD}' ELSE common.token END, ' ' ORDER BY tokens.pos) AS template
  FROM tokens LEFT JOIN common ON tokens.leaf = common.leaf AND tokens.pos = common.pos AND tokens.token = common.token
  GROUP BY tokens.leaf, tokens.masked HAVING count(common.token) * 100 >= count(*) * {tree.constant_percent}
),
placed AS (SELECT s.r, s.owner, s.text, s.place, t.template FROM seen s JOIN templates t ON s.leaf = t.leaf AND s.masked = t.masked),
per_document AS (SELECT template, owner, string_agg(DISTINCT md5(text), ',' ORDER BY md5(text)) AS texts FROM placed GROUP BY template, owner),
recurring AS (SELECT template, min(owner) AS first FROM per_document GROUP BY template HAVING count(DISTINCT texts) >= {tree.least}),
dropped AS (SELECT DISTINCT p.r, p.place FROM placed p JOIN recurring r ON p.template = r.template WHERE {keep}),
kept AS (
  SELECT l.r, count(d.place) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE d.place IS NULL) AS text
  FROM lines l LEFT JOIN dropped d ON l.r = d.r AND l.place = d.place GROUP BY l.r
)
SELECT cut.doc_id, coalesce(len(cut.lines), 0)::BIGINT AS n_lines, coalesce(kept.n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM cut LEFT JOIN kept ON cut.r = kept.r
"""
