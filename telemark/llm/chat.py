"""Chat formatting: multi-party perspective rotation.

Method: for every participant the dialogue is rendered with that speaker as the assistant
and all others as named users; the mask marks what the assistant says, end marker included,
as the text to learn from.

A conversation of up to `most_chars` characters, far above ordinary ones, is one dialogue;
with None every one is, and a row has to hold it.  A longer one is cut by position: a turn is
in the section in which its first character falls, and the turns that reach into the last
quarter before a section are carried into it as context, which the mask leaves out.  A section
is rendered for the speakers of its own turns, so every turn is learnt exactly once.

Turns of the same number follow the digests of their speaker and text; sizes by digest prefix give each turn its place, so that no task sorts more than the turns of one
number and prefix, or the totals of blocks of turn numbers of one conversation.

Built from DataFrame functions alone.

Cases: a null conv_id is a conversation of its own; a null turn comes after all others;
a null or blank role is `unknown`; null text is empty; repeated rows are turns of their own; `<|` in a text is written `< |`, and names lose the characters of the
markers, so no text can forge a turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_CHARS = 1_000_000
END = "<|end|>"
_LAST = (1 << 63) - 1
#: Turn numbers that are totalled together before a conversation's totals are sorted.
_BLOCK = 64
_NO_CUT = 1 << 62


def _named(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, name, body, part (blocks of turn numbers), digest, prefix."""
    name = F.btrim(F.translate(F.coalesce(F.col("role"), F.lit("")), "<|>\n\r\t", "      "))
    rows = conversations.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"),
        F.when(name == "", "unknown").otherwise(name).alias("name"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    part = F.expr(f"(turn - pmod(turn, {_BLOCK}L)) div {_BLOCK}L")
    return rows.withColumns({"part": part, "digest": F.md5(F.concat_ws("\x01", "name", "body"))}).withColumn("prefix", F.substring("digest", 1, 2))


def _placed(conversations: DataFrame) -> DataFrame:
    """conv_id, at (characters of the conversation before the turn), size, name, body."""
    size = F.length("name") + F.length("body") + len("<|user |>\n" + END + "\n")
    rows = _named(conversations).withColumn("size", size.cast("long"))
    group = ("conv_id", "part", "turn", "prefix")
    sizes = rows.groupBy(*group).agg(F.sum("size").alias("size"))
    blocks = sizes.groupBy("conv_id", "part").agg(F.sum("size").alias("size"))
    blocks = blocks.select(F.col("conv_id").alias("b_conv_id"), F.col("part").alias("b_part"), (F.sum("size").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("size")).alias("ahead"))
    sizes = sizes.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv_id")) & (F.col("part") == F.col("b_part")))
    before = Window.partitionBy("conv_id", "part").orderBy("turn", "prefix")
    c = sizes.select(*(F.col(x).alias(f"c_{x}") for x in group), (F.col("ahead") + F.sum("size").over(before) - F.col("size")).alias("first"))
    inside = Window.partitionBy(*group).orderBy("digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    joined = ranked.join(c, F.col("conv_id").eqNullSafe(F.col("c_conv_id")) & (F.col("part") == F.col("c_part")) & (F.col("turn") == F.col("c_turn")) & (F.col("prefix") == F.col("c_prefix")))
    return joined.select("conv_id", (F.col("first") + F.col("inside")).alias("at"), "size", "name", "body")


def _opening(name: Column, speaker: Column) -> Column:
    return F.when(name == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user "), name, F.lit("|>\n")))


def whole(conversations: DataFrame, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """conv_id, part (0), section, speaker, n_turns (carried ones too), text, mask (array of start, end in characters)."""
    most_chars = most_chars or _NO_CUT
    turns = _placed(conversations)
    section = F.expr(f"at div {most_chars}L")
    later = F.greatest(section + 1, F.expr(f"(at + size) div {most_chars}L"))
    carried = F.col("at") + F.col("size") > later * most_chars - most_chars // 4
    own, context = F.struct(section.alias("section"), F.lit(True).alias("own")), F.struct(later.alias("section"), F.lit(False).alias("own"))
    placed = turns.withColumn("p", F.explode(F.when(carried, F.array(own, context)).otherwise(F.array(own))))
    sections = placed.groupBy("conv_id", F.col("p.section").alias("section")).agg(F.array_sort(F.collect_list(F.struct("at", "name", "body", F.col("p.own").alias("own")))).alias("turns"))
    return _rendered(sections.withColumn("part", F.lit(0).cast("long")))


def _rendered(sections: DataFrame) -> DataFrame:
    """A row for each speaker of the section's own turns."""
    spoken = sections.withColumn("speaker", F.explode(F.array_sort(F.array_distinct(F.transform(F.filter("turns", lambda t: t["own"]), lambda t: t["name"])))))
    speaker = F.col("speaker")
    text = F.array_join(F.transform("turns", lambda t: F.concat(_opening(t["name"], speaker), t["body"], F.lit(END + "\n"))), "")
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("to"), spans.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["to"] + F.length(_opening(t["name"], speaker))
        end = begin + F.length(t["body"]) + len(END)
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("to"), F.when(t["own"] & (t["name"] == speaker), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("turns", start, step, lambda acc: acc["spans"])
    return spoken.select("conv_id", "part", "section", "speaker", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def report_whole(conversations: DataFrame, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """whole() with the mask written as start-end pairs and its number of characters."""
    out = whole(conversations, most_chars)
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    chars = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("conv_id", "part", "section", "speaker", "n_turns", "text", spans.alias("mask"), chars.alias("n_masked"))


def oracle_sql(most_chars: int | None = MOST_CHARS) -> str:
    """report_whole() over the table conversations."""
    most_chars = most_chars or _NO_CUT
    frame = len("<|user |>\n" + END + "\n")
    return f"""
WITH named AS (
  SELECT conv_id, coalesce(turn, {_LAST})::BIGINT AS turn, trim(translate(coalesce(role, ''), '<|>' || chr(10) || chr(13) || chr(9), '      ')) AS name, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations
),
sized AS (SELECT conv_id, turn, CASE WHEN name = '' THEN 'unknown' ELSE name END AS name, body FROM named),
placed AS (
  SELECT *, length(name) + length(body) + {frame} AS size,
         (sum(length(name) + length(body) + {frame}) OVER turns)::BIGINT - (length(name) + length(body) + {frame}) AS place
  FROM sized WINDOW turns AS (PARTITION BY conv_id ORDER BY turn, md5(name || chr(1) || body) ROWS UNBOUNDED PRECEDING)
),
cut AS (SELECT *, place // {most_chars} AS section, greatest(place // {most_chars} + 1, (place + size) // {most_chars}) AS later FROM placed),
turns AS (
  SELECT conv_id, section, place, name, body, TRUE AS own FROM cut
  UNION ALL SELECT conv_id, later, place, name, body, FALSE FROM cut WHERE place + size > later * {most_chars} - {most_chars // 4}
),
speakers AS (SELECT DISTINCT conv_id, section, name AS speaker FROM turns WHERE own),
rendered AS (
  SELECT s.conv_id, s.section, s.speaker, t.place, t.own AND t.name = s.speaker AS learnt,
         CASE WHEN t.name = s.speaker THEN '<|assistant|>' || chr(10) ELSE '<|user ' || t.name || '|>' || chr(10) END AS opening, t.body || '{END}' AS said
  FROM speakers s JOIN turns t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.section = t.section
),
measured AS (
  SELECT *, (sum(length(opening) + length(said) + 1) OVER (PARTITION BY conv_id, section, speaker ORDER BY place))::BIGINT - length(said) - 1 AS start FROM rendered
)
SELECT conv_id, 0::BIGINT AS part, section::BIGINT AS section, speaker, count(*)::BIGINT AS n_turns,
       string_agg(opening || said || chr(10), '' ORDER BY place) AS text,
       string_agg(start::VARCHAR || '-' || (start + length(said))::VARCHAR, ',' ORDER BY place) FILTER (WHERE learnt) AS mask,
       (sum(length(said)) FILTER (WHERE learnt))::BIGINT AS n_masked
FROM measured GROUP BY conv_id, section, speaker
"""
