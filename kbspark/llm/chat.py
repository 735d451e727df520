"""Chat formatting: the dialogue as each of its parties would be trained on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Template: how a turn of the perspective's own speaker and of another one is opened, and how any turn is closed.
OWN = "<|assistant|>\n"
OTHER = "<|user name={}|>\n"
CLOSE = "<|end|>\n"
#: Turn numbers that share a block of the offset sum.
BLOCK = 256


def _opening(own: Column, name: Column, own_tag: str, other_tag: str) -> Column:
    before, after = other_tag.split("{}")
    return F.when(own, F.lit(own_tag)).otherwise(F.concat(F.lit(before), name, F.lit(after)))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 own: str = OWN, other: str = OTHER, close: str = CLOSE) -> DataFrame:
    """One row per conversation, participant and turn: the turn as it stands in
    the dialogue rendered with that participant as assistant.

    Columns: conv_id, perspective, turn, role, rendered, start, end (characters of
    the rendered dialogue, end exclusive), learn, mask_start, mask_end. The
    rendered strings of a perspective, in the order of ``start``, are its
    dialogue. Loss is taken where ``learn`` is true, from mask_start to
    mask_end: the speaker's own words and the closing mark, never the opening.
    Other turns have null masks.

    Turns are ordered by (turn, role, text). Repeated rows count once; rows
    that share a turn number follow each other. A missing turn number comes
    first, a missing role is the party ``unknown``, a missing text is empty.
    Rows without a conversation are left out. Other columns are ignored.

    A dialogue is never gathered into one row: offsets are summed per block of
    turn numbers, then over blocks, so one dialogue may hold most rows."""
    rows = (turns.where(F.col(conv).isNotNull())
            .select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                    F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
            .distinct())
    parties = (turns.where(F.col(conv).isNotNull())
               .select(F.col(conv).alias("conv_id"),
                       F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("perspective")).distinct())
    mine = F.col("role") == F.col("perspective")
    opening = _opening(mine, F.col("role"), own, other)
    shown = rows.join(parties, "conv_id").select(
        "conv_id", "perspective", "turn", "role", F.concat(opening, "text", F.lit(close)).alias("rendered"),
        F.length(opening).alias("__open"), F.col("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).alias("__block"))
    shown = shown.withColumn("__n", F.length("rendered").cast("long"))

    key = ["conv_id", "perspective"]
    blocks = shown.groupBy(*key, "__block").agg(F.sum("__n").alias("__sum"))
    blocks = blocks.withColumn("__before", F.sum("__sum").over(Window.partitionBy(*key).orderBy("__block")) - F.col("__sum"))
    order = Window.partitionBy(*key, "__block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = (shown.withColumn("__upto", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .join(blocks.drop("__sum"), [*key, "__block"]))
    end = F.col("__before") + F.col("__upto")
    start = end - F.col("__n")
    return placed.select(
        *key, "turn", "role", "rendered", start.alias("start"), end.alias("end"), mine.alias("learn"),
        F.when(mine, start + F.col("__open")).alias("mask_start"),
        F.when(mine, end).alias("mask_end"))


#: The same in SQL, over the table of conversations.
SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
s AS (
  SELECT t.conv_id, perspective, turn, role, body, role = perspective AS learn,
         CASE WHEN role = perspective THEN '{OWN}' ELSE '{OTHER.split("{}")[0]}' || role || '{OTHER.split("{}")[1]}' END AS opening
  FROM t JOIN p ON t.conv_id = p.conv_id),
r AS (
  SELECT *, opening || body || '{CLOSE}' AS rendered,
         sum(length(opening || body || '{CLOSE}')) OVER (
           PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, body
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM s)
SELECT conv_id, perspective, turn, role, rendered, CAST(upto - length(rendered) AS BIGINT) AS start,
       CAST(upto AS BIGINT) AS "end", learn,
       CASE WHEN learn THEN CAST(upto - length(rendered) + length(opening) AS BIGINT) END AS mask_start,
       CASE WHEN learn THEN CAST(upto AS BIGINT) END AS mask_end
FROM r
"""
