"""Lines that many documents hold, dropped from all of them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import saved

#: A line goes if its key has this many code points at least and is found in this many documents.
SHORTEST, DOCUMENTS = 1, 10
#: Stripped from both ends of a line; the line feed between lines is not part of one.
BLANKS = " \t\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, string.ascii_uppercase, string.ascii_lowercase), F.lit(BLANKS))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(id, text_hash, pos, h1, h2) of every line whose key is long enough: 128 bits stand for the key."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(whole).alias("text_hash"), F.posexplode(F.split(whole, "\n")).alias("pos", "line"))
    rows = rows.select("id", "text_hash", "pos", line_key(F.col("line")).alias("line")).where(F.length("line") >= shortest)
    return rows.select("id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def common_lines(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(h1, h2) of the keys that ``documents`` ids hold at least. A key that very many
    documents hold is spread by their ids first, and counted in parts then."""
    return (lines.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
            .where(F.col("n") >= documents).select("h1", "h2"))


def drop_common_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", documents: int = DOCUMENTS,
                      shortest: int = SHORTEST, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the lines left of each text, how many lines it had and how many went.

    Lines are exploded with their positions, hashed, and counted by the documents that hold them; the places of common
    lines are gathered per document, and the lines at all other places are joined again in their order. Only hashes
    and places are shuffled by line; a text moves once, to meet its own places.

    A missing or empty text is one empty line and stays empty. Rows of one id, and all rows without an id, are one document when
    documents are counted; each row keeps its own lines, repeated rows alike. A line common within a document counts once and
    goes everywhere. Texts of any length are taken whole. An empty table gives no rows. Columns called as the new ones
    are replaced, all others stay."""
    lines = saved(line_table(docs, key, text, shortest), "line-keys")
    common = saved(common_lines(lines, documents), "common-lines")
    places = (lines.join(common, ["h1", "h2"]).groupBy("id", "text_hash").agg(F.collect_set("pos").alias("places")))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("at"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    met = rows.join(places, F.col("at").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    met = met.select("row", "places", lines_of(F.col("row")[text]).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    cleaned = F.when(F.col("places").isNull(), F.coalesce(F.col("row")[text], F.lit(""))).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    new = {text: cleaned, n_lines: F.size("lines").cast("long"),
           n_dropped: F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")}
    return met.select(*[new.pop(c).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns],
                      *[column.alias(c) for c, column in new.items()])


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         trim(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
              chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key)
GROUP BY doc_id
"""
