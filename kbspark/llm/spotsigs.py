"""Document fingerprints by SpotSigs: chains of content words that follow common words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: common words of four languages, the anchors; they are no content words.
ANCHORS = (
    "a an and are as at be been by for from had has have he in is it not of on or she that the they this to was were "
    "will with au aux ce dans de des du elle est et il la le les ne pas pour que qui sur un une auf das dem den der "
    "die ein eine es im ist mit nicht sich und von zu al con del el en las los lo no por se su y"
).split()
#: Content words in a chain; at the end of a text there may be fewer.
CHAIN = 3
#: Sets whose size bands are two or more apart have no greater Jaccard similarity.
FLOOR = 0.1
#: Rows that follow each other in one group of the neighbour search, about, and groups at most.
GROUP, GROUPS = 256, 4096

_MARK = "\u0001"


def spots(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit hashes of the chains that follow the anchors of a text.

    Words are runs of letters and digits in lower case. Each anchor is replaced
    by a mark; a chain is the next ``chain`` content words after a mark. The
    beginning of a text counts as an anchor, so only texts without a word have an
    empty set."""
    words = F.concat(F.lit(_MARK + " "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "),
                     F.lit(" "))
    marked = F.regexp_replace(words, f" (?:{'|'.join(ANCHORS)})(?= )", _MARK)
    chains = F.regexp_extract_all(
        marked, F.lit(f"{_MARK}(?!{_MARK})(?=((?: +[^ {_MARK}]+{_MARK}*){{1,{chain}}}))"), 1)
    return F.array_sort(F.array_distinct(F.transform(
        chains, lambda c: F.hash(F.regexp_replace(F.translate(c, _MARK, ""), " +", " ")))))


def fingerprint(spots: Column) -> Column:
    """The whole set as text; equal sets have equal fingerprints."""
    return F.array_join(spots.cast("array<string>"), ",")


def length_band(spots: Column, floor: float = FLOOR) -> Column:
    """Partition by set size: sets two or more bands apart differ by more than 1 / floor,
    so a search for likelier pairs may leave them out."""
    return F.floor(F.log(F.greatest(F.size(spots), F.lit(1))) / F.lit(-math.log(floor))).cast("int")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two sets of spots. Two empty sets are alike, an
    empty and another one are not."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def with_next(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with, as ``next_<column>``, values of the row that follows in
    descending key; the first row follows the last.

    Keys are cut into groups of about GROUP rows at quantiles, whatever their
    gaps. Every group gets a copy of the next group's first row, so one window
    by group finds all neighbours and texts are shuffled once. Rows of one key are
    ordered by text; missing keys come last."""
    stats = rows.agg(F.count("*").alias("n"), F.count(key).alias("known"), F.min(key).alias("least")).first()
    n, known = stats["n"], stats["known"]
    parts = min(GROUPS, max(1, known // GROUP))
    cuts: list[int] = []
    if known and parts > 1:
        shares = [i / parts for i in range(1, parts)]
        found = rows.agg(F.percentile_approx(key, shares, 50_000)).first()[0]
        cuts = sorted({c for c in found if c > stats["least"]})
    steps = [1 << b for b in reversed(range(max(len(cuts), 1).bit_length()))]
    bounds = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                        lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= F.col(key), step).otherwise(0))
    placed = rows.withColumn("__group", F.when(F.col(key).isNull(), -1).otherwise(place)).withColumn("__copy", F.lit(0))

    last = -1 if known < n else 0
    first = len(cuts) if known else -1
    heads = placed.groupBy("__group").agg(F.max(key).alias("__key"))  # a row for each of at most GROUPS + 1 groups
    heads = heads.select(F.col("__group").alias("__of"), "__key")
    copies = placed.join(F.broadcast(heads), (F.col("__group") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")))
    before = F.when(F.col("__of") == first, F.lit(last)).otherwise(F.col("__of") + 1)
    order = [F.col(key).desc_nulls_last(), F.col("text")]
    top = F.row_number().over(Window.partitionBy("__of").orderBy(F.col("text")))
    copies = (copies.withColumn("__row", top).where("__row = 1").withColumn("__group", before).withColumn("__copy", F.lit(1))
              .select(placed.columns))
    window = Window.partitionBy("__group").orderBy("__copy", *order)
    both = placed.unionByName(copies)
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(window))
    return both.where("__copy = 0").drop("__group", "__copy")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", floor: float = FLOOR) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, one row per row.

    The edited text ends with as many characters of the next document, in
    descending key, as half the text has (all of it where that is shorter).
    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_spots, length_band. A missing text is empty; a
    table of one row is its own next; an empty table gives no rows; repeated
    rows follow each other; other columns are ignored."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("spots", spots(F.col("text")))
    rows = with_next(rows, "key", ["text", "spots"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("key", n.cast("long").alias("n_chars"), "spots", "next_spots", edited.alias("edited"))
    rows = rows.withColumn("edited_spots", spots(F.col("edited")))
    return rows.select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        F.size("spots").alias("n_spots"), length_band(F.col("spots"), floor).alias("length_band"))
