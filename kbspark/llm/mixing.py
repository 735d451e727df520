"""Mixing sources to target weights along a curriculum that varies with time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import n_words, saved, unused

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words that the mix takes, per word there is, and passes over a document at most.
BUDGET = 1.5
PASSES = 2
#: Weight of a source at the start and the end of training, repeating like WEIGHTS:
#: the heavy sources lead, the light ones come to the fore later.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Documents of a source that are ordered in one task, about.
SLICE = 65_536


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
                   passes: int = PASSES) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size), one row per source.

    Sources share ``budget`` times all sizes by weight. A target above ``passes``
    times its source's size stops there; the excess is shared again by weight
    until none is above. Each round is one sum over the sources and brings two
    numbers to the driver."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = saved(sizes.withColumn("rank", rank).withColumn("weight", weight)
                   .withColumn("most", F.col("source_size") * F.lit(float(passes))), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, left = None, None
    while True:
        full = F.lit(False) if share is None else F.col("weight") * share > F.col("most")
        row = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
                         F.count(F.when(~full, 1))).first()
        if not row[2] or row[2] == left:
            break
        left, share = row[2], (budget * total - row[0]) / row[1]
    if share is None:
        share = 0.0
    target = F.least(F.col("weight") * F.lit(float(share)), F.col("most"))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def demand_inverse(share: Column, start: Column, end: Column) -> Column:
    """Time in 0..1 at which a source has met ``share`` of its demand.

    The weight runs linearly from ``start`` to ``end``; its integral up to time
    t is start * t + (end - start) * t^2 / 2, and this is the root of that
    quadratic. Both weights are at least 0, and not both 0."""
    slope = end - start
    due = share * (start + end) / 2
    root = 2 * due / (start + F.sqrt(F.greatest(start * start + 2 * slope * due, F.lit(0.0))))
    return F.least(F.greatest(F.when(due > 0, root).otherwise(0.0), F.lit(0.0)), F.lit(1.0))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """Which documents a mix takes, and where in training each pass over one lies.

    Reads doc_id, text, source; other columns are ignored. One row per row of
    the input: doc_id, source, size, source_size, target, taken, takes. ``takes``
    holds a (position, words) for each pass that takes words of the document;
    position is the time in 0..1 at which the source's demand, integrated over
    its schedule, reaches the pass's middle. Rows are range-sorted by the
    position of their first take, those not taken last.

    Documents of a source follow each other in the order of a hash, again and
    again, until the target is met; the last one is taken in part. That order
    is cut into slices by hash, which are summed first, so a source that holds
    most rows is spread over many tasks. A missing source is a source of its
    own, a missing or empty text has size 0 and is not taken; repeated rows are
    documents of their own. Rows without doc_id are ordered by their texts. Texts of any length count whole. An
    empty table gives no rows. Options are those of ``_plan``."""
    return _in_order(_plan(docs, **options).drop("text_hash"))


def _in_order(rows: DataFrame) -> DataFrame:
    key = F.coalesce(F.try_element_at("takes", F.lit(1))["position"], F.lit(2.0))
    return rows.repartitionByRange(key.asc(), F.col("doc_id").asc()).sortWithinPartitions(key.asc(), F.col("doc_id").asc())


def _plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES,
          schedules: Sequence[tuple[float, float]] = SCHEDULES, seed: int = 17) -> DataFrame:
    """The rows of ``curriculum``, in no order, with a hash of each text."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                        F.xxhash64("text").alias("text_hash"),
                        F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id"), F.lit(seed)))
                        .otherwise(F.xxhash64(F.col("text"), F.lit(seed))).alias("place"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per_source = saved(per_source, "mix-sizes")
    rows = per_source.agg(F.max("rows")).first()[0] or 0
    slices = max(16, -(-rows // SLICE))
    targets = source_targets(per_source.drop("rows"), weights, budget, passes)
    placed = sized.withColumn("slice", F.pmod(F.shiftright("place", 20), F.lit(slices)))

    in_slice = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size", "text_hash")
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    sums = sums.withColumn("before", before)
    sums = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ordered = placed.withColumn("upto", F.sum("size").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ordered.join(sums, ordered["source"].eqNullSafe(sums["source"]) & (ordered["slice"] == sums["slice"]))
    joined = joined.drop(sums["source"]).drop(sums["slice"])
    begin = F.col("before") + F.col("upto") - F.col("size")

    cycle = len(schedules)
    step = (F.col("rank") % cycle + 1).cast("int")
    start = F.element_at(F.array(*[F.lit(float(a)) for a, _ in schedules]), step)
    end = F.element_at(F.array(*[F.lit(float(b)) for _, b in schedules]), step)
    takes = []
    for p in range(passes):
        first = begin + F.col("source_size") * p
        words = F.least(F.greatest(F.floor(F.col("target")) - first, F.lit(0)), F.col("size")).cast("long")
        share = (first + words / 2) / F.greatest(F.col("target"), F.lit(1.0))
        takes.append(F.when(words > 0, F.struct(demand_inverse(share, start, end).alias("position"), words.alias("words"))))
    out = joined.withColumn("takes", F.array_compact(F.array(*takes)))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: n + t["words"])
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.alias("taken"), "takes")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order, each as often as the mix takes at least
    half of its words: whole rows of ``docs``, range-sorted by position.

    The positions are joined to the rows by doc_id, source and text, missing ones included; rows equal
    in these three enter as often as the first of them. Missing and empty texts have no words and do not enter.
    Texts of any length stay whole, columns of any name stay. An empty table gives no rows."""
    same, takes, at = ("doc_id", "source", "text_hash"), unused(docs, "takes"), unused(docs, "at")
    names = [unused(docs, f"plan_{c}") for c in same]
    plan = _plan(docs, **options).withColumn("takes", F.filter("takes", lambda t: t["words"] * 2 >= F.col("size")))
    plan = plan.where(F.size("takes") > 0).groupBy(*same).agg(F.min("takes").alias("takes")).toDF(*names, takes)
    met = [x.eqNullSafe(F.col(n)) for x, n in zip((F.col("doc_id"), F.col("source"), F.xxhash64("text")), names)]
    rows = docs.join(plan, met[0] & met[1] & met[2]).withColumn(at, F.explode(F.col(takes)["position"]))
    rows = rows.repartitionByRange(F.col(at), F.col("doc_id")).sortWithinPartitions(at, "doc_id")
    return rows.select(*docs.columns)
