"""Sliding-log limits, replayed over a whole request log.

A request is accepted while fewer than ``limit`` *accepted* requests of its
key lie in the window before it; refused ones are not remembered. The answer
of a request thus depends on earlier answers, but only where traffic is dense:
a request with no more than ``limit`` requests, refused or not, in its window
is accepted whatever came before. Only the dense stretches are replayed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark import constants as K
from kbspark.session import cut_lineage

SPAN = 16                  # windows per time bucket
SEGMENT_ROWS = 1_000_000   # rows replayed in one group, about


def limit_of(endpoint: Column, limits: dict[str, int]) -> Column:
    """Limit of an endpoint; null when it has none."""
    chain = F.lit(None).cast("int")
    for name, value in limits.items():
        chain = F.when(endpoint == name, value).otherwise(chain)
    return chain


def _overlapping(df: DataFrame, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows with their time ``bucket``, plus copies (``home`` false) in the
    next or previous bucket when they lie that close to it. Windows over
    (key, bucket) then see all they need and a busy key is split by time."""
    own = F.floor(F.col("us") / width)
    near = [F.struct(own.alias("bucket"), F.lit(True).alias("home"))]
    if before:
        near.append(F.when(F.col("us") > (own + 1) * width - before, F.struct((own + 1).alias("bucket"), F.lit(False).alias("home"))))
    if after:
        near.append(F.when(F.col("us") < own * width + after, F.struct((own - 1).alias("bucket"), F.lit(False).alias("home"))))
    spots = F.filter(F.array(*near), lambda s: s.isNotNull())
    return df.withColumn("_s", F.explode(spots)).select(*df.columns, "_s.bucket", "_s.home")


def trailing_counts(log: DataFrame, keys, window_us: int) -> DataFrame:
    """``raw``: requests of the key in (t - window, t], refused or not.

    A request counts from its own time until it leaves the window: both are marks on
    the time line, and a running sum of the marks is what is in the window. A frame that slides
    over the rows would count the whole window again for every row."""
    width = SPAN * window_us
    wide = _overlapping(log, width, before=window_us)
    leaves = F.col("us") + window_us
    marks = F.array(
        F.struct(F.col("us").alias("at"), F.lit(1).alias("step")),
        # Nothing of the bucket comes after its end.
        F.when(leaves < (F.col("bucket") + 1) * width, F.struct(leaves.alias("at"), F.lit(-1).alias("step"))))
    marked = wide.withColumn("_m", F.explode(F.filter(marks, lambda m: m.isNotNull())))
    upto = Window.partitionBy(*keys, "bucket").orderBy("_m.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.withColumn("raw", F.coalesce(F.sum("_m.step").over(upto), F.lit(0).cast("long")))
    return counted.filter(F.col("home") & (F.col("_m.step") > 0)).drop("home", "bucket", "_m")


def _dense_stretches(rows: DataFrame, keys, window_us: int) -> DataFrame:
    """Dense requests with the stretch they belong to. A new stretch begins
    after a window without a dense request: all before it is then known."""
    width = SPAN * window_us
    dense = _overlapping(rows.filter("dense"), width, before=window_us)
    order = Window.partitionBy(*keys, "bucket").orderBy("us", "event_id")
    gap = F.col("us") - F.lag("us").over(order)
    marked = dense.withColumn("first", (gap.isNull() | (gap >= window_us)).cast("long")).filter("home").drop("home")
    # Running number of the stretch: within the bucket, plus the buckets before.
    per_bucket = marked.groupBy(*keys, "bucket").agg(F.sum("first").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")
    offsets = per_bucket.select(*keys, "bucket", earlier.alias("offset"))
    return marked.join(offsets, [*keys, "bucket"]).withColumn(
        "stretch", F.col("offset") + F.sum("first").over(order)).drop("first", "offset", "bucket")


def _with_context(rows: DataFrame, stretches: DataFrame, keys, window_us: int) -> DataFrame:
    """What a replay needs: the dense requests and, of the others, those less
    than a window before a dense one of the stretch."""
    width = SPAN * window_us
    calm = rows.filter("not dense").withColumn("stretch", F.lit(None).cast("long"))
    both = _overlapping(calm.unionByName(stretches.select(*calm.columns)), width, after=window_us)
    # Backwards in time: a frame that ends with the group is read anew for each of its rows.
    ahead = Window.partitionBy(*keys, "bucket").orderBy(F.desc("us"), F.desc("event_id")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    coming = F.last(F.when(F.col("dense"), F.struct("us", "stretch")), ignorenulls=True).over(ahead)
    near = both.withColumn("coming", coming).filter("home").filter(F.col("coming.us") - F.col("us") < window_us)
    return near.withColumn("stretch", F.col("coming.stretch")).drop("coming", "home")


def _segmented(context: DataFrame, keys, window_us: int, segment_rows: int) -> DataFrame:
    """Cut stretches into segments of about ``segment_rows`` rows. Rows are
    counted per window, so a segment exceeds that by one window's rows at most."""
    group = [*keys, "stretch"]
    context = context.drop("bucket").withColumn("slot", F.floor(F.col("us") / window_us))
    sizes = context.groupBy(*group, "slot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("slot")) - F.col("n")
    cuts = sizes.select(*group, "slot", F.floor(before / F.lit(segment_rows)).cast("int").alias("segment"))
    return context.join(cuts, [*group, "slot"]).drop("slot")


def _replay(keys, window_us: int, schema: str):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "event_id"], kind="stable")
        times, n = np.empty(len(pdf), np.int64), 0  # of accepted requests, the first n in use
        accepted = pdf["known"].to_numpy(bool, copy=True)
        oldest = pdf["us"].to_numpy() - window_us
        for row, (us, limit) in enumerate(zip(pdf["us"], pdf["lim"])):
            # There is room if the limit-th last accepted request has left the window.
            if accepted[row] or n < limit or 0 < limit and times[n - limit] <= oldest[row]:
                accepted[row] = True
                times[n] = us
                n += 1
        pdf["accepted"] = accepted
        return pdf

    return one


def sliding_log(
    log: DataFrame, keys, limit: Column, window_seconds: int, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """The log's keys, us and event_id with ``accepted``. Requests are taken in
    (us, event_id) order; a null limit accepts everything.

    A stretch longer than ``segment_rows`` is replayed in several rounds. Each
    starts from the accepted requests of the last window, of which there are
    at most ``limit``, so groups stay bounded however busy a key is."""
    keys = list(keys)
    window_us = window_seconds * 1_000_000
    base = log.select(*keys, "us", "event_id", limit.cast("int").alias("lim"))
    free = base.filter("lim is null").withColumn("accepted", F.lit(True)).drop("lim")
    rows = trailing_counts(base.filter("lim is not null"), keys, window_us)
    rows = cut_lineage(rows.withColumn("dense", F.col("raw") > F.col("lim")).drop("raw"), "dense")
    calm = rows.filter("not dense").withColumn("accepted", F.lit(True))
    context = _with_context(rows, _dense_stretches(rows, keys, window_us), keys, window_us)
    parts = cut_lineage(_segmented(context, keys, window_us, segment_rows).withColumn("known", ~F.col("dense")), "segments")

    rounds = parts.agg(F.max("segment")).first()[0]
    columns = [*keys, "stretch", "us", "event_id", "lim", "dense", "known"]
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", accepted boolean"
    done, carry = [], None
    for segment in range(0, (rounds + 1) if rounds is not None else 0):
        todo = parts.filter(F.col("segment") == segment).select(*columns)
        if carry is not None:
            start = todo.groupBy(*keys, "stretch").agg(F.min("us").alias("start"))
            kept = carry.join(start, [*keys, "stretch"]).filter(F.col("us") > F.col("start") - window_us)
            # Carried rows keep their answer and are not reported again.
            todo = todo.unionByName(kept.select(*columns).withColumn("known", F.lit(True)).withColumn("dense", F.lit(False)))
        answered = cut_lineage(
            todo.groupBy(*keys, "stretch").applyInPandas(_replay(keys, window_us, schema), schema), "replayed")
        done.append(answered.filter("dense").select(*keys, "us", "event_id", "accepted"))
        carry = answered.filter("accepted")
    out = free.unionByName(calm.select(*free.columns))
    for part in done:
        out = out.unionByName(part)
    return out


def rate_limit(log: DataFrame, limits=None, window_seconds: int = K.RATE_WINDOW_SECONDS) -> DataFrame:
    """Requests per key and endpoint."""
    lim = limit_of(F.col("endpoint"), K.RATE_LIMITS if limits is None else limits)
    return sliding_log(log, ("api_key", "endpoint"), lim, window_seconds)


def abuse_limit(log: DataFrame, limits=None, window_seconds: int = K.ABUSE_WINDOW_SECONDS) -> DataFrame:
    """Requests per (hashed) address and endpoint."""
    lim = limit_of(F.col("endpoint"), K.ABUSE_LIMITS if limits is None else limits)
    return sliding_log(log, ("ip", "endpoint"), lim, window_seconds)
