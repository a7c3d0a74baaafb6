"""Percentiles of large columns with a guaranteed relative error, from mergeable counts.

A value lies in the bucket ceil(log(|x|) / log(gamma)) of its sign, gamma = (1 + error) / (1 - error); the middle of a
bucket is within ``error`` of all its values. Counts of equal buckets add up, so sketches of tasks, days or tables
merge by a group-by, and the percentile is read off the running count."""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ERROR = 0.01


def sketch(rows: DataFrame, keys: list[str], value: str, error: float = ERROR) -> DataFrame:
    """``keys``, ``sign`` (-1, 0, 1), ``bucket`` and ``n``: the sketch of each group as rows.

    Null and NaN values and infinities are left out. Null keys are a group. A double has at most about 1,420 / error
    buckets of either sign, so a group's sketch is bounded; counts are summed in each task before the shuffle, so a
    group with most of the rows moves no more than its buckets."""
    if not 0 < error < 1:
        raise ValueError("the error must lie between 0 and 1")
    x = F.col(value).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    width = math.log1p(2 * error / (1 - error))
    bucket = F.when(x == 0, 0).otherwise(F.ceil(F.log(F.abs(x)) / width)).cast("int")
    b = rows.filter(ok).select(*keys, F.signum(x).cast("int").alias("sign"), bucket.alias("bucket"))
    return b.groupBy(*keys, "sign", "bucket").agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of the rows of all: the same error, as if they had been counted together."""
    first, *others = sketches
    keys = [c for c in first.columns if c not in ("sign", "bucket", "n")]
    for s in others:
        first = first.unionByName(s)
    return first.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: list[str], wanted: tuple[float, ...], error: float = ERROR) -> DataFrame:
    """``keys``, ``q``, ``estimate``, ``low``, ``high``, ``n``: the value of rank floor(q * (n - 1)) is in
    [low, high], and within ``error`` of the estimate. The counts may be those of one sketch or of several, not yet
    merged. Groups without values have no rows."""
    if any(not 0 <= q <= 1 for q in wanted):
        raise ValueError("percentiles lie between 0 and 1")
    whole = merge(counts.select(*keys, "sign", "bucket", "n"))
    order = F.col("sign") * (F.col("bucket").cast("bigint") + 10_000_000)
    w = W.partitionBy(*keys)  # a group's buckets, a bounded number
    upto = F.sum("n").over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    run = whole.withColumn("upto", upto).withColumn("total", F.sum("n").over(w))
    run = run.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in wanted])))
    rank = F.floor(F.col("q") * (F.col("total") - 1))
    hit = run.filter((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
    width = math.log1p(2 * error / (1 - error))
    upper, lower = F.exp(F.col("bucket") * width), F.exp((F.col("bucket") - 1) * width)
    gamma, largest = (1 + error) / (1 - error), F.lit(sys.float_info.max)
    # the last bucket ends beyond the largest double, which then is the bound
    middle = F.when(upper <= largest, upper * (2 / (gamma + 1))).otherwise(F.least(lower * (2 * gamma / (gamma + 1)), largest))
    upper = F.least(upper, largest)
    zero = F.lit(0.0)
    pick = lambda pos, neg: F.when(F.col("sign") == 0, zero).when(F.col("sign") > 0, pos).otherwise(-neg)
    return hit.select(*keys, "q", pick(middle, middle).alias("estimate"), pick(lower, upper).alias("low"), pick(upper, lower).alias("high"), F.col("total").alias("n"))
