"""Moving through embedding space: neighbourhoods, walks, shells, breeding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embermill.functions import rng
from embermill.functions.vector import lerp, slerp
from embermill.operators import distribution as D


def neighbourhood(anchors: DataFrame, coord: DataFrame, n: int, radius: float, seed: int, axes: DataFrame | None = None) -> DataFrame:
    """(tensor, id, row, pos, v): ``n`` vectors around each anchor, anchor + radius * deviation; along the principal
    axes where they are fitted."""
    dev = D.axis_deviations(axes, n, seed) if axes is not None else D.deviations(coord, n, seed).select("tensor", "row", "pos", "dev")
    a = anchors.select("tensor", "id", F.posexplode("e").alias("pos", "a"))
    return a.join(dev, ["tensor", "pos"]).select("tensor", "id", "row", "pos", (F.col("a") + radius * F.col("dev")).alias("v"))


def walk_outward(vectors: DataFrame, coord: DataFrame, steps: int, step: float) -> DataFrame:
    """(tensor, id, i, e): the mean plus the vector's deviation times 1 + step * (i + 1), i < steps."""
    stats = D._as_arrays(coord, "mean")
    w = vectors.join(F.broadcast(stats), "tensor").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    factor = 1.0 + step * (F.col("i") + 1)
    return w.select("tensor", "id", "i", F.zip_with("e", "mean", lambda x, m: m + (x - m) * factor).alias("e"))


def walk_axis(vectors: DataFrame, axes: DataFrame, axis: int, steps: int, step: float) -> DataFrame:
    """(tensor, id, i, e): steps of one axis' std along it; the axis' number counts modulo the axes there are."""
    m = axes.groupBy("tensor").agg(F.count("*").alias("m"))
    one = axes.join(m, "tensor").filter(F.col("k") == F.pmod(F.lit(axis), F.col("m"))).select("tensor", "axis", "std")
    w = vectors.join(F.broadcast(one), "tensor").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    by = step * (F.col("i") + 1) * F.col("std")
    return w.select("tensor", "id", "i", F.zip_with("e", "axis", lambda x, u: x + by * u).alias("e"))


def walk_random(vectors: DataFrame, coord: DataFrame, steps: int, step: float, seed: int) -> DataFrame:
    """(tensor, id, i, e): steps in one random direction, drawn once for each tensor."""
    dev = D.deviations(coord, 1, seed, stream="walk")
    one = D._as_arrays(dev.select("tensor", "pos", "dev"), "dev")
    w = vectors.join(F.broadcast(one), "tensor").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    by = step * (F.col("i") + 1)
    return w.select("tensor", "id", "i", F.zip_with("e", "dev", lambda x, d: x + by * d).alias("e"))


def retarget(vectors: DataFrame, coord: DataFrame, target: float) -> DataFrame:
    """Every vector moved along its deviation from the mean to distance ``target``."""
    stats = D._as_arrays(D.floored(coord), "mean", "sd")
    d = vectors.join(F.broadcast(stats), "tensor")
    z2 = F.zip_with(F.zip_with("e", "mean", lambda x, m: x - m), "sd", lambda a, s: (a / s) * (a / s))
    d = d.withColumn("d", F.sqrt(F.aggregate(z2, F.lit(0.0), lambda a, x: a + x) / F.size("e")))
    f = target / F.greatest("d", F.lit(1e-6))
    return d.select("tensor", "id", F.zip_with("e", "mean", lambda x, m: m + (x - m) * f).alias("e"))


def floor_distance(vectors: DataFrame, coord: DataFrame, floor: float) -> DataFrame:
    """Ids whose mean distance over their tensors is below ``floor`` moved out to it, all tensors by one factor."""
    mean = D.distance_over_tensors(D.distance(vectors, coord)).withColumnRenamed("distance", "d")
    v = vectors.join(mean, "id").join(F.broadcast(D._as_arrays(coord, "mean")), "tensor")
    f = F.when(F.col("d") < floor, floor / F.greatest("d", F.lit(1e-6))).otherwise(1.0)
    return v.select("tensor", "id", F.zip_with("e", "mean", lambda x, m: m + (x - m) * f).alias("e"))


def linear_walk(pairs: DataFrame, steps: int) -> DataFrame:
    """(id, i, e) from pairs (id, a, b): both ends included; a single step gives the first."""
    p = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return p.select("id", "i", lerp(F.col("a"), F.col("b"), F.col("i") / float(max(steps - 1, 1))).alias("e"))


def breed(pairs: DataFrame, n: int, mutate: float = 0.0, coord: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(tensor, id, i, pos, v) from pairs (tensor, id, a, b): ``n`` children at t from 0.15 to 0.85 on the arc between
    the parents, with ``mutate`` times a deviation added."""
    p = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.lit(0.15) + 0.7 * F.col("i") / float(max(n - 1, 1))
    c = p.select("tensor", "id", "i", F.posexplode(slerp(F.col("a"), F.col("b"), t)).alias("pos", "v"))
    if mutate <= 0:
        return c
    c = c.join(F.broadcast(coord.select("tensor", "pos", "std")), ["tensor", "pos"])
    z = rng.normal(rng.key(seed, "breed", F.col("tensor"), F.col("id"), F.col("i"), F.col("pos")))
    return c.select("tensor", "id", "i", "pos", (F.col("v") + mutate * F.col("std") * z).alias("v"))
