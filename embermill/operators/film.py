"""Films: easing, frame plans, trajectories through keyframes; sizes and tiles of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from embermill.functions.vector import lerp, slerp

EASINGS = ("linear", "smooth", "smoother")


def ease(t: Column, kind: str) -> Column:
    """Eased position, clamped to [0, 1]."""
    if kind not in EASINGS:
        raise ValueError(f"unknown easing {kind!r}, not in {EASINGS}")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return {"linear": t, "smooth": t * t * (3.0 - 2.0 * t), "smoother": t * t * t * (t * (t * 6.0 - 15.0) + 10.0)}[kind]


def frame_count(keys: int, per: int, loop: bool = False) -> int:
    if keys < 2 or per < 1:
        raise ValueError("a film needs at least 2 keyframes and 1 frame for each segment")
    return (keys if loop else keys - 1) * per + 1


def frame_plan(spark: SparkSession, keys: int, per: int, easing: str = "linear", loop: bool = False) -> DataFrame:
    """(frame, segment, t): ``per`` frames for each pair of neighbouring keyframes, and the last keyframe itself."""
    total = frame_count(keys, per, loop)
    segments = (total - 1) // per
    last = F.col("id") == total - 1
    plan = spark.range(total).select(
        F.col("id").alias("frame"),
        F.when(last, segments - 1).otherwise(F.floor(F.col("id") / per)).cast("int").alias("segment"),
        F.when(last, 1.0).otherwise((F.col("id") % per) / float(per)).alias("u"),
    )
    return plan.select("frame", "segment", ease(F.col("u"), easing).alias("t"))


def noise_window(t: Column, width: float, easing: str = "smooth") -> Column:
    """Position in a window of the given width around the middle, eased."""
    w = min(max(width, 1e-6), 1.0)
    return ease((t - (0.5 - w / 2)) / w, easing)


def keyed(keys: DataFrame, loop: bool = False) -> DataFrame:
    """(segment, a, b) from keyframes (ord, e): neighbouring pairs; with ``loop`` the last meets the first."""
    w = W.orderBy("ord")  # keyframes are a short list (at most 64 in a film)
    k = keys.withColumn("segment", (F.row_number().over(w) - 1).cast("int"))
    nxt = k.select((F.col("segment") - 1).alias("segment"), F.col("e").alias("b"))
    if loop:
        size = k.agg(F.max("segment").alias("m"))
        wrap = k.filter("segment = 0").crossJoin(size).select(F.col("m").alias("segment"), F.col("e").alias("b"))
        nxt = nxt.filter("segment >= 0").unionByName(wrap)
    return k.select("segment", F.col("e").alias("a")).join(nxt, "segment")


def trajectory(keys: DataFrame, plan: DataFrame, mode: str = "slerp", loop: bool = False, t: Column | None = None) -> DataFrame:
    """(frame, pos, v): the plan's frames between the keyframes. The pairs are a short list and are broadcast, the
    frames stay where they are."""
    if mode not in ("lerp", "slerp"):
        raise ValueError(f"unknown interpolation {mode!r}")
    t = F.col("t") if t is None else t
    f = plan.join(F.broadcast(keyed(keys, loop)), "segment")
    e = (lerp if mode == "lerp" else slerp)(F.col("a"), F.col("b"), t)
    return f.select("frame", F.posexplode(e).alias("pos", "v"))


def film_frames(conditioning: DataFrame, noise: DataFrame, plan: DataFrame, mode: str, width: float) -> DataFrame:
    """(frame, part, pos, v): conditioning by ``mode``, noise always on the arc, in its window of the eased t."""
    c = trajectory(conditioning, plan, mode).withColumn("part", F.lit("cond"))
    n = trajectory(noise, plan, "slerp", t=noise_window(F.col("t"), width)).withColumn("part", F.lit("noise"))
    return c.unionByName(n).select("frame", "part", "pos", "v")


def round_to(x: Column, multiple: int) -> Column:
    """The nearest multiple, halves to even, at least one multiple."""
    return F.greatest(F.lit(multiple), F.bround(x / multiple).cast("int") * multiple)


def target_size(width: Column, height: Column, factor: Column, most: int = 2048, multiple: int = 16) -> tuple[Column, Column]:
    """Width and height times the factor; scaled down together if the longer side goes beyond ``most``, then snapped."""
    shrink = F.least(F.lit(1.0), most / F.greatest(width * factor, height * factor))
    return round_to(width * factor * shrink, multiple), round_to(height * factor * shrink, multiple)


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of overlapping tiles; the last one ends flush with the length."""
    step = max(tile - overlap, 1)
    last = F.greatest(F.lit(0), length - tile)
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), last + step - 1, F.lit(step)), lambda s: F.least(s, last))))


def feather_blend(tiles: DataFrame) -> DataFrame:
    """(y, x, v) from (y, x, v, weight): the weighted mean, clipped to 0..255, where tiles overlap."""
    g = tiles.groupBy("y", "x").agg((F.sum(F.col("v") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-6))).alias("v"))
    return g.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("v"))))


def aspect_dims(area: Column, ratio: Column, multiple: int = 64) -> tuple[Column, Column]:
    """Width and height of an area with a ratio, halves up."""
    snap = lambda x: F.greatest(F.lit(multiple), F.floor(x / multiple + 0.5).cast("int") * multiple)
    return snap(F.sqrt(area * ratio)), snap(F.sqrt(area / ratio))
