"""Geometry of vectors as array<double> columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    """(1 - t) a + t b."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.zip_with(a, b, lambda x, y: (1.0 - t) * x + t * y)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def slerp(a: Column, b: Column, t: Column | float, least_norm: float = 1e-8, least_angle: float = 1e-4, raw: bool = False) -> Column:
    """Great-circle direction with a linear length.

    Vectors shorter than ``least_norm`` are interpolated linearly. Below ``least_angle`` the direction is
    interpolated linearly, or with ``raw`` the vectors themselves."""
    t = t if isinstance(t, Column) else F.lit(float(t))

    def directed(s: Column) -> Column:
        na, nb = s["na"], s["nb"]
        w = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["d"] / (na * nb))))
        size = (1.0 - t) * na + t * nb

        def turned(w: Column) -> Column:
            u, v = F.sin((1.0 - t) * w) / F.sin(w), F.sin(t * w) / F.sin(w)
            near = lerp(a, b, t) if raw else F.zip_with(a, b, lambda x, y: ((1.0 - t) * x / na + t * y / nb) * size)
            return F.when(w < least_angle, near).otherwise(F.zip_with(a, b, lambda x, y: (u * x / na + v * y / nb) * size))

        return F.when((na < least_norm) | (nb < least_norm), lerp(a, b, t)).otherwise(let(w, turned))

    return let(F.struct(norm(a).alias("na"), norm(b).alias("nb"), dot(a, b).alias("d")), directed)


def long_form(df, vector: str = "e", *keep: str):
    """(keep, pos, v): one row for each coordinate."""
    return df.select(*keep, F.posexplode(vector).alias("pos", "v"))


def wide_form(df, *keys: str):
    """The vectors back from (keys, pos, v), as ``e``."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("e"))
