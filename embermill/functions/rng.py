"""Random draws as a function of their key, the same in every engine, partitioning and retry.

The key ``seed|stream|row|pos|draw`` is hashed; the first 8 hexadecimal digits of its md5 give a uniform draw, and
with the next 8 a normal one. ``*_sql`` give the same expressions for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def key(seed: int, stream: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[p.cast("string") for p in parts])


def key_sql(seed: int, stream: str, *parts: str) -> str:
    return f"concat_ws('|', '{seed}', '{stream}', {', '.join(f'({p})::varchar' for p in parts)})"


def _word(k: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(k), at, 8), 16, 10).cast("double")


def _word_sql(k: str, at: int) -> str:
    return f"(('0x' || substr(md5({k}), {at}, 8))::bigint)::double"


def uniform(k: Column) -> Column:
    """In [0, 1)."""
    return _word(k, 1) / TWO32


def uniform_sql(k: str) -> str:
    return f"({_word_sql(k, 1)} / {TWO32:.1f}::double)"


def normal(k: Column) -> Column:
    """Standard normal (Box-Muller)."""
    return F.sqrt(-2.0 * F.log((_word(k, 1) + 1.0) / (TWO32 + 1.0))) * F.cos(2.0 * math.pi * _word(k, 9) / TWO32)


def normal_sql(k: str) -> str:
    return f"(sqrt(-2.0::double * ln(({_word_sql(k, 1)} + 1.0::double) / {TWO32 + 1:.1f}::double)) * cos(2.0::double * pi() * {_word_sql(k, 9)} / {TWO32:.1f}::double))"


def truncated(draw, limit: float, rounds: int = 8) -> Column:
    """A normal draw redrawn up to ``rounds`` times while it lies beyond ``limit``, then clipped. ``draw``: the normal
    draw of a number of a redraw (Column)."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(rounds)), lambda i: draw(i))
    ok = F.filter(draws, lambda z: F.abs(z) <= limit)
    last = F.element_at(draws, -1)
    return F.coalesce(F.get(ok, F.lit(0)), F.greatest(F.lit(-limit), F.least(F.lit(limit), last)))
