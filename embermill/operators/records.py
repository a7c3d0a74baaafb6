"""Records and text of the studio: names, lists, casts, sidecars, arithmetic fields."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Backends in the order in which their names are looked for, and what a missing one means.
BACKENDS, DEFAULT_BACKEND = ("flux2", "krea2", "sdxl", "sd2"), "sd15"


def _named(name: Column, backends: tuple[str, ...], end: str = "_") -> Column:
    """The first of the backends that a file's name tells behind the studio's mark, or null. Letter case counts."""
    c = F.when(F.lit(False), F.lit(""))
    for b in backends:
        c = c.when(name.contains(f"anarchy_{b}{end}"), b)
    return c


def backend_of(name: Column) -> Column:
    """The backend that a file's name tells."""
    return F.coalesce(_named(name, BACKENDS), F.lit(DEFAULT_BACKEND))


def starred_backend(name: Column) -> Column:
    """The backend of a starred image; null where its name tells none."""
    return _named(name, ("sdxl", "sd15", "sd2", "flux2", "krea2"))


def backend_variants(name: Column, sidecar: Column) -> dict[str, Column]:
    """How the reference's tools tell a backend, which differ: by the name alone; by the sidecar first (films); for
    refining, where the two flow models count as sdxl and nothing need follow the backend; for upscaling, which knows
    three and ignores any other sidecar; for inverting, which takes what stands behind the mark that begins the name."""
    by_name = backend_of(name)
    three = ("sd15", "sd2", "sdxl")
    refine = F.when(_named(name, ("sdxl", "flux2", "krea2"), "").isNotNull(), "sdxl")
    return {
        "by_name": by_name,
        "film": F.coalesce(F.nullif(sidecar, F.lit("")), by_name),
        "refine": F.coalesce(refine, _named(name, ("sd2",), ""), F.lit(DEFAULT_BACKEND)),
        "upscale": F.coalesce(F.when(sidecar.isin(*three), sidecar), _named(name, three), F.lit(DEFAULT_BACKEND)),
        "invert": F.regexp_extract(name, r"^anarchy_([a-z0-9]+)_", 1),
    }


def clean_numbers(text: Column) -> Column:
    """A comma-separated list of numbers, trimmed and joined again; null if one is no number."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.forall(parts, lambda p: p.try_cast("double").isNotNull()), F.array_join(parts, ","))


def slug(text: Column, most: int = 40) -> Column:
    s = F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "-")
    return F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, most)


def unique_names(df: DataFrame, name: str, order: str, suffix: str = "_", first: int = 1) -> DataFrame:
    """``unique``: the name, from its second use on with a number (``first`` for the second), in the order given."""
    w = W.partitionBy(name).orderBy(order)
    n = F.row_number().over(w)
    return df.withColumn("unique", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(suffix), (n - 2 + first).cast("string"))))


def first_kept(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given. A row of an often repeated key is dropped in its own task
    already."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 1).drop("_r")


def merged(meta: Column, fields: Column) -> Column:
    """Two string maps, the second one's entries winning; null maps count as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(meta, empty), F.coalesce(fields, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def as_number(text: Column) -> Column:
    """Browser text as a number: blank and what is no number give null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def as_flag(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "1", F.lit(False))


def byte_size(n: Column) -> Column:
    """Bytes as the gallery shows them: above a million in millions with one digit (the nearer tenth, of two equally
    near ones the larger), else in rounded thousands."""
    million = n / 1e6
    tenth = F.floor(million * 10)
    tenth = F.when(million - tenth / 10 < (tenth + 1) / 10 - million, tenth).otherwise(tenth + 1)
    large = F.concat(F.floor(tenth / 10).cast("string"), F.lit("."), F.pmod(tenth, F.lit(10)).cast("string"), F.lit("M"))
    return F.when(n > 1_000_000, large).otherwise(F.concat(F.floor(n / 1e3 + 0.5).cast("string"), F.lit("K")))


def duration(started: Column, ended: Column) -> Column:
    """The time between two timestamps, in whole seconds, from a minute on in minutes and seconds; empty without a
    start."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    s = F.greatest(F.lit(0), F.floor((micros(ended) - micros(started)) / 1e6 + 0.5))
    text = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    return F.when(started.isNull(), "").otherwise(text)


def move(df: DataFrame, at: int, to: int) -> DataFrame:
    """A list (ord from 0, item) with the item at ``at`` moved to ``to`` (clamped); an ``at`` outside changes nothing."""
    n = df.agg(F.max("ord")).first()[0]
    if n is None or not 0 <= at <= n:
        return df
    to = min(max(to, 0), n)
    o = F.col("ord")
    if at <= to:
        new = F.when(o == at, to).when((o > at) & (o <= to), o - 1).otherwise(o)
    else:
        new = F.when(o == at, to).when((o >= to) & (o < at), o + 1).otherwise(o)
    return df.withColumn("ord", new.cast("int"))


# --- arithmetic -----------------------------------------------------------------------------------------------------


_LEXEME = re.compile(r" *(?:([0-9]*\.?[0-9]+)|([-+*/%^()]))")


class _Sum:
    """Recursive descent over lexemes: sums of products of powers (to the right). A sign belongs to the number or
    parenthesis behind it, so it binds tighter than a power. Only blanks may separate lexemes."""

    def __init__(self, text: str):
        self.lexemes: list = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _LEXEME.match(text, at)
            if not m:
                raise ValueError(f"{text[at]!r} in an expression")
            self.lexemes.append(float(m.group(1)) if m.group(1) else m.group(2))
            at = m.end()

    def _take(self, wanted: str) -> str:
        head = self.lexemes[0] if self.lexemes else None
        return self.lexemes.pop(0) if isinstance(head, str) and head in wanted else ""

    def sum(self) -> float:
        v = self.product()
        while op := self._take("+-"):
            w = self.product()
            v = v + w if op == "+" else v - w
        return v

    def product(self) -> float:
        v = self.power()
        while op := self._take("*/%"):
            w = self.power()
            v = v * w if op == "*" else v / w if op == "/" else math.fmod(v, w)
        return v

    def power(self) -> float:
        v = self.atom()
        return float(v ** self.power()) if self._take("^") else v

    def atom(self) -> float:
        if op := self._take("+-"):
            v = self.atom()
            return -v if op == "-" else v
        if self._take("("):
            v = self.sum()
            if not self._take(")"):
                raise ValueError("unclosed")
            return v
        if not self.lexemes or isinstance(self.lexemes[0], str):
            raise ValueError("a number is missing")
        return self.lexemes.pop(0)


def calculate(text: str | None) -> float | None:
    """The value of an arithmetic expression; None for anything else, and where it isn't finite."""
    if text is None or not text.strip():
        return None
    try:
        p = _Sum(text)
        v = p.sum()
        return float(v) if not p.lexemes and not isinstance(v, complex) and math.isfinite(v) else None
    except (ValueError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


def field_text(text: str | None, whole: bool) -> str | None:
    """What a number field shows after an expression was typed: its value, rounded to whole or to six digits, halves
    up; None where there is nothing to change."""
    v = calculate(text)
    if v is None:
        return None
    n = math.floor(v + 0.5) if whole else math.floor(v * 1e6 + 0.5) / 1e6
    shown = f"{n:.6f}".rstrip("0").rstrip(".")
    shown = "0" if shown == "-0" else shown
    return None if shown == text.strip() else shown


def with_field(df: DataFrame, text: str, whole: str, out: str = "shown") -> DataFrame:
    """``df`` with what the fields show; ``whole`` names a boolean column."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def shown(s: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([field_text(a, bool(b)) for a, b in zip(s, w)], dtype=object)

    return df.withColumn(out, shown(F.col(text), F.col(whole)))


def with_value(df: DataFrame, text: str, out: str = "value") -> DataFrame:
    """``df`` with the value of the expressions in a column; Arrow batches, since no built-in function parses."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def calc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(calculate).astype("float64")

    return df.withColumn(out, calc(F.col(text)))
