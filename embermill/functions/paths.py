"""File paths of the gallery in their plain form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_path(rel: Column, root: str = "outputs") -> Column:
    """The plain form of a stored path below ``root``: relative, single forward slashes, no escapes, dot segments,
    surrounding blanks, URL or ``root`` prefix; letter case is kept.

    Null, blank and segmentless paths give null. A percent sign that starts no valid escape leaves the text as it is.
    ``..`` above the root is dropped."""
    blank = r"^[\s\x{a0}]+|[\s\x{a0}]+$"
    # one chain without a repeated operand: Catalyst would evaluate each repetition anew
    x = F.regexp_replace(rel, blank, "")
    x = F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    x = F.regexp_replace(x, r"^[^?]*\?(?:[^#]*&)?path=([^&#]*).*$", "$1")
    # url_decode reads "+" as a blank, which is only right for forms, and fails on a stray percent sign
    x = F.url_decode(F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))
    x = F.translate(F.regexp_replace(x, blank, ""), "\\", "/")
    x = F.regexp_replace(F.concat(F.lit("/"), x, F.lit("/")), r"/(?:\.?/)+", "/")

    def climbed(p: Column) -> Column:
        parts = F.filter(F.split(p, "/"), lambda s: s != "")
        up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s))))
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.lit("/"))

    # only paths with ".." pay for the fold over their segments; the lambda's variable stands for the chain above
    x = F.transform(F.array(x), lambda p: F.when(p.contains("/../"), climbed(p)).otherwise(p))[0]
    return F.nullif(F.regexp_replace(x, rf"^/+(?:{root}/)?|/+$", ""), F.lit(""))


def folder_of(path: Column) -> Column:
    """The path up to its last slash; empty for a file that lies in no folder."""
    return F.regexp_replace(path, r"/?[^/]*$", "")
