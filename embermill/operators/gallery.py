"""The stored files behind repeated scans of the gallery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embermill.functions.paths import folder_of, plain_path


def stored_files(items: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each stored file: ``path``, ``folder``, ``size`` and the ``carry`` columns of its latest scan.

    A scan row belongs to the file its ``rel`` resolves to. The latest ``scanned_at`` counts; rows without one count
    as oldest; among equal times a row with a size, then the larger size, then the larger carried values win. Files
    whose latest size is null no longer exist and are left out, as are rows whose ``rel`` resolves to nothing. The
    group-by is on the file, so neither a large folder nor a large job is one group. Other columns are ignored."""
    # a filter on the path would be pushed below and evaluate it twice; a generator leaves its nulls out in passing
    path = F.explode(F.array_compact(F.array(plain_path(F.col("rel"))))).alias("path")
    rows = items.select(path, "scanned_at", "size", *carry)
    latest = F.max(F.struct("scanned_at", "size", *carry)).alias("s")
    files = rows.groupBy("path").agg(latest).filter(F.col("s.size").isNotNull())
    return files.select("path", folder_of(F.col("path")).alias("folder"), "s.size", *[F.col(f"s.{c}").alias(c) for c in carry])
