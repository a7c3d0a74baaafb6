"""Writers: tables that are never clobbered, manifests, sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = ("path", "corpus", "temperature", "sampler", "coherence", "components", "guidance", "seed", "steps")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def free_path(spark: SparkSession, path: str) -> str:
    """The path itself, or with the first free number before its suffix."""
    stem, dot, suffix = path.rpartition(".")
    if not dot or "/" in suffix:
        stem, dot, suffix = path, "", ""
    n, out = 0, path
    while True:
        fs, p = _path(spark, out)
        if not fs.exists(p):
            return out
        n += 1
        out = f"{stem}_{n}{dot}{suffix}"


def write_once(df: DataFrame, path: str) -> str:
    """Write Parquet where nothing is yet; gives the path taken."""
    out = free_path(df.sparkSession, path)
    df.write.mode("errorifexists").parquet(out)
    return out


def append_manifest(df: DataFrame, path: str) -> None:
    """Append rows of a session's manifest as CSV with a header in each file; missing columns are empty."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in MANIFEST]
    df.select(*cols).write.mode("append").option("header", "true").csv(path)


def sidecars(df: DataFrame, key: str = "rel") -> DataFrame:
    """(key, meta_raw): every row's other columns as a JSON record, nulls left out."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("meta_raw"))


def merge_by_key(table: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """The table with rows of ``news`` in place of those of the same key; both have the same columns."""
    return table.join(news.select(key), key, "left_anti").unionByName(news)
