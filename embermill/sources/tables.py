"""Readers of the studio's tables and of the reference-shaped inputs (prompt files, caches, PNG headers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data directory, a file or a folder of files: ``<root>/<name>.parquet``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def table_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A cache that may not exist yet: an empty frame of the given schema where nothing is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def prompt_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Prompts of a text corpus: trimmed lines without blank ones and ``#`` comments. Nulls count as blank."""
    t = F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return lines.withColumn("prompt", t).filter((F.col("prompt") != "") & ~F.col("prompt").startswith("#"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """A prompt corpus file or folder as rows of ``prompt``."""
    return prompt_lines(spark.read.text(path)).select("prompt")


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Path, height and width of the image files below a folder, from bytes 17 to 24 of the PNG header; null sizes
    where a file is no PNG."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("int")
    ok = F.substring(head, 1, 16) == F.lit("89504E470D0A1A0A")
    return raw.select(
        "path", "length", "modificationTime", F.when(ok, number(41)).alias("height"), F.when(ok, number(33)).alias("width")
    )


def read_films(spark: SparkSession, path: str) -> DataFrame:
    """The films below a folder (``<film>/*.mp4``) with what their ``film.json`` says, newest first."""
    from embermill.operators.library import films

    below = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    parts = F.split("path", "/")
    videos = below("*.mp4").select(F.element_at(parts, -2).alias("dir"), F.element_at(parts, -1).alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    manifests = below("film.json").select(F.element_at(parts, -2).alias("dir"), F.col("content").cast("string").alias("text"))
    return films(videos, manifests)
