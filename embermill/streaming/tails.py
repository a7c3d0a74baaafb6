"""Structured Streaming: resumable log tails, bounded tails, incremental scores, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEEP, DROP = 5000, 1000


def lines_source(spark: SparkSession, folder: str, schema: str = "job_id bigint, seq bigint, line string") -> DataFrame:
    """New log files of a folder as a stream; where a run ended, its checkpoint remembers."""
    return spark.readStream.schema(schema).parquet(folder)


def tail(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append the stream's lines to a table; started again with its checkpoint it goes on where it stopped and repeats
    nothing."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def kept_count(n: int, keep: int = KEEP, drop: int = DROP) -> int:
    """How many of ``n`` appended lines a buffer holds that loses its oldest ``drop`` when it exceeds ``keep``."""
    return n if n <= keep else keep - drop + 1 + (n - keep - 1) % drop


def bounded_tail(lines: DataFrame, keep: int = KEEP, drop: int = DROP) -> DataFrame:
    """The lines that each job's bounded buffer would hold now (batch form). How far a line is from its job's end
    comes from the job's count; the window then sorts no more than the last ``keep`` lines of a job."""
    n = lines.groupBy("job_id").agg(F.count("*").alias("n"))
    held = F.when(F.col("n") <= keep, F.col("n")).otherwise(keep - drop + 1 + (F.col("n") - keep - 1) % drop)
    w = W.partitionBy("job_id").orderBy(F.desc("seq"), F.desc("line"))
    last = lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    return last.join(n.withColumn("_held", held), "job_id").filter(F.col("_r") <= F.col("_held")).drop("_r", "_held", "n")


def bounded_tail_stream(stream: DataFrame, keep: int = KEEP, drop: int = DROP) -> DataFrame:
    """(job_id, appended, first_kept): the state of each job's buffer after every batch (update mode). The state is
    two numbers a job."""

    def count(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            n += len(pdf)
        state.update((n,))
        yield pd.DataFrame({"job_id": [key[0]], "appended": [n], "first_kept": [n - kept_count(n, keep, drop)]})

    return stream.groupBy("job_id").applyInPandasWithState(count, "job_id bigint, appended bigint, first_kept bigint", "n bigint", "update", "NoTimeout")


def incremental_scores(stream: DataFrame, path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], key: str = "rel"):
    """Score the stream's new keys and append them to a table; keys that are there already aren't scored again, so a
    repeated batch changes nothing."""
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        todo = df.dropDuplicates([key])
        if there:
            todo = todo.join(spark.read.parquet(path).select(key), key, "left_anti")
        score(todo).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type in tumbling windows, for batch and stream alike; late rows are waited for as
    long as ``late``. An extension beside the reference's operators."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
