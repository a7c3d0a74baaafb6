"""Closed-loop runs: generate, analyse now and then, explore what the frontier shows and hasn't been visited."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.sources.tables import table_or_empty


def hunt(spark: SparkSession, path: str, generate: Callable[[int], DataFrame], frontier: Callable[[DataFrame], DataFrame], explore: Callable[[DataFrame, int], DataFrame], rounds: int, every: int = 4, each: int = 2, seconds: float | None = None, stop: Callable[[], bool] = lambda: False) -> dict:
    """Rounds of generating; after every ``every``-th the first ``each`` unvisited items of the frontier are explored.

    ``generate`` (round) and ``explore`` (picked, round) give items, which are appended to ``<path>/items``;
    ``frontier`` (all items) gives (rel, place). What was explored is kept in ``<path>/visited``, so a run that is
    started again goes on and explores nothing twice. The item at hand is finished before ``stop`` or the time budget
    ends the run. Returns counts."""
    began, done, seen = time.monotonic(), 0, 0
    for number in range(1, rounds + 1):
        if stop() or (seconds is not None and time.monotonic() - began > seconds):
            break
        generate(number).write.mode("append").parquet(f"{path}/items")
        done += 1
        if number % every:
            continue
        visited = table_or_empty(spark, f"{path}/visited", "rel string")
        order = frontier(spark.read.parquet(f"{path}/items")).select("rel", "place")
        picked = order.join(visited, "rel", "left_anti").orderBy("place", "rel").limit(each).select("rel")
        picked = spark.createDataFrame(picked.collect(), "rel string")  # `each` names
        explore(picked, number).write.mode("append").parquet(f"{path}/items")
        picked.write.mode("append").parquet(f"{path}/visited")
        seen += picked.count()
    return {"rounds": done, "explored": seen}


def lost(jobs: DataFrame, awaited: int) -> bool:
    """Whether an awaited job can't be there any more: the newest known one is older."""
    newest = jobs.agg(F.max("id")).first()[0]
    return newest is None or newest < awaited
