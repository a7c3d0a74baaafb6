"""Evolution of a distribution by the cross-entropy method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embermill.functions.vector import wide_form
from embermill.operators import distribution as D
from embermill.session import cut


def objective(vectors: DataFrame, target: float) -> DataFrame:
    """(id, score): minus the root mean square distance of a vector's coordinates to ``target``."""
    d2 = F.aggregate(F.transform("e", lambda x: (x - target) * (x - target)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("id", (-F.sqrt(d2 / F.size("e"))).alias("score"))


def elites(scored: DataFrame, fraction: float, n: int) -> DataFrame:
    """The best max(1, round-half-even(n * fraction)) rows by score, ties to the higher id (as a rising argsort's end)."""
    return scored.orderBy(F.desc("score"), F.desc("id")).limit(max(1, round(n * fraction)))


def evolve(coord: DataFrame, score: Callable[[DataFrame], DataFrame], generations: int, population: int, fraction: float = 0.25, blend: float = 0.0, temperature: float = 1.0, truncation: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(coordinate statistics after the last generation, history of gen, mean_score, max_score, elite_mean).

    ``score``: (tensor, id, e) to (id, score), a score for every row. Each generation samples, scores, keeps the
    elites and refits; its small statistics are written to the checkpoint folder, so no lineage grows."""
    spark = coord.sparkSession
    history = []
    for g in range(generations):
        s = D.sample(population, coord, temperature=temperature, truncation=truncation, seed=seed + g)
        v = cut(wide_form(s.withColumnRenamed("row", "id"), "tensor", "id"))
        marks = cut(score(v).select("id", "score"))
        if marks.count() != population:
            raise ValueError(f"{marks.count()} scores for {population} samples")
        best = cut(elites(marks, fraction, population))
        m, e = marks.agg(F.avg("score"), F.max("score")).first(), best.agg(F.avg("score")).first()
        history.append((g, m[0], m[1], e[0]))
        coord = cut(D.refit(coord, v.join(F.broadcast(best.select("id")), "id", "left_semi"), blend))
    return coord, spark.createDataFrame(history, T.StructType.fromDDL("gen int, mean_score double, max_score double, elite_mean double"))


def improved(history: DataFrame) -> bool:
    """Whether the last generation's elites are at least as good as the first's, of at least two."""
    r = history.agg(F.count("*").alias("n"), F.max_by("elite_mean", "gen").alias("b"), F.min_by("elite_mean", "gen").alias("a")).first()
    return bool(r["n"] >= 2 and r["b"] >= r["a"])
