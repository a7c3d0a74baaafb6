"""Preference from favourites: the resonance model, and choices driven by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from embermill.functions import rng

MIN_POSITIVES, NEGATIVES, STEPS, RATE, L2 = 8, 5, 400, 0.5, 1e-3
MAX_POSITIVES = 20_000  # favourites that train the model (by a hash of their id): what one task holds is bounded


def training_rows(vectors: DataFrame, favourites: DataFrame, seed: int = 0, most: int = MAX_POSITIVES) -> DataFrame:
    """(id, e, y): favourites, and five times as many others by a hash of their id (all, where there are fewer)."""
    order = [F.md5(rng.key(seed, "resonance", F.col("id"))), F.col("id")]
    fav = favourites.select("id").distinct()
    pos = vectors.join(fav, "id", "left_semi").select("id", "e").orderBy(*order).limit(most)
    n = pos.count()
    if n < MIN_POSITIVES:
        return pos.limit(0).withColumn("y", F.lit(1.0))
    neg = vectors.join(fav, "id", "left_anti").select("id", "e").orderBy(*order).limit(NEGATIVES * n)
    return pos.withColumn("y", F.lit(1.0)).unionByName(neg.withColumn("y", F.lit(0.0)))


def fit_resonance(rows: DataFrame, steps: int = STEPS, rate: float = RATE) -> np.ndarray | None:
    """Weights and bias after exactly ``steps`` full-batch steps of class-balanced logistic regression, the penalty on
    the weights only; None for too few favourites. The bounded training rows are held by one task."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y = np.stack(pdf["e"].to_numpy()).astype(float), pdf["y"].to_numpy()
        p = max(y.sum(), 1)
        weight = np.where(y == 1, len(y) / (2 * p), len(y) / (2 * max(len(y) - p, 1)))
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(steps):
            g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
            w, b = w - rate * (x.T @ g + L2 * w), b - rate * g.sum()
        return pd.DataFrame({"w": [list(w) + [b]]})

    got = rows.groupBy().applyInPandas(train, "w array<double>").first()
    return np.array(got["w"]) if got else None


def resonance(vectors: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(id, resonance): the probability for every vector, 4 digits; no rows without a model."""
    if weights is None:
        return vectors.select("id", F.lit(0.0).alias("resonance")).limit(0)
    w, b = F.array(*[F.lit(float(x)) for x in weights[:-1]]), float(weights[-1])
    z = F.aggregate(F.zip_with("e", w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + b
    return vectors.select("id", F.round(1 / (1 + F.exp(-z)), 4).alias("resonance"))


def first_gradient(rows: DataFrame, rate: float = RATE) -> DataFrame:
    """(pos, w): the weights after the first step, in closed form: at zero every probability is a half."""
    n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    c = rows.crossJoin(F.broadcast(n))
    weight = F.when(F.col("y") == 1, F.col("n") / (2 * F.col("p"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("p"))))
    g = c.select((weight * (0.5 - F.col("y")) / F.col("n")).alias("g"), F.posexplode("e").alias("pos", "x"))
    return g.groupBy("pos").agg((-rate * F.sum(F.col("g") * F.col("x"))).alias("w"))


def weighted_choice(counts: DataFrame, draws: DataFrame, prior: float | dict[str, float] = 1.0) -> DataFrame:
    """(draw, choice): for each uniform ``u`` the option whose share of count + prior it falls into, options by name.
    ``counts`` (option, n) is a short list of options and is broadcast. With a prior for each option, these are the
    options, and those that weren't counted have their prior alone."""
    if isinstance(prior, dict):
        p = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in prior.items()], "option string, prior double")
        counts = p.join(counts, "option", "left").select("option", (F.coalesce("n", F.lit(0)) + F.col("prior")).alias("weight"))
    else:
        counts = counts.select("option", (F.col("n") + prior).alias("weight"))
    w = W.orderBy("option").rowsBetween(W.unboundedPreceding, 0)
    c = counts.withColumn("upto", F.sum("weight").over(w))
    total = counts.agg(F.sum("weight").alias("total"))
    c = c.crossJoin(F.broadcast(total)).select("option", (F.col("upto") / F.col("total")).alias("upto"))
    return draws.join(F.broadcast(c), F.col("u") < F.col("upto")).groupBy("draw").agg(F.min_by("option", "upto").alias("choice"))


ARM_POINTS, LEAST_SPREAD = 10, 0.35


def strategy_arm(u: Column, points: Column) -> Column:
    """free below 0.30; band below 0.55 if there are 10 points, else free*; axes below 0.80; else hybrid."""
    return F.when(u < 0.30, "free").when(u < 0.55, F.when(points >= ARM_POINTS, F.lit("band")).otherwise("free*")).when(u < 0.80, "axes").otherwise("hybrid")


def band_target(normal: Column, mean: Column, spread: Column) -> Column:
    """A distance drawn around the starred ones, whose spread counts as at least 0.35, between 1.3 and 2.4."""
    return F.least(F.lit(2.4), F.greatest(F.lit(1.3), mean + F.greatest(F.lit(LEAST_SPREAD), spread) * normal))


def scored(rows: DataFrame, scorer, column: str = "score") -> DataFrame:
    """``rows`` with the scores of a batch scorer (a function of a pandas frame to as many numbers); another number of
    scores is an error."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s = np.asarray(scorer(pdf), float)
            if s.shape != (len(pdf),):
                raise ValueError(f"{s.shape} scores for {len(pdf)} rows")
            yield pdf.assign(**{column: s})

    from pyspark.sql import types as T

    return rows.mapInPandas(batches, T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())]))


SCORERS: dict[str, object] = {}


def scorer(name: str):
    """Register a scorer factory under a name, without regard to case."""

    def put(f):
        SCORERS[name.lower()] = f
        return f

    return put


def get_scorer(name: str, **options):
    if name.lower() not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}, not in {sorted(SCORERS)}")
    return SCORERS[name.lower()](**options)


@scorer("random")
def random_scorer(seed: int = 0, id: str = "id"):
    """Between 0 and 10 by a hash of the id, the same in every run."""
    import hashlib

    return lambda pdf: [int(hashlib.md5(f"{seed}|score|{i}".encode()).hexdigest()[:8], 16) / 2**32 * 10 for i in pdf[id]]
