"""A distribution as one object: fit, sample, move, measure, save and load."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.operators import distribution as D
from embermill.operators import navigate as N
from embermill.operators.records import DEFAULT_BACKEND


def prefix(base: str, backend: str) -> str:
    """Where a backend's distribution lies, so that backends never clash: the default one's at ``base`` itself."""
    return base if backend == DEFAULT_BACKEND else f"{base}_{backend}"


def fresh_seed() -> int:
    """For a run whose seed isn't given; record it with the results, which are a function of it."""
    return secrets.randbelow(2**31)


@dataclass(frozen=True)
class Distribution:
    """What is known of a collection's tensors, as small tables: coordinates, total variance, and, if fitted, axes and
    corpus vectors. Methods take and give frames of (tensor, id, e) unless said otherwise."""

    coord: DataFrame
    total: DataFrame
    axes: DataFrame | None = None
    corpus: DataFrame | None = None

    @classmethod
    def fit(cls, vectors: DataFrame, components: int = 0, dim: int | None = None, hidden: int | None = None, corpus: int = D.MAX_CORPUS) -> Distribution:
        """Coordinates one by one, or pooled over ``hidden`` features; ``components`` axes if wanted."""
        coord = D.fit_pooled(vectors, hidden) if hidden else D.fit(vectors).drop("n")
        if components and dim is None:
            dim = vectors.select(F.size("e")).first()[0]
        axes = D.principal_axes(vectors, dim, components) if components else None
        return cls(coord, D.total_variance(vectors), axes, D.corpus_subset(vectors, corpus) if corpus else None)

    def sample(self, n: int, sampler: str = "diagonal", **knobs) -> DataFrame:
        return D.sample(n, self.coord, self.axes, self.corpus, sampler, **knobs)

    def distance(self, vectors: DataFrame) -> DataFrame:
        return D.distance(vectors, self.coord)

    def project(self, vectors: DataFrame, limit: float = 3.0) -> DataFrame:
        return D.project(vectors, self.coord, limit)

    def neighbourhood(self, anchors: DataFrame, n: int, radius: float, seed: int = 0) -> DataFrame:
        return N.neighbourhood(anchors, self.coord, n, radius, seed, self.axes)

    def walk(self, vectors: DataFrame, direction: str, steps: int, step: float, axis: int = 0, seed: int = 0) -> DataFrame:
        """outward, axis (needs fitted axes) or random."""
        if direction == "outward":
            return N.walk_outward(vectors, self.coord, steps, step)
        if direction == "axis":
            if self.axes is None:
                raise ValueError("a walk along an axis needs fitted axes")
            return N.walk_axis(vectors, self.axes, axis, steps, step)
        if direction == "random":
            return N.walk_random(vectors, self.coord, steps, step, seed)
        raise ValueError(f"unknown direction {direction!r}")

    def retarget(self, vectors: DataFrame, target: float) -> DataFrame:
        return N.retarget(vectors, self.coord, target)

    def floor_distance(self, vectors: DataFrame, floor: float) -> DataFrame:
        return N.floor_distance(vectors, self.coord, floor)

    def refit(self, elites: DataFrame, blend: float = 0.0, keep_axes: bool = False) -> Distribution:
        """From elites; axes and corpus are lost unless kept."""
        new = replace(self, coord=D.refit(self.coord, elites, blend))
        return new if keep_axes else replace(new, axes=None, corpus=None)

    def summary(self) -> DataFrame:
        return D.summary(self.coord, self.axes, self.total, self.corpus)

    def save(self, path: str, backend: str | None = None) -> list[str]:
        """Under ``path``, or with a backend under the path that is its own (``prefix``)."""
        return D.save(prefix(path, backend) if backend else path, self.coord, self.total, self.axes, self.corpus)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tensors: list[str] | None = None) -> Distribution:
        t = D.load(spark, path, tensors)
        return cls(t["coord"], t["meta"], t.get("axes"), t.get("corpus"))
