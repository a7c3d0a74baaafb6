"""Distributions over embedding collections: fit, principal axes, distance, sampling, refit, save and load.

A collection is rows of (tensor, id, e): one vector each. Coordinate statistics are (tensor, pos, mean, std), principal
axes (tensor, k, std, axis). Standard deviations of coordinates are of the population, those of axes and the total
variance of the sample (n - 1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from embermill.functions import rng
from embermill.functions.vector import dot, let, long_form, slerp

LEAST_STD = 1e-4
MAX_CORPUS = 256
FLOOR = 0.1  # of the mean std, below which a coordinate's std isn't believed when distances are taken


def fit(vectors: DataFrame) -> DataFrame:
    """Mean, population std (at least 1e-4) and n of each coordinate of each tensor.

    Null vectors and coordinates count for nothing. Sums are made in each task, so what is shuffled is one row per
    coordinate and task."""
    c = long_form(vectors, "e", "tensor")
    return c.groupBy("tensor", "pos").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(LEAST_STD)).alias("std"), F.count("v").alias("n"))


def fit_pooled(vectors: DataFrame, hidden: int) -> DataFrame:
    """As ``fit``, with one mean and std for each of ``hidden`` features, over all tokens; given for each position."""
    c = long_form(vectors, "e", "tensor").withColumn("feature", F.col("pos") % hidden)
    f = c.groupBy("tensor", "feature").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(LEAST_STD)).alias("std"))
    size = c.groupBy("tensor").agg(F.max("pos").alias("last"))
    at = size.select("tensor", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("pos")).withColumn("feature", F.col("pos") % hidden)
    return at.join(f, ["tensor", "feature"]).select("tensor", "pos", "mean", "std")


def total_variance(vectors: DataFrame) -> DataFrame:
    """Sum of the sample variances of all coordinates; 0 for a single vector."""
    c = long_form(vectors, "e", "tensor").groupBy("tensor", "pos").agg(F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s"))
    return c.groupBy("tensor").agg(F.sum("s").alias("total_var"))


def _moments(vectors: DataFrame, dim: int) -> DataFrame:
    """(tensor, at, v): the number of vectors (at 0), their sum (from 1) and the sum of their outer products (from
    dim + 1). The vectors are read once; one row of these numbers per tensor and task is shuffled. Vectors of another
    length or with nulls are left out."""

    def sums(it):
        acc: dict = {}
        for pdf in it:
            for t, g in pdf.groupby("tensor", dropna=False):
                x = np.stack(g["e"].to_numpy()).astype(float)
                acc[t] = acc.get(t, 0.0) + np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        if acc:
            yield pd.DataFrame({"tensor": list(acc), "v": list(acc.values())})

    fine = vectors.filter((F.size("e") == dim) & F.forall("e", lambda x: x.isNotNull())).select("tensor", F.col("e").cast("array<double>").alias("e"))
    kind = dict(vectors.dtypes)["tensor"]
    part = fine.mapInPandas(sums, f"tensor {kind}, v array<double>")
    return part.select("tensor", F.posexplode("v").alias("at", "v")).groupBy("tensor", "at").agg(F.sum("v").alias("v"))


def _matrix(pdf: pd.DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """(n, the covariance matrix) from the moments of a tensor."""
    v = np.zeros(1 + dim + dim * dim)
    v[pdf["at"]] = pdf["v"]
    n, s, o = round(v[0]), v[1 : dim + 1], v[dim + 1 :].reshape(dim, dim)
    return n, (o - np.outer(s, s) / max(n, 1)) / max(n - 1, 1)


def covariance(vectors: DataFrame, dim: int) -> DataFrame:
    """(tensor, i, j, cov), i <= j: the sample covariances; none for fewer than two vectors. The matrix, as wide as a
    vector however many there are, is put together in one task per tensor."""
    kind = dict(vectors.dtypes)["tensor"]

    def upper(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = _matrix(pdf, dim)
        i, j = np.triu_indices(dim) if n > 1 else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"tensor": [pdf["tensor"].iloc[0]] * len(i), "i": i, "j": j, "cov": c[i, j]})

    return _moments(vectors, dim).groupBy("tensor").applyInPandas(upper, f"tensor {kind}, i int, j int, cov double")


def principal_axes(vectors: DataFrame, dim: int, components: int) -> DataFrame:
    """(tensor, k, std, axis): the leading principal axes by falling std, at most n - 1 of them.

    The covariance matrix of each tensor, whose size is that of the vectors and not of the data, is decomposed in one
    task per tensor; the vectors are read once. An axis points so that its largest coordinate is positive."""
    kind = dict(vectors.dtypes)["tensor"]

    def eig(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = _matrix(pdf, dim)
        if n < 2:
            return pd.DataFrame({"tensor": [], "k": [], "std": [], "axis": []})
        val, vec = np.linalg.eigh(c)
        k = max(1, min(components, n - 1, dim))
        order = np.argsort(val)[::-1][:k]
        axes = vec[:, order].T
        axes *= np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]
        return pd.DataFrame({"tensor": pdf["tensor"].iloc[0], "k": range(k), "std": np.sqrt(np.clip(val[order], 0, None)), "axis": list(axes)})

    return _moments(vectors, dim).groupBy("tensor").applyInPandas(eig, f"tensor {kind}, k int, std double, axis array<double>")


def variance_fraction(axes: DataFrame, total: DataFrame) -> DataFrame:
    """The share of the total variance that the axes carry; 0 where there are none."""
    s = axes.groupBy("tensor").agg(F.sum(F.col("std") ** 2).alias("s"))
    return total.join(s, "tensor", "left").select("tensor", F.when(F.col("total_var") > 0, F.coalesce("s", F.lit(0.0)) / F.col("total_var")).otherwise(0.0).alias("fraction"))


def floored(coord: DataFrame) -> DataFrame:
    """Coordinate statistics with ``sd``, the std raised to a tenth of the tensor's mean std."""
    mean_std = coord.groupBy("tensor").agg(F.avg("std").alias("m"))
    return coord.join(F.broadcast(mean_std), "tensor").withColumn("sd", F.greatest("std", FLOOR * F.col("m"))).drop("m")


def _as_arrays(coord: DataFrame, *columns: str) -> DataFrame:
    """One row per tensor with arrays by position: as wide as a vector, however many vectors there are."""
    packed = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return coord.groupBy("tensor").agg(packed.alias("c")).select("tensor", *[F.col("c")[c].alias(c) for c in columns])


def distance(vectors: DataFrame, coord: DataFrame) -> DataFrame:
    """(tensor, id, distance): root mean square z-score of each vector. The statistics travel as two arrays per
    tensor, so vectors aren't exploded or shuffled."""
    stats = _as_arrays(floored(coord), "mean", "sd")
    z2 = F.zip_with(F.zip_with("e", "mean", lambda x, m: x - m), "sd", lambda d, s: (d / s) * (d / s))
    mean = F.aggregate(z2, F.lit(0.0), lambda a, x: a + x) / F.size("e")
    return vectors.join(F.broadcast(stats), "tensor").select("tensor", "id", F.sqrt(mean).alias("distance"))


def distance_over_tensors(distances: DataFrame) -> DataFrame:
    """(id, distance): the plain mean over the tensors of an id."""
    return distances.groupBy("id").agg(F.avg("distance").alias("distance"))


def project(vectors: DataFrame, coord: DataFrame, limit: float = 3.0) -> DataFrame:
    """Vectors with every coordinate clipped to ``limit`` stds (the raw ones) of its mean."""
    stats = _as_arrays(coord, "mean", "std")
    clipped = F.transform(
        F.arrays_zip("e", "mean", "std"),
        lambda s: s["mean"] + s["std"] * F.greatest(F.lit(-limit), F.least(F.lit(limit), (s["e"] - s["mean"]) / s["std"])),
    )
    return vectors.join(F.broadcast(stats), "tensor").select("tensor", "id", clipped.alias("e"))


def summary(coord: DataFrame, axes: DataFrame | None, total: DataFrame, corpus: DataFrame | None) -> DataFrame:
    """tensor, mean_of_means, mean_of_stds, n_components, pca_variance_fraction (4 digits), corpus_rows."""
    s = coord.groupBy("tensor").agg(F.avg("mean").alias("mean_of_means"), F.avg("std").alias("mean_of_stds"))
    count = lambda df, name: df.groupBy("tensor").agg(F.count("*").alias(name))
    if axes is not None:
        s = s.join(count(axes, "n_components"), "tensor", "left").join(variance_fraction(axes, total), "tensor", "left")
    else:
        s = s.withColumns({"n_components": F.lit(0).cast("bigint"), "fraction": F.lit(0.0)})
    s = s.join(count(corpus, "corpus_rows"), "tensor", "left") if corpus is not None else s.withColumn("corpus_rows", F.lit(0).cast("bigint"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return s.select("tensor", "mean_of_means", "mean_of_stds", zero("n_components"), F.round("fraction", 4).alias("pca_variance_fraction"), zero("corpus_rows"))


def corpus_subset(vectors: DataFrame, most: int = MAX_CORPUS, seed: int = 0) -> DataFrame:
    """At most ``most`` vectors of each tensor, without replacement, by a hash of their id."""
    order = F.md5(rng.key(seed, "corpus", F.col("id")))
    w = W.partitionBy("tensor").orderBy(order, "id")
    return vectors.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


# --- sampling -------------------------------------------------------------------------------------------------------

SAMPLERS = ("diagonal", "pca", "blend", "hybrid")


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row")


def deviations(coord: DataFrame, n: int, seed: int, truncation: float | None = None, stream: str = "diag") -> DataFrame:
    """(tensor, row, pos, dev): std times a normal draw of the key (seed, tensor, row, pos)."""
    draw = lambda i: rng.normal(rng.key(seed, stream, F.col("tensor"), F.col("row"), F.col("pos"), i))
    z = rng.truncated(draw, truncation) if truncation else draw(F.lit(0))
    return _rows(coord.sparkSession, n).crossJoin(F.broadcast(coord)).select("tensor", "row", "pos", "mean", (F.col("std") * z).alias("dev"))


def band(axes: DataFrame, lo: int = 0, components: int | None = None, equalize: bool = False) -> DataFrame:
    """Axes of the band [lo, lo + components), with ``scale``: their std, or with ``equalize`` the root mean square of
    all axes' stds. ``lo`` is clipped to the axes there are."""
    stats = axes.groupBy("tensor").agg(F.count("*").alias("total"), F.sqrt(F.avg(F.col("std") ** 2)).alias("rms"))
    b = axes.join(F.broadcast(stats), "tensor")
    first = F.greatest(F.lit(0), F.least(F.lit(lo), F.col("total") - 1))
    last = F.least(first + (components if components is not None else 2**30), F.col("total"))
    b = b.filter((F.col("k") >= first) & (F.col("k") < last))
    return b.select("tensor", "k", "axis", (F.col("rms") if equalize else F.col("std")).alias("scale"))


def axis_deviations(axes: DataFrame, n: int, seed: int, truncation: float | None = None, **of_band) -> DataFrame:
    """(tensor, row, pos, dev): a normal draw along each axis of a band."""
    draw = lambda i: rng.normal(rng.key(seed, "pca", F.col("tensor"), F.col("row"), F.col("k"), i))
    z = rng.truncated(draw, truncation) if truncation else draw(F.lit(0))
    a = _rows(axes.sparkSession, n).crossJoin(F.broadcast(band(axes, **of_band))).withColumn("a", F.col("scale") * z)
    c = a.select("tensor", "row", "a", F.posexplode("axis").alias("pos", "u"))
    return c.groupBy("tensor", "row", "pos").agg(F.sum(F.col("a") * F.col("u")).alias("dev"))


def sample(n: int, coord: DataFrame, axes: DataFrame | None = None, corpus: DataFrame | None = None, sampler: str = "diagonal", temperature: float = 1.0, seed: int = 0, truncation: float | None = None, coherence: float = 0.5, components: int | None = None, comp_lo: int = 0, equalize: bool = False) -> DataFrame:
    """(tensor, row, pos, v): ``n`` samples of every tensor, mean + temperature * deviation.

    diagonal: each coordinate by itself. pca: along the axes of a band. blend: sqrt(coherence) of pca and
    sqrt(1 - coherence) of diagonal; at 0 and 1 exactly the pure ones. hybrid: between two corpus vectors, whose only
    use of the temperature is the jitter."""
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler!r}, not in {SAMPLERS}")
    if sampler == "hybrid":
        if corpus is None:
            raise ValueError("the hybrid sampler needs a corpus")
        return hybrid(n, coord, corpus, temperature, seed)
    lam = {"diagonal": 0.0, "pca": 1.0}.get(sampler, min(max(coherence, 0.0), 1.0))
    if lam > 0 and axes is None:
        raise ValueError(f"the {sampler} sampler needs principal axes")
    parts = []
    if lam < 1:
        d = deviations(coord, n, seed, truncation).select("tensor", "row", "pos", "dev")
        parts.append(d if lam == 0 else d.withColumn("dev", F.col("dev") * (1 - lam) ** 0.5))
    if lam > 0:
        a = axis_deviations(axes, n, seed, truncation, lo=comp_lo, components=components, equalize=equalize)
        parts.append(a if lam == 1 else a.withColumn("dev", F.col("dev") * lam**0.5))
    dev = parts[0]
    if len(parts) == 2:
        dev = parts[0].unionByName(parts[1]).groupBy("tensor", "row", "pos").agg(F.sum("dev").alias("dev"))
    out = dev.join(F.broadcast(coord.select("tensor", "pos", "mean")), ["tensor", "pos"])
    return out.select("tensor", "row", "pos", (F.col("mean") + temperature * F.col("dev")).alias("v"))


def corpus_pairs(n: int, corpus: DataFrame, seed: int) -> DataFrame:
    """(tensor, row, a, b, t): two different corpus vectors for each sample, and t between 0.3 and 0.7.

    ``corpus`` is what ``corpus_subset`` kept, at most 256 vectors of a tensor, and so is broadcast."""
    w = W.partitionBy("tensor").orderBy("id")
    kept = corpus.withColumn("at", F.row_number().over(w) - 1).select("tensor", "at", "e", F.count("*").over(W.partitionBy("tensor")).alias("m"))
    size = kept.select("tensor", "m").distinct()
    k = lambda s: rng.key(seed, s, F.col("tensor"), F.col("row"))
    picks = _rows(corpus.sparkSession, n).crossJoin(F.broadcast(size))
    first = F.floor(rng.uniform(k("first")) * F.col("m"))
    step = F.floor(rng.uniform(k("second")) * (F.col("m") - 1)) + 1
    picks = picks.filter("m > 1").select("tensor", "row", first.alias("i"), F.pmod(first + step, F.col("m")).alias("j"), (0.3 + 0.4 * rng.uniform(k("t"))).alias("t"))
    a = kept.select("tensor", F.col("at").alias("i"), F.col("e").alias("a"))
    b = kept.select("tensor", F.col("at").alias("j"), F.col("e").alias("b"))
    return picks.join(F.broadcast(a), ["tensor", "i"]).join(F.broadcast(b), ["tensor", "j"]).select("tensor", "row", "a", "b", "t")


def hybrid(n: int, coord: DataFrame, corpus: DataFrame, temperature: float, seed: int) -> DataFrame:
    """Slerp of two corpus vectors plus 0.15 * temperature * std * normal. Tensors with fewer than two corpus vectors
    have no samples."""
    pairs = corpus_pairs(n, corpus, seed)
    base = pairs.select("tensor", "row", F.posexplode(slerp(F.col("a"), F.col("b"), F.col("t"), 1e-12, raw=True)).alias("pos", "base"))
    j = base.join(F.broadcast(coord.select("tensor", "pos", "std")), ["tensor", "pos"])
    z = rng.normal(rng.key(seed, "jitter", F.col("tensor"), F.col("row"), F.col("pos"), F.lit(0)))
    return j.select("tensor", "row", "pos", (F.col("base") + 0.15 * temperature * F.col("std") * z).alias("v"))


def refit(base: DataFrame, elites: DataFrame, blend: float = 0.0) -> DataFrame:
    """Mean of the elites; std = blend * base + (1 - blend) * population std of the elites, at least a tenth of the
    base's. ``elites``: vectors of the same tensors."""
    e = long_form(elites, "e", "tensor").groupBy("tensor", "pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    std = F.greatest(blend * F.col("std") + (1 - blend) * F.col("s"), 0.1 * F.col("std"))
    return base.join(e, ["tensor", "pos"]).select("tensor", "pos", F.col("m").alias("mean"), std.alias("std"))


# --- persistence ----------------------------------------------------------------------------------------------------


def save(path: str, coord: DataFrame, total: DataFrame, axes: DataFrame | None = None, corpus: DataFrame | None = None) -> list[str]:
    """Write a distribution as Parquet tables, each partitioned by tensor; the paths written. Existing ones are kept
    and make it fail."""
    out = []
    for name, df in (("coord", coord), ("meta", total), ("axes", axes), ("corpus", corpus)):
        if df is not None:
            df.write.mode("errorifexists").partitionBy("tensor").parquet(f"{path}/{name}")
            out.append(f"{path}/{name}")
    return out


def load(spark: SparkSession, path: str, tensors: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables that ``save`` wrote; axes and corpus may be missing. Only partitions of ``tensors`` are read."""
    out = {}
    jvm = spark.sparkContext._jvm
    for name in ("coord", "meta", "axes", "corpus"):
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            df = spark.read.parquet(f"{path}/{name}")
            out[name] = df.filter(F.col("tensor").isin(tensors)) if tensors else df
    if "coord" not in out:
        raise FileNotFoundError(f"no distribution at {path}")
    return out


def mean_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    n = lambda x: F.sqrt(dot(x, x))
    return let(n(a) * n(b), lambda m: F.when(m > 0, dot(a, b) / m).otherwise(0.0))
