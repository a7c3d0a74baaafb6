"""Queries of the distribution operators: fit, axes, distance, sampling, navigation, evolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.functions import rng
from embermill.functions.vector import dot, lerp, long_form, slerp, wide_form
from embermill.operators import distribution as D
from embermill.operators import evolve as E
from embermill.operators import navigate as N
from embermill.plans.common import LONG, rnd, vectors
from embermill.plans.registry import registry
from embermill.sources.tables import table

add = registry.add
DIM, HIDDEN, N_SAMPLES, SEED = 64, 8, 20, 7


def coord(spark: SparkSession, d: str) -> DataFrame:
    return D.fit(vectors(spark, d))


def _coord_out(c: DataFrame) -> DataFrame:
    return c.select("tensor", "pos", rnd("mean", 5).alias("mean"), rnd("std", 5).alias("std"))


def _long_out(v: DataFrame, *keys: str, digits: int = 5) -> DataFrame:
    return long_form(v, "e", *keys).select(*keys, "pos", rnd("v", digits).alias("v"))


@add("fit_coord", f"WITH {LONG} SELECT tensor, pos, round(mean, 5) + 0.0 AS mean, round(std, 5) + 0.0 AS std FROM coord")
def fit_coord(spark: SparkSession, d: str) -> DataFrame:
    return _coord_out(coord(spark, d))


@add("fit_multi", f"WITH {LONG} SELECT tensor, pos, round(mean, 5) + 0.0 AS mean, round(std, 5) + 0.0 AS std FROM coords")
def fit_multi(spark: SparkSession, d: str) -> DataFrame:
    return _coord_out(D.fit(vectors(spark, d, True)))


@add(
    "fit_pooled",
    f"""WITH {LONG}, p AS (SELECT pos % {HIDDEN} AS f, avg(v) AS mean, greatest(stddev_pop(v), 1e-4::double) AS std FROM lone GROUP BY 1)
    SELECT 'all' AS tensor, g.pos::int AS pos, round(mean, 5) + 0.0 AS mean, round(std, 5) + 0.0 AS std FROM range({DIM}) AS g(pos) JOIN p ON g.pos % {HIDDEN} = p.f""",
)
def fit_pooled(spark: SparkSession, d: str) -> DataFrame:
    return _coord_out(D.fit_pooled(vectors(spark, d), HIDDEN))


@add("total_var", f"WITH {LONG}, s AS (SELECT tensor, pos, var_samp(v) AS s FROM many GROUP BY ALL) SELECT tensor, round(sum(coalesce(s, 0)), 5) + 0.0 AS total_var FROM s GROUP BY 1")
def total_var(spark: SparkSession, d: str) -> DataFrame:
    return D.total_variance(vectors(spark, d, True)).select("tensor", rnd("total_var", 5).alias("total_var"))


@add(
    "cov_matrix",
    f"""WITH {LONG} SELECT a.tensor, a.pos AS i, b.pos AS j, round(covar_samp(a.v, b.v), 5) + 0.0 AS cov
    FROM lone a JOIN lone b ON a.id = b.id AND a.pos <= b.pos GROUP BY ALL""",
)
def cov_matrix(spark: SparkSession, d: str) -> DataFrame:
    return D.covariance(vectors(spark, d), DIM).select("tensor", "i", "j", rnd("cov", 5).alias("cov"))


_COV = f"""{LONG}, cv AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.v, b.v) AS c FROM lone a JOIN lone b ON a.id = b.id GROUP BY ALL)"""


@add(
    "fit_pca",
    f"""WITH {_COV}, c2 AS (SELECT x.i, y.j, sum(x.c * y.c) AS c FROM cv x JOIN cv y ON x.j = y.i GROUP BY ALL)
    SELECT 'all' AS tensor, {DIM}::bigint AS axes, round(sum(c) FILTER (i = j), 5) + 0.0 AS trace, round((SELECT sum(c) FROM c2 WHERE i = j), 4) + 0.0 AS square, round((SELECT sum(x.c * y.c) FROM cv x JOIN c2 y ON x.i = y.j AND x.j = y.i), 3) + 0.0 AS cube,
    0.0::double AS residual, 0.0::double AS skew FROM cv""",
)
def fit_pca(spark: SparkSession, d: str) -> DataFrame:
    """The axes by what doesn't depend on their signs: sums of powers of their variances (which are traces of powers
    of the covariance matrix), how far each is from an eigenvector, and how far two are from a right angle."""
    v = vectors(spark, d)

    def check(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        u, std = np.stack(a.sort_values("k")["axis"].to_numpy()), a.sort_values("k")["std"].to_numpy()
        m = np.zeros((DIM, DIM))
        m[c["i"], c["j"]] = m[c["j"], c["i"]] = c["cov"]
        powers = [(std ** (2 * n)).sum() for n in (1, 2, 3)]
        return pd.DataFrame([(a["tensor"].iloc[0], len(u), *powers, np.abs(u @ m - std[:, None] ** 2 * u).max(), np.abs(u @ u.T - np.eye(len(u))).max())])

    both = D.principal_axes(v, DIM, DIM).groupBy("tensor").cogroup(D.covariance(v, DIM).groupBy("tensor"))
    got = both.applyInPandas(check, "tensor string, axes bigint, trace double, square double, cube double, residual double, skew double")
    return got.select("tensor", "axes", *[rnd(c, n).alias(c) for c, n in (("trace", 5), ("square", 4), ("cube", 3), ("residual", 6), ("skew", 6))])


@add("pca_axes")
def pca_axes(spark: SparkSession, d: str) -> DataFrame:
    return D.principal_axes(vectors(spark, d), DIM, 8).select("tensor", "k", rnd("std", 5).alias("std"))


@add(
    "pca_fraction",
    f"""WITH {LONG}, t AS (SELECT var_samp(v) AS s FROM lone GROUP BY pos), b AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.v, b.v) AS c FROM lone a JOIN lone b ON a.id = b.id WHERE a.pos < 2 AND b.pos < 2 GROUP BY ALL),
    m AS (SELECT sum(c) FILTER (i = j) / 2 AS h, sqrt((max(c) FILTER (i = 0 AND j = 0) - max(c) FILTER (i = 1 AND j = 1)) ** 2 / 4 + (max(c) FILTER (i = 0 AND j = 1)) ** 2) AS r FROM b)
    SELECT 'all' AS tensor, round((h + r) / (SELECT sum(s) FROM t), 5) + 0.0 AS fraction FROM m""",
)
def pca_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The share of the total variance that the leading axis of the first two coordinates carries."""
    v = vectors(spark, d)
    axes = D.principal_axes(v.withColumn("e", F.slice("e", 1, 2)), 2, 1)
    return D.variance_fraction(axes, D.total_variance(v)).select("tensor", rnd("fraction", 5).alias("fraction"))


@add(
    "dist_summary",
    f"""WITH {LONG} SELECT tensor, round(avg(mean), 5) + 0.0 AS mean_of_means, round(avg(std), 5) + 0.0 AS mean_of_stds, 0::bigint AS n_components, 0.0::double AS pca_variance_fraction,
    least(256, (SELECT count(*) FROM embeddings)) AS corpus_rows FROM coord GROUP BY tensor""",
)
def dist_summary(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    s = D.summary(D.fit(v), None, D.total_variance(v), D.corpus_subset(v))
    return s.withColumns({"mean_of_means": rnd("mean_of_means", 5), "mean_of_stds": rnd("mean_of_stds", 5)})


@add("distance_gauge", f"WITH {LONG} SELECT tensor, id, round(sqrt(avg(((v - mean) / sd) ** 2)), 3) + 0.0 AS distance FROM lone JOIN sd USING (tensor, pos) GROUP BY ALL")
def distance_gauge(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return D.distance(v, D.fit(v)).select("tensor", "id", rnd("distance", 3).alias("distance"))


def two_tensors(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as two tensors, its halves, under one id."""
    v = vectors(spark, d)
    half = lambda name, at: v.select(F.lit(name).alias("tensor"), "id", F.slice("e", at, DIM // 2).alias("e"))
    return half("a", 1).unionByName(half("b", DIM // 2 + 1))


HALVES = f"""{LONG}, halves AS (SELECT CASE WHEN pos < {DIM // 2} THEN 'a' ELSE 'b' END AS tensor, id, pos % {DIM // 2} AS pos, v FROM lone),
hc AS (SELECT tensor, pos, avg(v) AS mean, greatest(stddev_pop(v), 1e-4::double) AS std FROM halves GROUP BY ALL),
hs AS (SELECT *, greatest(std, 0.1::double * avg(std) OVER (PARTITION BY tensor)) AS sd FROM hc),
hd AS (SELECT tensor, id, sqrt(avg(((v - mean) / sd) ** 2)) AS d FROM halves JOIN hs USING (tensor, pos) GROUP BY ALL),
hm AS (SELECT id, avg(d) AS d FROM hd GROUP BY id)"""


@add("distance_multi", f"WITH {HALVES} SELECT id, round(d, 3) + 0.0 AS distance FROM hm")
def distance_multi(spark: SparkSession, d: str) -> DataFrame:
    v = two_tensors(spark, d)
    return D.distance_over_tensors(D.distance(v, D.fit(v))).select("id", rnd("distance", 3).alias("distance"))


@add(
    "floor_distance",
    f"""WITH {HALVES} SELECT h.tensor, id, pos, round(mean + (v - mean) * CASE WHEN d < 1.0 THEN 1.0 / greatest(d, 1e-6::double) ELSE 1.0 END, 5) + 0.0 AS v
    FROM halves h JOIN hs USING (tensor, pos) JOIN hm USING (id)""",
)
def floor_distance(spark: SparkSession, d: str) -> DataFrame:
    v = two_tensors(spark, d)
    return _long_out(N.floor_distance(v, D.fit(v), 1.0), "tensor", "id")


@add(
    "retarget",
    f"""WITH {LONG}, g AS (SELECT tensor, id, sqrt(avg(((v - mean) / sd) ** 2)) AS d FROM lone JOIN sd USING (tensor, pos) GROUP BY ALL)
    SELECT l.tensor, id, pos, round(mean + (v - mean) * (1.5 / greatest(d, 1e-6::double)), 5) + 0.0 AS v FROM lone l JOIN sd USING (tensor, pos) JOIN g USING (id)""",
)
def retarget(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _long_out(N.retarget(v, D.fit(v), 1.5), "tensor", "id")


@add("project", f"WITH {LONG} SELECT tensor, id, pos, round(mean + std * greatest(-3.0, least(3.0, (v - mean) / std)), 5) + 0.0 AS v FROM lone JOIN coord USING (tensor, pos)")
def project(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _long_out(D.project(v, D.fit(v)), "tensor", "id")


@add(
    "refit_elites",
    f"""WITH {LONG}, e AS (SELECT tensor, pos, avg(v) AS m, stddev_pop(v) AS s FROM lone WHERE id % 9 = 0 GROUP BY ALL)
    SELECT tensor, pos, round(m, 5) + 0.0 AS mean, round(greatest(0.3 * std + 0.7 * s, 0.1 * std), 5) + 0.0 AS std FROM coord JOIN e USING (tensor, pos)""",
)
def refit_elites(spark: SparkSession, d: str) -> DataFrame:
    """The elites are the favourites, by definition of this fixture every ninth id."""
    v = vectors(spark, d)
    return _coord_out(D.refit(D.fit(v), v.filter("id % 9 = 0"), 0.3))


@add(
    "corpus_subset",
    f"SELECT label::varchar AS tensor, vec_id AS id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5({rng.key_sql(0, 'corpus', 'vec_id')}), vec_id) <= 32",
)
def corpus_subset(spark: SparkSession, d: str) -> DataFrame:
    return D.corpus_subset(vectors(spark, d, True), 32).select("tensor", "id")


@add(
    "mean_cosine",
    """WITH p AS (SELECT label, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
    SELECT label::varchar AS tensor, round(avg(list_cosine_similarity(a::double[], b::double[])), 5) + 0.0 AS cosine FROM p WHERE b IS NOT NULL GROUP BY 1""",
)
def mean_cosine(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    v = vectors(spark, d, True).withColumn("b", F.lead("e").over(W.partitionBy("tensor").orderBy("id"))).filter("b is not null")
    return v.groupBy("tensor").agg(rnd(F.avg(D.mean_cosine(F.col("e"), F.col("b"))), 5).alias("cosine"))


@add(
    "marginal_hist",
    f"""WITH {LONG}, z AS (SELECT pos, (v - mean) / std AS z FROM lone JOIN coord USING (tensor, pos)),
    b AS (SELECT pos, least(59, floor((z + 4.0) / (8.0 / 60)))::int AS bin FROM z WHERE z BETWEEN -4 AND 4)
    SELECT pos, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY pos) * (8.0::double / 60)), 5) + 0.0 AS density FROM b GROUP BY pos, bin""",
)
def marginal_hist(spark: SparkSession, d: str) -> DataFrame:
    """60 bins over [-4, 4] of the z-scores of each coordinate; the last bin is closed, values outside are dropped."""
    from pyspark.sql import Window as W

    v = vectors(spark, d)
    z = long_form(v, "e", "tensor").join(F.broadcast(D.fit(v)), ["tensor", "pos"]).select("pos", ((F.col("v") - F.col("mean")) / F.col("std")).alias("z"))
    b = z.filter(F.col("z").between(-4, 4)).select("pos", F.least(F.lit(59), F.floor((F.col("z") + 4.0) / (8.0 / 60)).cast("int")).alias("bin"))
    h = b.groupBy("pos", "bin").agg(F.count("*").alias("n"))
    return h.select("pos", "bin", "n", rnd(F.col("n") / (F.sum("n").over(W.partitionBy("pos")) * (8.0 / 60)), 5).alias("density"))


@add("marginal_stats", f"WITH {LONG} SELECT pos, round(avg(v), 5) + 0.0 AS mean, round(stddev_pop(v), 5) + 0.0 AS std FROM lone WHERE pos IN (0, 21, 42, 63) GROUP BY pos")
def marginal_stats(spark: SparkSession, d: str) -> DataFrame:
    c = long_form(vectors(spark, d), "e").filter(F.col("pos").isin(0, 21, 42, 63))
    return c.groupBy("pos").agg(rnd(F.avg("v"), 5).alias("mean"), rnd(F.stddev_pop("v"), 5).alias("std"))


@add(
    "varied_coords",
    f"""WITH {LONG}, r AS (SELECT pos, row_number() OVER (ORDER BY round(std, 9), pos) - 1 AS r FROM coord)
    SELECT g.i::int AS i, r.pos FROM range(6) AS g(i) JOIN r ON r.r = floor(g.i * {DIM - 1} / 5.0)""",
)
def varied_coords(spark: SparkSession, d: str) -> DataFrame:
    """Six coordinates evenly spaced in the order of their std (the coordinates of one vector are a short list)."""
    from pyspark.sql import Window as W

    r = coord(spark, d).withColumn("r", F.row_number().over(W.orderBy(F.round("std", 9), "pos")) - 1)
    i = spark.range(6).select(F.col("id").cast("int").alias("i"), F.floor(F.col("id") * (DIM - 1) / 5.0).alias("r"))
    return r.join(i, "r").select("i", "pos")


@add(
    "neg_vector",
    f"WITH {LONG}, k(mode) AS (VALUES ('mean'), ('zeros')) SELECT mode, pos, round(CASE mode WHEN 'mean' THEN mean ELSE 0.0 END, 5) + 0.0 AS v FROM coord, k",
)
def neg_vector(spark: SparkSession, d: str) -> DataFrame:
    """The vector guidance points away from: the mean, or zeros."""
    modes = spark.createDataFrame([("mean",), ("zeros",)], "mode string")
    return coord(spark, d).crossJoin(F.broadcast(modes)).select("mode", "pos", rnd(F.when(F.col("mode") == "mean", F.col("mean")).otherwise(0.0), 5).alias("v"))


# --- random draws and samplers --------------------------------------------------------------------------------------

_DRAW = rng.normal_sql(rng.key_sql(SEED, "diag", "'all'", "g.row", "pos", "i"))


@add(
    "truncate_draws",
    f"""WITH g AS (SELECT vec_id AS row, 0 AS pos FROM embeddings), z AS (SELECT row, i, {_DRAW.replace("g.row", "row")} AS z FROM g, range(9) AS r(i))
    SELECT row, round(coalesce(arg_min(z, i) FILTER (abs(z) <= 1.0), greatest(-1.0, least(1.0, arg_max(z, i)))), 6) + 0.0 AS z FROM z GROUP BY row""",
)
def truncate_draws(spark: SparkSession, d: str) -> DataFrame:
    z = rng.truncated(lambda i: rng.normal(rng.key(SEED, "diag", F.lit("all"), F.col("vec_id"), F.lit(0), i)), 1.0)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), rnd(z, 6).alias("z"))


_SAMPLE = _DRAW.replace("(i)::varchar", "'0'")


@add(
    "sample_diagonal",
    f"WITH {LONG} SELECT tensor, g.row, pos, round(mean + 1.2 * std * {_SAMPLE}, 5) + 0.0 AS v FROM coord, range({N_SAMPLES}) AS g(row)",
)
def sample_diagonal(spark: SparkSession, d: str) -> DataFrame:
    s = D.sample(N_SAMPLES, coord(spark, d), temperature=1.2, seed=SEED)
    return s.select("tensor", "row", "pos", rnd("v", 5).alias("v"))


def _axis_draw(k: str, row: str = "g.row", tensor: str = "'all'") -> str:
    return rng.normal_sql(rng.key_sql(SEED, "pca", tensor, row, k, "0"))


@add(
    "sample_pca",
    f"""WITH {LONG}, t AS (SELECT sum(s) / {DIM} AS rms2 FROM (SELECT var_samp(v) AS s FROM lone GROUP BY pos))
    SELECT 'all' AS tensor, g.row, round(1.3 * sqrt(rms2 * sum(({_axis_draw('k.k')}) ** 2)), 5) + 0.0 AS length FROM range({N_SAMPLES}) AS g(row), range(2, 8) AS k(k), t GROUP BY g.row, rms2""",
)
def sample_pca(spark: SparkSession, d: str) -> DataFrame:
    """Samples along a band of six axes at equal strength: how far each lies from the mean, which doesn't depend on the
    axes' signs."""
    v = vectors(spark, d)
    c = D.fit(v)
    s = D.sample(N_SAMPLES, c, D.principal_axes(v, DIM, DIM), sampler="pca", temperature=1.3, seed=SEED, comp_lo=2, components=6, equalize=True)
    away = s.join(F.broadcast(c.select("tensor", "pos", "mean")), ["tensor", "pos"])
    return away.groupBy("tensor", "row").agg(rnd(F.sqrt(F.sum((F.col("v") - F.col("mean")) ** 2)), 5).alias("length"))


def coordinate_axes(coord: DataFrame) -> DataFrame:
    """Axes along the coordinates, with their stds: known in SQL, as principal axes aren't."""
    unit = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: (i == F.col("pos")).cast("double"))
    return coord.select("tensor", F.col("pos").alias("k"), "std", unit.alias("axis"))


@add("sample_blend", f"WITH {LONG} SELECT tensor, g.row, pos, round(mean + 1.2 * std * (sqrt(0.4::double) * {_axis_draw('pos')} + sqrt(0.6::double) * {_SAMPLE}), 5) + 0.0 AS v FROM coord, range({N_SAMPLES}) AS g(row)")
def sample_blend(spark: SparkSession, d: str) -> DataFrame:
    """Two fifths along the axes, three of the coordinates by themselves; the axes here are the coordinates'."""
    c = coord(spark, d)
    s = D.sample(N_SAMPLES, c, coordinate_axes(c), sampler="blend", coherence=0.4, temperature=1.2, seed=SEED)
    return s.select("tensor", "row", "pos", rnd("v", 5).alias("v"))


@add("band_scale", f"WITH {LONG}, t AS (SELECT sqrt(sum(s) / {DIM}) AS rms FROM (SELECT var_samp(v) AS s FROM lone GROUP BY pos)) SELECT 'all' AS tensor, k::int AS k, round(rms, 5) + 0.0 AS scale FROM range(3, 8) AS k(k), t")
def band_scale(spark: SparkSession, d: str) -> DataFrame:
    return D.band(D.principal_axes(vectors(spark, d), DIM, DIM), 3, 5, True).select("tensor", "k", rnd("scale", 5).alias("scale"))


def _slerp_sql(a: str, b: str, t: str, raw: bool = False, least: str = "1e-8") -> str:
    """pos-wise slerp of lists a and b in DuckDB (as a list)."""
    na, nb = f"sqrt(list_dot_product({a}, {a}))", f"sqrt(list_dot_product({b}, {b}))"
    w = f"acos(greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / ({na} * {nb}))))"
    x, y = f"{a}[i]", f"{b}[i]"
    near = f"((1.0 - {t}) * {x} + {t} * {y})" if raw else f"((1.0 - {t}) * {x} / {na} + {t} * {y} / {nb}) * ((1.0 - {t}) * {na} + {t} * {nb})"
    return f"""list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {na} < {least} OR {nb} < {least} THEN (1.0 - {t}) * {x} + {t} * {y}
      WHEN {w} < 1e-4 THEN {near} ELSE (sin((1.0 - {t}) * {w}) / sin({w}) * {x} / {na} + sin({t} * {w}) / sin({w}) * {y} / {nb}) * ((1.0 - {t}) * {na} + {t} * {nb}) END)"""


@add(
    "sample_hybrid",
    f"""WITH {LONG}, c AS (SELECT embedding::double[] AS e, vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY md5({rng.key_sql(0, 'corpus', 'vec_id')}), vec_id) <= 256),
    k AS (SELECT e, row_number() OVER (ORDER BY vec_id) - 1 AS at, count(*) OVER () AS m FROM c),
    p AS (SELECT row, m, floor({rng.uniform_sql(rng.key_sql(SEED, 'first', "'all'", 'row'))} * m) AS i, floor({rng.uniform_sql(rng.key_sql(SEED, 'second', "'all'", 'row'))} * (m - 1)) + 1 AS s,
      0.3 + 0.4 * {rng.uniform_sql(rng.key_sql(SEED, 't', "'all'", 'row'))} AS t FROM range({N_SAMPLES}) AS g(row), (SELECT DISTINCT m FROM k)),
    q AS (SELECT p.row, p.t, a.e AS a, b.e AS b FROM p JOIN k a ON a.at = p.i JOIN k b ON b.at = (p.i + p.s) % p.m),
    s AS (SELECT row, unnest(range({DIM}))::int AS pos, unnest({_slerp_sql('a', 'b', 't', True, '1e-12')}) AS base FROM q)
    SELECT tensor, s.row, pos, round(base + 0.15 * 1.0 * std * {rng.normal_sql(rng.key_sql(SEED, 'jitter', "'all'", 's.row', 'pos', '0'))}, 5) + 0.0 AS v FROM s JOIN coord USING (pos)""",
)
def sample_hybrid(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    s = D.sample(N_SAMPLES, D.fit(v), corpus=D.corpus_subset(v), sampler="hybrid", seed=SEED)
    return s.select("tensor", "row", "pos", rnd("v", 5).alias("v"))


@add(
    "synthetic_corpus",
    f"""SELECT g.row, p.pos::int AS pos, round((CASE WHEN g.row < 200 // 2 THEN -1.0 ELSE 1.0 END) + 0.5 * {rng.normal_sql(rng.key_sql(3, 'mixture', 'g.row', 'p.pos'))}, 5) + 0.0 AS v
    FROM range(200) AS g(row), range(16) AS p(pos)""",
)
def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of two Gaussian clusters, half of the rows each."""
    g = spark.range(200).withColumnRenamed("id", "row").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(15))))
    z = rng.normal(rng.key(3, "mixture", F.col("row"), F.col("pos")))
    return g.select("row", "pos", rnd(F.when(F.col("row") < 100, -1.0).otherwise(1.0) + 0.5 * z, 5).alias("v"))


# --- navigation -----------------------------------------------------------------------------------------------------


@add(
    "neighborhood",
    f"WITH {LONG} SELECT tensor, id, g.row, pos, round(v + 0.5 * std * {_SAMPLE}, 5) + 0.0 AS v FROM lone JOIN coord USING (tensor, pos), range(3) AS g(row)",
)
def neighborhood(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return N.neighbourhood(v, D.fit(v), 3, 0.5, SEED).select("tensor", "id", "row", "pos", rnd("v", 5).alias("v"))


@add("walk_outward", f"WITH {LONG} SELECT tensor, id, g.i::int AS i, pos, round(mean + (v - mean) * (1 + 0.25 * (g.i + 1)), 5) + 0.0 AS v FROM lone JOIN coord USING (tensor, pos), range(3) AS g(i)")
def walk_outward(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _long_out(N.walk_outward(v, D.fit(v), 3, 0.25), "tensor", "id", "i")


@add("walk_axis", f"WITH {LONG} SELECT tensor, id, g.i::int AS i, pos, round(v + CASE WHEN pos = 9 THEN 0.5 * (g.i + 1) * std ELSE 0 END, 5) + 0.0 AS v FROM lone JOIN coord USING (tensor, pos), range(3) AS g(i)")
def walk_axis(spark: SparkSession, d: str) -> DataFrame:
    """Steps along an axis, whose number counts modulo the axes there are; the axes here are the coordinates'."""
    v = vectors(spark, d)
    return _long_out(N.walk_axis(v, coordinate_axes(D.fit(v)), DIM + 9, 3, 0.5), "tensor", "id", "i")


@add(
    "walk_random",
    f"WITH {LONG} SELECT tensor, id, g.i::int AS i, pos, round(v + 0.5 * (g.i + 1) * std * {rng.normal_sql(rng.key_sql(SEED, 'walk', "'all'", '0', 'pos', '0'))}, 5) + 0.0 AS v FROM lone JOIN coord USING (tensor, pos), range(3) AS g(i)",
)
def walk_random(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _long_out(N.walk_random(v, D.fit(v), 3, 0.5, SEED), "tensor", "id", "i")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(tensor, id, a, b): every vector with the next of its label."""
    from pyspark.sql import Window as W

    v = vectors(spark, d, True).withColumn("b", F.lead("e").over(W.partitionBy("tensor").orderBy("id")))
    return v.filter("b is not null").select("tensor", "id", F.col("e").alias("a"), "b")


PAIRS = """pairs AS (SELECT * FROM (SELECT label::varchar AS tensor, vec_id AS id, embedding::double[] AS a, lead(embedding::double[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL)"""
_POS = f"unnest(range({DIM}))::int AS pos"


@add(
    "linear_walk",
    f"WITH {PAIRS}, s AS (SELECT id, g.i::int AS i, {_POS}, unnest(a) AS a, unnest(b) AS b FROM pairs, range(4) AS g(i)) SELECT id, i, pos, round((1.0 - i / 3.0::double) * a + i / 3.0::double * b, 5) + 0.0 AS v FROM s",
)
def linear_walk(spark: SparkSession, d: str) -> DataFrame:
    return _long_out(N.linear_walk(pairs(spark, d), 4), "id", "i")


@add("lerp", f"WITH {PAIRS}, s AS (SELECT id, {_POS}, unnest(a) AS a, unnest(b) AS b FROM pairs) SELECT id, pos, round(0.7 * a + 0.3 * b, 5) + 0.0 AS v FROM s")
def lerp_query(spark: SparkSession, d: str) -> DataFrame:
    return _long_out(pairs(spark, d).select("id", lerp(F.col("a"), F.col("b"), 0.3).alias("e")), "id")


@add("slerp_pairs", f"WITH {PAIRS}, s AS (SELECT id, {_POS}, unnest({_slerp_sql('a', 'b', '0.5::double')}) AS v FROM pairs) SELECT id, pos, round(v, 5) + 0.0 AS v FROM s")
def slerp_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _long_out(pairs(spark, d).select("id", slerp(F.col("a"), F.col("b"), 0.5).alias("e")), "id")


@add(
    "breed",
    f"""WITH {PAIRS}, k AS (SELECT *, g.i::int AS i, 0.15 + 0.7 * g.i / 2.0::double AS t FROM pairs, range(3) AS g(i)),
    s AS (SELECT tensor, id, i, {_POS}, unnest({_slerp_sql('a', 'b', 't')}) AS v FROM k) SELECT tensor, id, i, pos, round(v, 5) + 0.0 AS v FROM s""",
)
def breed(spark: SparkSession, d: str) -> DataFrame:
    return N.breed(pairs(spark, d), 3).select("tensor", "id", "i", "pos", rnd("v", 5).alias("v"))


@add("adjacent_dot", f"WITH {PAIRS} SELECT tensor, id, round(list_dot_product(a, b), 5) + 0.0 AS dot FROM pairs")
def adjacent_dot(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("tensor", "id", rnd(dot(F.col("a"), F.col("b")), 5).alias("dot"))


# --- evolution ------------------------------------------------------------------------------------------------------


@add("objective", f"WITH {LONG} SELECT id, round(-sqrt(avg((v - 0.1) ** 2)), 5) + 0.0 AS score FROM lone GROUP BY id")
def objective(spark: SparkSession, d: str) -> DataFrame:
    return E.objective(vectors(spark, d), 0.1).select("id", rnd("score", 5).alias("score"))


@add(
    "elite_topk",
    f"""WITH {LONG}, s AS (SELECT id, -sqrt(avg((v - 0.1) ** 2)) AS score FROM lone GROUP BY id)
    SELECT id FROM s QUALIFY row_number() OVER (ORDER BY score DESC, id DESC) <= greatest(1, round_even(0.125 * (SELECT count(*) FROM s), 0))""",
)
def elite_topk(spark: SparkSession, d: str) -> DataFrame:
    s = E.objective(vectors(spark, d), 0.1)
    return E.elites(s, 0.125, s.count()).select("id")


def _generation(g: int, coord: str) -> str:
    draw = rng.normal_sql(rng.key_sql(SEED + g, "diag", "'all'", "r.row", "pos", "0"))
    return f"""pop{g} AS (SELECT r.row, pos, mean + std * {draw} AS v, std FROM {coord}, range(64) AS r(row)), mark{g} AS (SELECT row, -sqrt(avg((v - 0.1) ** 2)) AS score FROM pop{g} GROUP BY row),
    best{g} AS (SELECT row, score FROM mark{g} ORDER BY score DESC, row DESC LIMIT 16), gen{g} AS (SELECT pos, avg(v) AS mean, greatest(stddev_pop(v), 0.1 * any_value(std)) AS std FROM pop{g} SEMI JOIN best{g} USING (row) GROUP BY pos)"""


@add(
    "evolve_history",
    f"WITH {LONG}, {_generation(0, 'coord')}, {_generation(1, 'gen0')}, {_generation(2, 'gen1')} "
    + " UNION ALL ".join(f"SELECT {g}::int AS gen, round((SELECT avg(score) FROM mark{g}), 5) + 0.0 AS mean_score, round((SELECT max(score) FROM mark{g}), 5) + 0.0 AS max_score, round((SELECT avg(score) FROM best{g}), 5) + 0.0 AS elite_mean" for g in range(3)),
)
def evolve_history(spark: SparkSession, d: str) -> DataFrame:
    _, history = E.evolve(coord(spark, d), lambda v: E.objective(v, 0.1), 3, 64, seed=SEED)
    return history.select("gen", *[rnd(c, 5).alias(c) for c in ("mean_score", "max_score", "elite_mean")])


@add("vectors_round_trip", f"WITH {LONG} SELECT tensor, id, pos, round(v, 5) + 0.0 AS v FROM many")
def vectors_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors to coordinates and back."""
    return _long_out(wide_form(long_form(vectors(spark, d, True), "e", "tensor", "id"), "tensor", "id"), "tensor", "id")
