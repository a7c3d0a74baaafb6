"""Statistical and geometric invariants, on seeded data."""

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from embermill.functions import rng as R
from embermill.functions.vector import lerp, long_form, slerp, wide_form
from embermill.operators import distribution as D
from embermill.operators import evolve as E
from embermill.operators import navigate as N

DIM = 12


def frame(spark, x, tensor="t"):
    return spark.createDataFrame([(tensor, i, [float(z) for z in v]) for i, v in enumerate(x)], "tensor string, id bigint, e array<double>")


def array(df, *keys):
    got = wide_form(df, *keys).collect()
    return np.array([r["e"] for r in sorted(got, key=lambda r: [r[k] for k in keys])])


@pytest.fixture(scope="module")
def known():
    rng = np.random.default_rng(0)
    mean, std = rng.standard_normal(DIM), rng.uniform(0.3, 1.5, DIM)
    return mean, std, mean + std * rng.standard_normal((4000, DIM))


@pytest.fixture(scope="module")
def low_rank(spark):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((DIM, 3)))[0].T
    x = rng.standard_normal((80, 3)) * [4, 2, 1] @ basis + 0.5
    v = frame(spark, x).cache()
    return x, basis, v, D.fit(v), D.principal_axes(v, DIM, 3)


def stats(coord):
    r = coord.orderBy("pos").collect()
    return np.array([x["mean"] for x in r]), np.array([x["std"] for x in r])


def test_fit_recovers_the_marginals(spark, known):
    mean, std, x = known
    m, s = stats(D.fit(frame(spark, x)))
    assert np.abs(m - mean).max() < 0.1 and np.abs(s - std).max() < 0.05
    assert np.allclose(m, x.mean(0)) and np.allclose(s, x.std(0))


def test_fit_pooled(spark, known):
    x = known[2][:50]
    m, s = stats(D.fit_pooled(frame(spark, x), 4))
    pooled = x.reshape(-1, 4)
    assert np.allclose(m, np.tile(pooled.mean(0), 3)) and np.allclose(s, np.tile(pooled.std(0), 3))


def test_one_vector_and_none(spark):
    one = frame(spark, [[1.0, 2.0]])
    assert rows(D.fit(one).select("pos", "mean", "std")) == [(0, 1.0, 1e-4), (1, 2.0, 1e-4)]
    assert rows(D.total_variance(one)) == [("t", 0.0)]
    empty = one.limit(0)
    for df in (D.fit(empty), D.total_variance(empty), D.covariance(empty, 2), D.corpus_subset(empty), D.distance(empty, D.fit(one))):
        assert df.collect() == []


def test_covariance_and_axes(spark, low_rank):
    x, basis, v, _, axes = low_rank
    c = np.cov(x.T)
    for r in D.covariance(v, DIM).collect():
        assert abs(c[r["i"], r["j"]] - r["cov"]) < 1e-9
    a = np.array([r["axis"] for r in axes.orderBy("k").collect()])
    assert np.abs(a - a @ basis.T @ basis).max() < 1e-6  # in the subspace
    assert np.allclose([r["std"] for r in axes.orderBy("k").collect()], np.linalg.svd(x - x.mean(0))[1][:3] / np.sqrt(len(x) - 1))
    assert D.variance_fraction(axes, D.total_variance(v)).first()["fraction"] == pytest.approx(1.0)
    assert D.principal_axes(v.filter("id < 2"), DIM, 5).count() == 1  # at most n - 1


def test_samplers(spark, low_rank):
    x, basis, v, coord, axes = low_rank
    mean = x.mean(0)
    p1, p4 = (array(D.sample(15, coord, axes, sampler="pca", temperature=t, seed=3), "row") for t in (1.0, 4.0))
    assert np.abs((p1 - mean) - (p1 - mean) @ basis.T @ basis).max() < 1e-6
    assert np.allclose(p4 - mean, 4 * (p1 - mean))
    ends = [array(D.sample(5, coord, axes, sampler="blend", coherence=c, seed=3), "row") for c in (0.0, 1.0)]
    assert np.array_equal(ends[0], array(D.sample(5, coord, seed=3), "row")) and np.allclose(ends[1], p1[:5])
    h = array(D.sample(10, coord, corpus=D.corpus_subset(v), sampler="hybrid", temperature=0.0, seed=3), "row")
    norms = np.linalg.norm(x, axis=1)
    assert h.shape == (10, DIM) and (np.linalg.norm(h, axis=1) <= norms.max() + 1e-9).all()
    with pytest.raises(ValueError):
        D.sample(1, coord, sampler="nonsense")
    for s in ("pca", "blend", "hybrid"):
        with pytest.raises(ValueError):
            D.sample(1, coord, sampler=s)
    assert D.sample(3, coord, corpus=v.limit(1), sampler="hybrid").collect() == []


def test_sampling_statistics(spark, known):
    x = known[2]
    coord = D.fit(frame(spark, x)).cache()
    s = array(D.sample(1500, coord, seed=5), "row")
    assert np.abs(s.std(0) / x.std(0) - 1).max() < 0.12
    t = array(D.sample(300, coord, temperature=2.0, seed=5), "row")
    assert np.allclose(t - x.mean(0), 2 * (s[:300] - x.mean(0)))
    z = (array(D.sample(400, coord, truncation=0.5, seed=5), "row") - x.mean(0)) / x.std(0)
    assert np.abs(z).max() <= 0.5 + 1e-9
    again = D.sample(20, coord.repartition(7), seed=5)
    assert rows(again) == rows(D.sample(20, coord, seed=5))  # whatever the partitioning


def test_distances_and_shells(spark, known):
    v = frame(spark, known[2][:300]).cache()
    coord = D.fit(v).cache()
    d = [r["distance"] for r in D.distance(v, coord).collect()]
    assert np.mean(d) == pytest.approx(1.0, abs=0.1)
    out = N.retarget(v, coord, 2.5)
    assert all(abs(r["distance"] - 2.5) < 1e-6 for r in D.distance(out, coord).collect())
    low = min(r["distance"] for r in D.distance(N.floor_distance(v, coord, 1.0), coord).collect())
    assert low == pytest.approx(1.0)
    walk = N.walk_outward(v.limit(1), coord, 4, 0.5)
    steps = [r["distance"] for r in D.distance(walk.select("tensor", F.col("i").alias("id"), "e"), coord).orderBy("id").collect()]
    assert steps == sorted(steps) and len(steps) == 4
    m, s = stats(coord)
    far = frame(spark, [m + 9 * s])
    assert np.allclose(array(long_form(D.project(far, coord), "e", "id"), "id")[0], m + 3 * s)


def test_radius_is_linear(spark, low_rank):
    x, _, v, coord, axes = low_rank
    for ax in (None, axes):
        a, b = (array(N.neighbourhood(v.filter("id = 3"), coord, 5, r, 1, ax).drop("tensor", "id"), "row") for r in (0.5, 3.0))
        assert np.allclose(b - x[3], 6 * (a - x[3]))


def test_breeding_lies_between(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((2, 16))
    p = spark.createDataFrame([("t", 1, a.tolist(), b.tolist())], "tensor string, id bigint, a array<double>, b array<double>")
    kids = array(N.breed(p, 5).drop("tensor", "id"), "i")
    cos = kids @ a / np.linalg.norm(kids, axis=1)
    assert (np.diff(cos) < 0).all()
    changed = array(N.breed(p, 5, 0.1, D.fit(frame(spark, rng.standard_normal((9, 16))))).drop("tensor", "id"), "i")
    assert not np.allclose(kids, changed)


def test_slerp(spark):
    a, b = [3.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(a, b, [0.0, 0.0], [6.0, 1e-9])], "a array<double>, b array<double>, zero array<double>, near array<double>")
    at = lambda t, x="a", y="b", **o: np.array(df.select(slerp(F.col(x), F.col(y), t, **o).alias("e")).first()["e"])
    assert np.allclose(at(0.0), a) and np.allclose(at(1.0), b)
    assert np.linalg.norm(at(0.5)) == pytest.approx(2.0) and at(0.5)[0] == pytest.approx(at(0.5)[1])
    assert np.allclose(at(0.25, "zero"), [0.0, 0.25])
    assert np.allclose(at(0.5, "a", "near"), [4.5, 0]) and np.allclose(at(0.5, "a", "near", raw=True), [4.5, 0])
    assert np.allclose(df.select(lerp(F.col("a"), F.col("b"), 0.5).alias("e")).first()["e"], [1.5, 0.5])


def test_evolution_improves(spark, known):
    coord = D.fit(frame(spark, known[2])).cache()
    end, history = E.evolve(coord, lambda v: E.objective(v, 1.0), 4, 60, seed=1)
    assert E.improved(history) and history.count() == 4
    r = history.orderBy("gen").collect()
    assert r[-1]["mean_score"] > r[0]["mean_score"]
    with pytest.raises(ValueError):
        E.evolve(coord, lambda v: E.objective(v, 1.0).limit(3), 1, 10)
    assert not E.improved(history.limit(1))


def test_refit_keeps_a_tenth_of_the_spread(spark):
    base = spark.createDataFrame([("t", 0, 0.0, 2.0)], "tensor string, pos int, mean double, std double")
    same = frame(spark, [[1.0], [1.0], [1.0]])
    assert rows(D.refit(base, same)) == [("t", 0, 1.0, 0.2)]


def test_save_and_load(spark, tmp_path, low_rank):
    _, _, v, coord, axes = low_rank
    path = str(tmp_path / "d")
    assert len(D.save(path, coord, D.total_variance(v), axes)) == 3
    got = D.load(spark, path, ["t"])
    assert set(got) == {"coord", "meta", "axes"} and rows(got["coord"].select("pos", "mean")) == rows(coord.select("pos", "mean"))
    with pytest.raises(Exception):  # noqa: B017
        D.save(path, coord, D.total_variance(v))
    with pytest.raises(FileNotFoundError):
        D.load(spark, str(tmp_path / "none"))


def test_draws(spark):
    k = spark.range(20000).select(R.uniform(R.key(1, "s", F.col("id"))).alias("u"), R.normal(R.key(1, "s", F.col("id"))).alias("z")).toPandas()
    assert 0 <= k["u"].min() and k["u"].max() < 1 and abs(k["u"].mean() - 0.5) < 0.02
    assert abs(k["z"].mean()) < 0.03 and abs(k["z"].std() - 1) < 0.03
