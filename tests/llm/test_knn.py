import numpy as np
import pandas as pd
import pytest

from embermill.llm import knn as K

SCHEMA = "id bigint, tensor string, e array<double>, v string, u int, class string"


def table(spark, rows, tensor="t"):
    return spark.createDataFrame([(int(i), tensor, [float(z) for z in x] if x is not None else None, "x", 1, "c") for i, x in rows], SCHEMA)


def brute(x, k, least=-1.0, ids=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {i: [(int(j), s[i, j]) for j in order[i] if s[i, j] >= least] for i in range(len(x))}


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20, dim))
    # a third of all rows lie around one centre
    which = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, len(centres), n))
    return centres[which] + 0.25 * rng.standard_normal((n, dim))


def test_near_pairs_against_brute_force(spark):
    x = clustered(2000, 32)
    want = {(min(i, j), max(i, j)) for i, near in brute(x, 5, 0.9).items() for j, _ in near}
    got = {tuple(r) for r in K.similar_pairs(K.usable(table(spark, enumerate(x)), "t", 32)).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


def test_hot_buckets_are_cut_without_loss(spark):
    x = np.random.default_rng(1).standard_normal((400, 8)) * 0.05 + 1
    want = {(i, j) for i, near in brute(x, 3).items() for j, _ in near}
    rows = K.usable(table(spark, enumerate(x)), "t", 8)
    got = {(r["id"], r["neighbour"]) for r in K.neighbours(rows, 3, K.Plan(tables=3, functions=1, width=2.0, probes=3, most=50)).collect()}
    assert len(got & want) >= 0.97 * len(want)


def test_recall_of_stated_questions(spark):
    x = np.random.default_rng(2).standard_normal((1500, 48))
    rows = K.usable(table(spark, enumerate(x)), "t", 48)
    want = {i: {j for j, _ in near} for i, near in brute(x, 5).items() if i % 50 == 0}
    got = K.neighbours(rows, 5, K.FAR, asking=rows.filter("id % 50 = 0")).toPandas()
    assert set(got["id"]) == set(want)
    assert sum(len(want[i] & set(g["neighbour"])) for i, g in got.groupby("id")) >= 0.9 * 5 * len(want)
    assert (got.groupby("id").size() == 5).all()


def test_recall_of_stated_questions_of_a_large_table(spark):
    """Buckets of more than ``most`` vectors are asked whole too."""
    x = np.random.default_rng(4).standard_normal((60000, 24))
    rows = K.usable(spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "tensor": "t", "e": list(x)})), "t", 24)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ask = np.arange(0, len(x), 600)
    s = u[ask] @ u.T
    s[np.arange(len(ask)), ask] = -9
    want = dict(zip(ask.tolist(), np.argpartition(-s, 5, axis=1)[:, :5].tolist()))
    got = K.neighbours(rows, 5, K.FAR, asking=rows.filter("id % 600 = 0")).toPandas()
    assert set(got["id"]) == set(want)
    assert sum(len(set(want[i]) & set(g["neighbour"])) for i, g in got.groupby("id")) >= 0.95 * 5 * len(want)


def test_hot_group_of_a_large_table(spark):
    """A third of all rows lie in one dense group (pairwise cosine about 0.84, of the five nearest about 0.95)."""
    n, dim, rank = 120_000, 64, 32
    rng = np.random.default_rng(0)
    centre = rng.standard_normal(dim)
    spread = rng.standard_normal((n // 3, rank)) @ rng.standard_normal((rank, dim)) / np.sqrt(dim * rank)
    x = np.concatenate([centre / np.linalg.norm(centre) + 0.45 * spread, rng.standard_normal((n - n // 3, dim))])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    ask = np.arange(0, n // 3, 100)
    s = x[ask] @ x.T
    s[np.arange(len(ask)), ask] = -9
    near = np.argpartition(-s, 5, axis=1)[:, :5]
    want = {(min(i, j), max(i, j)) for a, (i, row) in enumerate(zip(ask.tolist(), near.tolist())) for j in row if s[a, j] >= 0.9}
    rows = K.usable(spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "tensor": "t", "e": list(x)})), "t", dim)
    got = K.similar_pairs(rows).toPandas()
    assert len(want & set(zip(got["id_a"].tolist(), got["id_b"].tolist()))) >= 0.98 * len(want) > 1000


def test_blocks_of_questions_lose_nothing(spark):
    x = np.random.default_rng(5).standard_normal((300, 8)) + 1
    rows = K.usable(table(spark, enumerate(x)), "t", 8)
    plan = dict(tables=2, functions=1, width=2.0, probes=2)
    whole, blocks = (sorted(map(tuple, K.neighbours(rows, 3, K.Plan(**plan, **limits)).collect())) for limits in ({}, {"most": 40, "asked": 25}))
    assert whole == blocks


@pytest.mark.parametrize("n", [40_000, 160_000])
def test_no_task_holds_a_hot_group(spark, n):
    """Nearly a third of all rows around one direction (cosine 0.98): the questions of the group step into the same
    few buckets, which are cut on both sides."""
    rng = np.random.default_rng(0)
    centre = rng.standard_normal(64)
    x = np.concatenate([centre / np.linalg.norm(centre) + 0.018 * rng.standard_normal((3 * n // 10, 64)), rng.standard_normal((n - 3 * n // 10, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    first = spark.createDataFrame(pd.DataFrame({"class": np.arange(n), "u": [c.tobytes() for c in K._codes(x)]}))
    asks, held = K._sides(first, first, K.near_plan(n), 64)
    largest = lambda df: df.groupBy("place").count().agg({"count": "max"}).first()[0]
    assert largest(asks) <= 31_000 and largest(held) <= 4_400


def test_recall_of_the_default_plan(spark, data):
    """Every vector of the table's tensors, however far its neighbours are."""
    v = spark.read.parquet(f"{data}/vectors.parquet").unionByName(spark.read.parquet(f"{data}/../sf0.01/vectors.parquet").selectExpr("id + 1000000 as id", "tensor", "corpus", "rel", "e"))
    for tensor, dim in (("clip", 64), ("embeds", 48)):
        rows = K.usable(v, tensor, dim)
        p = rows.toPandas().sort_values("id")
        want = {(a, b) for a, near in brute(np.stack(p["v"].to_numpy()), 5).items() for b, _ in near}
        at = dict(zip(p["id"].tolist(), range(len(p))))
        got = {(at[r["id"]], at[r["neighbour"]]) for r in K.neighbours(rows, 5).collect()}
        assert len(got & want) >= 0.9 * len(want)


def test_a_fitted_plan_reads_less_than_everything(spark):
    """Where neighbours are near, few buckets are enough, and the recall holds for rows outside the sample."""
    x = clustered(12_000, 32, 3)
    rows = K.usable(spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "tensor": "t", "e": list(x)})), "t", 32)
    plan = K.fitted_plan(K._classes(rows)[0], 5)
    assert plan.functions > 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ask = np.arange(0, len(x), 20)
    s = u[ask] @ u.T
    s[np.arange(len(ask)), ask] = -9
    want = {(i, j) for i, near in zip(ask.tolist(), np.argpartition(-s, 5, axis=1)[:, :5].tolist()) for j in near}
    got = {(r["id"], r["neighbour"]) for r in K.neighbours(rows, 5, plan, asking=rows.filter("id % 20 = 0")).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert K.fitted_plan(K._classes(rows.limit(0))[0], 5).probes == 3


def test_copies(spark):
    """A group of copies links every member to k others, and costs no pair for each pair of copies."""
    x = [[1.0, 0, 0]] * 40 + [[2.0, 0, 0]] * 3 + [[0, 1.0, 0.01]] * 2 + [[0, 1.0, 0.02]]
    got = K.neighbours(K.usable(table(spark, enumerate(x)), "t", 3), 5, least=0.9).toPandas()
    first = got[got["id"] == 0].sort_values("rank")
    assert first["neighbour"].tolist() == [1, 2, 3, 4, 5] and first["similarity"].tolist() == [1.0] * 5
    assert got[got["id"] == 41].sort_values("rank")["neighbour"].tolist() == [0, 1, 2, 3, 4]
    assert got[got["id"] == 43].sort_values("rank")["neighbour"].tolist() == [44, 45]
    assert len(got[got["id"] < 43]) == 43 * 5
    pairs = K.similar_pairs(K.usable(table(spark, enumerate(x)), "t", 3)).toPandas()
    assert (pairs["id_a"] < pairs["id_b"]).all() and not pairs.duplicated().any()


def test_usable(spark):
    rows = [(1, [1, 2]), (2, None), (3, []), (4, [1, 2, 3]), (5, [0, 0]), (6, [float("nan"), 1]), (7, [float("inf"), 1]), (8, [1e-300, 0]), (9, [1e300, 1e300])]
    df = table(spark, rows).unionByName(spark.createDataFrame([(10, "t", [1.0, None], "x", 1, "c"), (11, "other", [1.0, 2.0], "x", 1, "c"), (12, None, [1.0, 2.0], "x", 1, "c"), (None, "t", [1.0, 2.0], "x", 1, "c")], SCHEMA))
    u = K.usable(df, "t", 2)
    assert sorted(r["id"] for r in u.collect()) == [1, 8, 9]
    got = {(r["id"], r["neighbour"], r["rank"]) for r in K.neighbours(u, 5).collect()}
    assert {(a, b) for a, b, _ in got} == {(1, 8), (1, 9), (8, 1), (8, 9), (9, 1), (9, 8)}
    assert K.neighbours(u.limit(0)).collect() == [] == K.similar_pairs(u.limit(0)).collect()
    assert K.neighbours(u.filter("id = 1")).collect() == []
    twice = K.neighbours(u.unionByName(u), 5).collect()
    assert {(r["id"], r["neighbour"], r["rank"]) for r in twice} == got


def test_probe_sets_are_in_order():
    h = K._Hashes(K.Plan(functions=3, probes=20), 4)
    assert h.sets[0].sum() == 0 and len({tuple(s) for s in h.sets.tolist()}) == len(h.sets)
    m = 3
    for s in h.sets:
        assert not any(s[j] and s[2 * m - 1 - j] for j in range(m))


@pytest.mark.parametrize(("n", "functions"), [(0, 2), (300, 2), (100_000, 5), (10**9, 12)])
def test_plan_grows_with_the_table(n, functions):
    assert K.near_plan(n).functions == functions
