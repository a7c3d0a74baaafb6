import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from embermill.llm import packing as P


def check(sizes, bins, capacity, max_docs, max_cost):
    for b in set(bins.tolist()):
        s = sizes[bins == b]
        assert s.sum() <= capacity and len(s) <= max_docs and (s.astype(float) ** 2).sum() <= max_cost + 1e-6


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=300), st.integers(1, 12), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_capacity(sizes, max_docs, rule):
    s = np.sort(np.array(sizes))[::-1]
    cost = 10_000.0
    bins = P.best_fit(s, 100, max_docs, cost, rule)
    check(s, bins, 100, max_docs, cost)
    # no two containers could be one under the tokens, documents and cost together less than half used
    assert sorted(set(bins.tolist())) == list(range(bins.max() + 1))
    bound = max(-(-s.sum() // 100), -(-len(s) // max_docs))
    assert bins.max() + 1 <= 1.7 * bound + 2 + (s.astype(float) ** 2).sum() / cost * 1.7


def test_tight_instances():
    assert P.best_fit(np.array([60, 60, 40, 40]), 100, 9, 1e9).max() == 1
    assert P.best_fit(np.array([50, 50, 50]), 100, 9, 1e9).max() == 1
    assert P.best_fit(np.array([1] * 10), 100, 5, 1e9).max() == 1
    assert P.best_fit(np.array([10] * 10), 100, 10, 200.0).max() == 4  # two squares of 10 fill the cost


def frames(spark, sizes, capacities):
    items = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, size string, bin int, capacity double")
    kinds = spark.createDataFrame(capacities, "container string, capacity_tokens int")
    return items, kinds


def test_every_item_once(spark):
    rng = np.random.default_rng(5)
    sizes = [(int(i), int(n), "x", 1, 0.5) for i, n in enumerate(np.minimum(rng.lognormal(4.5, 1.0, 3000), 3000).astype(int))]
    items, kinds = frames(spark, sizes, [("short", 512), ("long", 2048), ("none", None), ("zero", 0)])
    for shard in (16_000, 400):
        got = P.pack(items, kinds, shard_items=shard).toPandas()
        assert set(got["container"]) == {"short", "long"}
        for name, cap in (("short", 512), ("long", 2048)):
            g = got[got["container"] == name]
            assert g.groupby("bin")["n_tokens"].sum().max() <= cap
            # a document's pieces follow each other and make up its tokens; only documents above the capacity have some
            total = g.groupby("doc_id")["n_tokens"].sum()
            assert total.to_dict() == {i: n for i, n, *_ in sizes}
            assert all((n > cap) == (len(x) > 1) or n == 0 for n, x in ((total[k], x) for k, x in g.groupby("doc_id")))
            for _, x in g[g["piece"] > 0].groupby("doc_id"):
                assert (x["start"] == x["piece"] * cap).all()
            assert len(g["bin"].unique()) <= 1.02 * (-(-g["n_tokens"].sum() // cap)) + 2


def test_dirt(spark):
    items, kinds = frames(spark, [(1, None, None, None, None), (None, 5, None, None, None), (2, 0, None, None, None), (2, 0, None, None, None), (3, -4, None, None, None), (4, 1024, None, None, None), (5, 1025, None, None, None)], [("short", 512)])
    got = P.pack(items, kinds).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["n_tokens"]) for r in got) == [(0, 0, 5), (1, 0, 0), (2, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 512), (4, 1, 512), (5, 0, 512), (5, 1, 512), (5, 2, 1)]
    assert len({r["bin"] for r in got}) == 5
    assert P.pack(items.limit(0), kinds).collect() == [] == P.pack(items, kinds.limit(0)).collect()


def test_equal_and_null_ids_above_the_capacity_are_separate_items(spark):
    items, kinds = frames(spark, [(1, 30, None, None, None), (1, 30, None, None, None), (None, 25, None, None, None), (None, 25, None, None, None), (2, 10, None, None, None)], [("ten", 10)])
    got = P.pack(items, kinds).toPandas()
    assert got.groupby("bin")["n_tokens"].sum().max() == 10 and got["n_tokens"].sum() == 120
    assert sorted(got[got["doc_id"].isna()]["piece"].tolist()) == [0, 0, 1, 1, 2, 2]


def test_the_query_with_every_limit_binding(spark, data):
    """Places and attention cost bind beside the tokens; no container exceeds any of the three."""
    from embermill.llm import queries as Q

    got = Q.p7_limited(spark, data).toPandas()
    caps = {r["container"]: r["capacity_tokens"] for r in spark.read.parquet(f"{data}/containers.parquet").collect()}
    per = got.assign(cost=got["n_tokens"].astype(float) ** 2).groupby(["container", "bin"]).agg(tokens=("n_tokens", "sum"), docs=("doc_id", "size"), cost=("cost", "sum")).reset_index()
    for c, cap in caps.items():
        g = per[per["container"] == c]
        assert g["tokens"].max() <= cap and g["docs"].max() == Q.DOCS_A_BIN and g["cost"].max() <= Q.COST_SHARE * cap**2
        single = g["docs"] > 1
        assert (g[single]["cost"] > 0.8 * Q.COST_SHARE * cap**2).any()
    assert got.groupby(["container", "doc_id"])["n_tokens"].sum().groupby("container").sum().nunique() == 1


def test_document_limit(spark):
    items, kinds = frames(spark, [(i, 1, None, None, None) for i in range(100)], [("short", 512)])
    got = P.pack(items, kinds, max_docs=8).toPandas()
    assert got.groupby("bin").size().max() == 8 and got["bin"].nunique() == 13


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_rules(rule):
    s = np.sort(np.random.default_rng(2).integers(1, 60, 500))[::-1]
    assert P.best_fit(s, 100, 50, 1e9, rule).max() + 1 <= 1.05 * s.sum() / 100 + 1
