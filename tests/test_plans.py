"""Properties of physical plans that must hold at any size."""

import re

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from embermill.operators import distribution as D
from embermill.plans.common import vectors
from embermill.plans.registry import registry

#: Queries whose definition is a product with a short list (a grid, a set of draws, the rows of a sample).
GRIDS = {"combo_grid", "sweep_grid", "sample_diagonal", "sample_blend", "sample_pca", "sample_hybrid", "walk_random", "neighborhood", "resonance_grad1", "neg_vector", "nearest_token", "weighted_choice", "lost_jobs", "band_scale", "trajectory", "film_frames", "evolve_history", "frontier", "resonance", "guided_combo", "guided_sampler"}
NAMES = sorted(n for n, q in registry.queries.items() if not q.__module__.startswith("embermill.llm"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_slow_operator(spark, data, name):
    text = plan(registry.queries[name](spark, data))
    assert "BatchEvalPython" not in text  # row-at-a-time Python
    assert "CartesianProduct" not in text
    # with a single tensor the key of the one-row statistics is a constant, so their join has no key left
    if name not in GRIDS and not registry.queries[name].__module__.endswith((".statistics", ".film")):
        assert "BroadcastNestedLoopJoin" not in text


def test_scans_read_what_is_needed(spark, data):
    text = plan(registry.queries["p1_found"](spark, data))
    assert re.search(r"ReadSchema: struct<rel:string,size:bigint,scanned_at:timestamp_ntz>", text)
    text = plan(registry.queries["scale_anti_join"](spark, data))
    assert "GreaterThan(l_quantity,25.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_ranks_are_limited_before_the_shuffle(spark, data):
    for name in ("newest_per_bucket", "dedupe_keep_first", "corpus_subset"):
        assert "WindowGroupLimit" in plan(registry.queries[name](spark, data))
    assert "TakeOrderedAndProject" in plan(registry.queries["top_rated"](spark, data))


def test_distances_shuffle_no_vectors(spark, data):
    """The statistics travel, the vectors stay: the vectors' side has no exchange."""
    v = vectors(spark, data, grouped=True)
    text = plan(D.distance(v, D.fit(v)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
