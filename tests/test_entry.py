"""Every registered query of the core against its oracle, on whole small tables."""

from __future__ import annotations

import importlib
import sys

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from embermill.plans.registry import Registry, registry

NAMES = sorted(n for n in registry.queries if not hasattr(registry.queries[n], "__module__") or not registry.queries[n].__module__.startswith("embermill.llm"))


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    pdf = registry.queries[name](spark, data).toPandas()
    if name in registry.sql:
        assert compare(pdf, duck, registry.sql[name]) == "OK"
    else:
        assert len(pdf) > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_name_is_registered_once():
    r = Registry()
    r.add("a")(lambda s, d: None)
    with pytest.raises(ValueError):
        r.add("a")(lambda s, d: None)


def test_the_core_imports_nothing_of_the_subpackage():
    code = [p.read_text() for p in __import__("pathlib").Path(entry.__file__).parent.joinpath("embermill").rglob("*.py") if "llm" not in p.parts]
    assert not any("embermill.llm" in c for c in code)
    assert importlib.import_module("embermill.plans.registry") is sys.modules["embermill.plans.registry"]
