import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from embermill.__main__ import main
from embermill.api import Distribution, fresh_seed, prefix
from embermill.operators import sinks, slots


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(0).standard_normal((60, 6))
    return spark.createDataFrame([(t, i, v.tolist()) for t in ("a", "b") for i, v in enumerate(x)], "tensor string, id bigint, e array<double>").cache()


def test_distribution(spark, vectors, tmp_path):
    d = Distribution.fit(vectors, components=3, corpus=20)
    assert {(r["n_components"], r["corpus_rows"]) for r in d.summary().collect()} == {(3, 20)}
    for sampler in ("diagonal", "pca", "blend", "hybrid"):
        assert d.sample(4, sampler, seed=2).count() == 2 * 4 * 6
    assert d.distance(d.retarget(vectors, 2.0)).filter(F.abs(F.col("distance") - 2) > 1e-6).count() == 0
    for direction in ("outward", "axis", "random"):
        assert d.walk(vectors.filter("id = 0"), direction, 3, 0.5).count() == 6
    with pytest.raises(ValueError):
        d.walk(vectors, "sideways", 1, 1.0)
    r = d.refit(vectors.filter("id < 9"))
    assert r.axes is None and d.refit(vectors.filter("id < 9"), keep_axes=True).axes is not None
    with pytest.raises(ValueError):
        r.walk(vectors, "axis", 1, 1.0)
    assert len(d.save(str(tmp_path / "d"))) == 4
    back = Distribution.load(spark, str(tmp_path / "d"), ["a"])
    assert rows(back.sample(3, "pca", seed=1).withColumn("v", F.round("v", 9))) == rows(d.sample(3, "pca", seed=1).filter("tensor = 'a'").select("tensor", "row", "pos", F.round("v", 9)))
    assert (prefix("d", "sd15"), prefix("d", "sdxl")) == ("d", "d_sdxl") and 0 <= fresh_seed() < 2**31
    assert d.save(str(tmp_path / "e"), "sd2")[0] == str(tmp_path / "e_sd2/coord")
    pooled = Distribution.fit(vectors, hidden=2)
    assert pooled.coord.select("tensor", "mean").distinct().count() == 4


def test_slots(spark):
    b = slots.Backend("toy", {"x": (2, 3), "y": (1,)}, batch=2, load=lambda: lambda prompts: {"x": [[len(p)] * 6 for p in prompts], "y": [[1.0]] * len(prompts)})
    p = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "id bigint, prompt string")
    assert rows(slots.encode(p, b)) == sorted([("x", i, [float(n)] * 6) for i, n in ((1, 2), (2, 0), (3, 1))] + [("y", i, [1.0]) for i in (1, 2, 3)], key=repr)
    with pytest.raises(ValueError):
        slots.encode(p, slots.backend("sdxl"))
    with pytest.raises(ValueError):
        slots.backend("nonsense")
    wrong = slots.Backend("wrong", {"x": (5,)}, load=b.load)
    with pytest.raises(Exception, match="numbers for tensor"):
        slots.encode(p, wrong).collect()
    items, cache = spark.createDataFrame([("a",), ("b",), ("b",)], "rel string"), spark.createDataFrame([("a", [9.0, 9.0])], "rel string, e array<double>")
    assert rows(slots.embed_new(items, cache, lambda s: np.array([[3.0, 4.0]] * len(s)))) == [("a", [9.0, 9.0]), ("b", [0.6, 0.8])]
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id bigint, e array<double>")
    assert rows(slots.decode(v, lambda: lambda x: [bytes([int(r[0])]) for r in x])) == [(1, bytearray(b"\x01")), (2, bytearray(b"\x02"))]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None)], "rel string, temperature double, seed bigint")
    taken = [sinks.write_once(df, str(tmp_path / "sheet.parquet")) for _ in range(3)]
    assert [t.rsplit("/", 1)[1] for t in taken] == ["sheet.parquet", "sheet_1.parquet", "sheet_2.parquet"]
    for _ in range(2):
        sinks.append_manifest(df.withColumnRenamed("rel", "path"), str(tmp_path / "m"))
    got = spark.read.option("header", "true").csv(str(tmp_path / "m"))
    assert tuple(got.columns) == sinks.MANIFEST and got.count() == 2
    assert rows(sinks.sidecars(df)) == [("a", '{"temperature":1.5}')]
    news = spark.createDataFrame([("a", 2.0, 7), ("b", 3.0, 8)], df.schema)
    assert rows(sinks.merge_by_key(df, news, "rel")) == [("a", 2.0, 7), ("b", 3.0, 8)]


def test_main(spark, data, tmp_path, capsys):
    assert main([]) == 0 and "fit_coord" in capsys.readouterr().out
    assert main(["nonsense"]) == 2
    out = str(tmp_path / "out")
    assert main(["folder_counts", data, out]) == 0 and spark.read.parquet(out).count() > 0
