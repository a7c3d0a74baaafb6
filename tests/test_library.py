import math

import numpy as np
import pytest
from helpers import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embermill.operators import film as M
from embermill.operators import library as L
from embermill.operators import lineage as A
from embermill.operators import prompts as P
from embermill.operators import records as R
from embermill.operators import taste as S
from embermill.sources import tables as sources


def peel(points, most=120):
    """Layers by peeling, one after the other."""
    left = sorted(points, key=lambda p: (-p[1], p[0]))
    out, layer = [], 0
    while left and len(out) < most:
        best, front, rest = -math.inf, [], []
        for p in left:
            if p[2] > best:
                front.append(p)
                best = p[2]
            else:
                rest.append(p)
        out += [(*p, layer) for p in sorted(front, key=lambda p: (-p[2], -p[1], p[0]))]
        left, layer = rest, layer + 1
    return out[:most]


@pytest.mark.parametrize(("n", "digits", "one_task"), [(300, 1, 500_000), (300, 1, 0), (500, 6, 0), (40, 6, 500_000)])
def test_pareto(spark, n, digits, one_task):
    rng = np.random.default_rng(n + digits)
    points = [(f"i{k:04d}", round(float(a), digits), round(float(b), digits)) for k, (a, b) in enumerate(rng.random((n, 2)))]
    df = spark.createDataFrame(points, "rel string, nov double, r double").repartition(5)
    got = [tuple(r) for r in L.pareto_layers(df, one_task=one_task).collect()]
    assert got == peel(points)
    assert rows(L.pareto_front(df)) == sorted(p[:3] for p in peel(points, 10**9) if p[3] == 0)
    assert L.pareto_layers(df.limit(0)).collect() == [] == L.pareto_front(df.limit(0)).collect()


def test_eligibility(spark):
    df = spark.createDataFrame([("a", 0.1, 0.0, 5.0), ("b", 0.1, 0.0, None), ("c", 0.1, None, 3.0), ("d", None, 0.9, 1.0), ("e", 0.1, 0.4, None)], "rel string, nov double, res double, score double")
    assert rows(L.rated(df).select("rel", "r")) == [("a", 0.0), ("c", 3.0), ("e", 0.4)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 100])
def test_index_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.sort(np.round(rng.random(n) * 4, 1))
    df = spark.createDataFrame([("g", float(v), 0) for v in rng.permutation(x)] + [("g", None, 1), ("h", None, 1)], "g string, x double, n int").drop("n")
    assert [(r["n"], r["lo"], r["hi"]) for r in L.index_quantiles(df, ["g"], "x").collect()] == [(n, x[n // 4], x[3 * n // 4])]


def test_novelty(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 8))
    x[7] = x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, e array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(50)
    for block in (2048, 7):
        got = {r["id"]: r["novelty"] for r in L.novelty(df, block=block).collect()}
        assert all(abs(got[i] - (1 - s[i].max())) < 1e-4 for i in range(50)) and abs(got[7]) < 1e-9
    asked = L.novelty(df, df.filter("id < 3"), 7).collect()
    assert sorted(r["id"] for r in asked) == [0, 1, 2]
    assert L.novelty(df.limit(1)).collect() == []


def test_places(spark):
    df = spark.createDataFrame([(i, (i * 7) % 10) for i in range(100)], "id int, k int").repartition(6)
    got = L.placed(df, [F.col("k"), F.col("id")]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 101)) and [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)
    with pytest.raises(ValueError):
        L.resort(df, "nonsense")


def test_lineage(spark):
    e = spark.createDataFrame([(i, i - 1) for i in range(1, 10)] + [(20, 21), (21, 20), (30, 99), (None, 1), (2, None)], "child int, parent int")
    n = spark.createDataFrame([(9,), (4,), (0,), (20,), (30,)], "node int")
    assert ({(r["ancestor"], r["hop"]) for r in A.ancestors(n.filter("node = 9"), e, 6).collect()}) == {(9 - h, h) for h in range(1, 7)}
    fit = spark.createDataFrame([(0,), (5,)], "node int")
    assert rows(A.root_with(n, e, fit)) == [(0, 0), (20, None), (30, None), (4, 0), (9, 5)]
    # five nodes are tested, the start among them
    assert rows(A.root_with(n.filter("node = 4"), e, fit.filter("node = 0"), tested=4)) == [(4, None)]
    values = spark.createDataFrame([(4, None), (3, "x"), (2, "y")], "node int, value string")
    assert rows(A.inherit(n.filter("node = 4"), e, values)) == [(4, "x", 3)]
    kinds = spark.createDataFrame([(9, "refine"), (8, "refine"), (7, "generate")], "node int, kind string")
    assert rows(A.climb_while(n.filter("node in (9, 4)"), e, kinds, "refine")) == [(4, 4), (9, 7)]


def test_resonance(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 6))
    fav = [i for i in range(300) if x[i, 0] > 1]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, e array<double>")
    f = spark.createDataFrame([(i,) for i in fav] + [(fav[0],)], "id bigint")
    train = S.training_rows(v, f)
    w = S.fit_resonance(train)
    p = {r["id"]: r["resonance"] for r in S.resonance(v, w).collect()}
    assert len(p) == 300 and np.mean([p[i] for i in fav]) > 0.7 > 0.4 > np.mean([p[i] for i in range(300) if i not in fav])
    one = S.fit_resonance(train, steps=1)
    assert np.allclose([r["w"] for r in S.first_gradient(train).orderBy("pos").collect()], one[:-1])
    assert S.fit_resonance(S.training_rows(v, f.filter("id < 0"))) is None
    assert S.resonance(v, None).collect() == []


def test_scorers(spark):
    df = spark.range(5)
    assert S.scored(df, S.get_scorer("RANDOM")).filter("score >= 0 and score < 10").count() == 5
    with pytest.raises(ValueError):
        S.get_scorer("nonsense")
    with pytest.raises(Exception, match="scores for"):
        S.scored(df, lambda pdf: [1.0]).collect()


def test_weighted_choice(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 0), ("c", 0)], "option string, n bigint")
    draws = spark.createDataFrame([(0, 0.0), (1, 0.83), (2, 0.84), (3, 0.99)], "draw int, u double")
    assert rows(S.weighted_choice(counts, draws)) == [(0, "a"), (1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize(("text", "value"), [("1+2*3", 7), ("2^3^2", 512), ("-(2)", -2), ("7%4", 3), ("1/0", None), ("5%0", None), ("2+", None), ("(", None), ("", None), (None, None), ("1.5e", None), ("-2^2", 4), ("-(2^2)", -4), ("1.", None), ("2^-1", 0.5), ("9^9^9", None), ("(" * 9000, None)])
def test_calc(text, value):
    assert R.calculate(text) == value


@given(st.recursive(st.integers(0, 99).map(str), lambda x: st.builds("({} {} {})".format, x, st.sampled_from("+-*"), x), max_leaves=8))
def test_calc_equals_python(text):
    assert R.calculate(text) == eval(text)  # noqa: S307


def test_records(spark):
    df = spark.createDataFrame([("a b/c!!",), ("--",), ("x" * 90,), (None,)], "t string")
    assert [r[0] for r in df.select(R.slug(F.col("t"))).collect()] == ["a-b-c", "", "x" * 40, None]
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"b": "3"}), ({"a": "1"}, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in m.select(R.merged(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "3"}, {"b": "3"}, {"a": "1"}]
    names = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3), ("s", 4)], "name string, o int")
    assert [r["unique"] for r in R.unique_names(names, "name", "o").orderBy("o").collect()] == ["s", "s_1", "t", "s_2"]
    lst = spark.createDataFrame([(i, c) for i, c in enumerate("abcd")], "ord int, item string")
    order = lambda df: "".join(r["item"] for r in df.orderBy("ord").collect())
    assert [order(R.move(lst, *a)) for a in ((0, 2), (3, 0), (1, 99), (9, 0))] == ["bcad", "dabc", "acdb", "abcd"]


def test_films(spark):
    with pytest.raises(ValueError):
        M.frame_count(3, 0)
    with pytest.raises(ValueError):
        M.ease(F.lit(0.0), "nonsense")
    assert [M.frame_count(*a) for a in ((3, 4), (3, 6, True), (3, 6), (1 + 1, 10))] == [9, 19, 13, 11]
    plan = [tuple(r) for r in M.frame_plan(spark, 3, 2).orderBy("frame").collect()]
    assert plan == [(0, 0, 0.0), (1, 0, 0.5), (2, 1, 0.0), (3, 1, 0.5), (4, 1, 1.0)]
    keys = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "ord int, e array<double>")
    loop = M.trajectory(keys, M.frame_plan(spark, 3, 2, loop=True), "lerp", loop=True)
    first, last = (rows(loop.filter(F.col("frame") == f).select("pos", "v")) for f in (0, 6))
    assert first == last == [(0, 1.0), (1, 0.0)]
    t = [r[0] for r in spark.range(0, 21).select(M.ease(F.col("id") / 20, "smoother")).collect()]
    assert t == sorted(t) and t[0] == 0 and t[-1] == 1


@pytest.mark.parametrize("length", [100, 768, 769, 1000, 1536, 3000])
def test_tiles_cover(spark, length):
    s = spark.range(1).select(M.tile_starts(F.lit(length), 768, 128).alias("s")).first()["s"]
    assert s[0] == 0 and s[-1] == max(0, length - 768) and all(b - a <= 640 for a, b in zip(s, s[1:]))


def test_film_manifests(spark):
    videos = spark.createDataFrame([("a", "a.mp4", 10, 5), ("b", "b.mp4", 30, 6), ("c", "c.mp4", 20, 7), ("a", "z.mp4", 10, 8)], "dir string, name string, mtime bigint, size bigint")
    texts = spark.createDataFrame([("a", '{"frames": 49, "fps": 24, "interp": "slerp", "loop": true, "keyframes": ["x", "y"]}'), ("a", None), ("b", '{"frames": 4'), ("d", "{}")], "dir string, text string")
    got = L.films(videos, texts).collect()
    assert [(r["name"], r["frames"], r["loop"], r["keyframes"]) for r in got] == [("b.mp4", None, None, None), ("c.mp4", None, None, None), ("a.mp4", 49, True, ["x", "y"]), ("z.mp4", 49, True, ["x", "y"])]


def test_films_of_a_folder(spark, tmp_path):
    for name, text in (("a", '{"frames": 9, "interp": "slerp"}'), ("b", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.mp4").write_bytes(b"12345")
        if text:
            (tmp_path / name / "film.json").write_text(text)
    got = {(r["dir"], r["name"], r["size"], r["frames"], r["interp"]) for r in sources.read_films(spark, str(tmp_path)).collect()}
    assert got == {("a", "a.mp4", 5, 9, "slerp"), ("b", "b.mp4", 5, None, None)}


def test_too_many_keyframes(spark):
    v = spark.range(70).select(F.col("id").cast("string").alias("key"), F.lit("clip").alias("tensor"), F.array(F.lit(1.0)).alias("e"))
    with pytest.raises(ValueError, match="64"):
        L.keyframe_tensors(v, v.select("key"), ("clip",))
    assert L.keyframe_tensors(v, v.select("key").limit(64), ("clip",)).filter("size(missing) > 0").count() == 0


def test_wild_values_leave_the_others_apart(spark):
    x = [float(i % 97) / 7 for i in range(2000)] + [1e300, -1e300, 1e12, 0.0]
    got = L.index_quantiles(spark.createDataFrame([("a", v) for v in x] + [("b", None)], "k string, x double"), ["k"], "x").collect()
    x.sort()
    assert [(r["k"], r["n"], r["lo"], r["hi"]) for r in got] == [("a", 2004, x[501], x[1503])]


def test_composed_prompts(spark):
    words = {"subject": ["a", "b"], "medium": ["c"], **dict.fromkeys(("aesthetic", "lighting", "composition", "mood", "palette"), ["d"]), "quality": ["e", "f"]}
    got = [r["prompt"] for r in P.compose(spark, 30, 1, P.PLAIN, words).collect()]
    assert len(set(got)) == 30 and all(p.split(", ")[1] == "c" and not ("e, e" in p or "f, f" in p) for p in got)
    with pytest.raises(ValueError, match="only"):
        P.compose(spark, 3, 1, P.PLAIN[:2], words)


def test_priors_for_each_option(spark):
    counts = spark.createDataFrame([("a", 1), ("gone", 50)], "option string, n bigint")
    draws = spark.createDataFrame([(i, i / 10) for i in range(10)], "draw int, u double")
    assert [r[1] for r in rows(S.weighted_choice(counts, draws, {"a": 1, "b": 5, "c": 3}))] == ["a"] * 2 + ["b"] * 5 + ["c"] * 3


def test_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# no\n\n  a red fox  \n b\n\t\n")
    assert rows(sources.read_prompts(spark, str(tmp_path / "p.txt"))) == [("a red fox",), ("b",)]
    assert sources.table_or_empty(spark, str(tmp_path / "none"), "a int").collect() == []
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.png").write_bytes(png)
    (tmp_path / "d/b.png").write_bytes(b"no")
    assert sorted((r["height"] or 0, r["width"] or 0) for r in sources.png_sizes(spark, str(tmp_path / "d")).collect()) == [(0, 0), (480, 640)]
