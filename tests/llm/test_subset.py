import numpy as np

from embermill.llm import subset as S


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(z) for z in v], "x") for i, v in enumerate(x)], "id bigint, v array<double>, rank string")


def kinds(seed=0):
    """A group of half of all rows, some middling ones, and rare kinds of three rows."""
    rng = np.random.default_rng(seed)
    size = [600] + [60] * 8 + [3] * 12
    centres = np.linalg.qr(rng.standard_normal((32, 32)))[0][: len(size)]
    which = np.repeat(np.arange(len(size)), size)
    x = centres[which] + 0.05 * rng.standard_normal((len(which), 32))
    order = rng.permutation(len(which))
    return x[order], which[order]


def test_every_kind_comes_first(spark):
    x, which = kinds()
    got = [r["id"] for r in S.varied(table(spark, x).repartition(7), 60).orderBy("rank").collect()]
    assert len(set(got)) == 60
    assert len(set(which[got[:21]])) == 21  # as many kinds as picks
    assert np.bincount(which[got])[0] <= 12


def test_subsets_are_nested(spark):
    x, _ = kinds(1)
    rows = table(spark, x).repartition(4).cache()
    long = [r["id"] for r in S.varied(rows, 20).orderBy("rank").collect()]
    assert [r["rank"] for r in S.varied(rows, 20).orderBy("rank").collect()] == list(range(1, 21))
    assert len(long) == 20


def test_more_than_there_is(spark):
    x, _ = kinds(2)
    got = S.varied(table(spark, x[:10]), 25).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(i + 1, i) for i in range(10)]
    assert S.varied(table(spark, x[:10]), 0).collect() == [] == S.varied(table(spark, x[:10]).limit(0), 5).collect()


def test_more_than_one_round(spark, monkeypatch):
    monkeypatch.setattr(S, "ROUND", 16)
    x, which = kinds(5)
    got = [r["id"] for r in S.varied(table(spark, x).repartition(3), 60).orderBy("rank").collect()]
    assert len(set(got)) == 60 and len(set(which[got[:30]])) == 21


def test_the_result_is_a_function_of_the_data(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    x, _ = kinds(6)
    first, second = ([r["id"] for r in S.varied(table(spark, x[::1]).repartition(n), 30).orderBy("rank").collect()] for n in (2, 9))
    assert first == second


def test_rows_that_stand_for_nothing_but_themselves_come_late(spark):
    """Groups before single rows, though a single row is the farthest from all others."""
    x, which = kinds(7)
    lone = np.random.default_rng(8).standard_normal((200, 32))
    got = [r["id"] for r in S.varied(table(spark, np.concatenate([x, 3 * lone])), 21).collect()]
    assert sum(i < len(x) for i in got) >= 19 and len({which[i] for i in got if i < len(x)}) >= 19


def groups(x, least, size=5):
    """Connected components of at least ``size`` rows at a cosine of ``least``; -1 for the rest."""
    s = x @ x.T >= least
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                near = np.flatnonzero(s[todo.pop()] & (label < 0))
                label[near] = i
                todo += near.tolist()
    few = np.bincount(label, minlength=len(x)) < size
    return np.where(few[label], -1, label)


def test_groups_and_distances_of_the_tables_against_random_picks(spark, data):
    """More groups are touched, and the mean distance to the nearest pick is less, than by any of 20 random draws."""
    from embermill.llm import knn

    rows = knn.usable(spark.read.parquet(f"{data}/../sf0.1/vectors.parquet"), "clip", 64)
    p = rows.toPandas().sort_values("id").reset_index(drop=True)
    x = np.stack(p["v"].to_numpy())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = dict(zip(p["id"], p.index))
    picks = [at[r["id"]] for r in S.varied(rows, 200).orderBy("rank").collect()]
    labels = groups(x, 0.6), groups(x, 0.9)

    def measures(k):
        return *(len({*g[k].tolist()} - {-1}) for g in labels), np.sqrt(np.maximum(2 - 2 * (x @ x[k].T).max(1), 0)).mean()

    for n in (12, 48, 200):
        draws = [measures(np.random.default_rng(i).choice(len(x), n, False)) for i in range(20)]
        a, b, far = measures(picks[:n])
        assert a > max(d[0] for d in draws) and b > max(d[1] for d in draws) and far < min(d[2] for d in draws)


def test_copies_come_last(spark):
    x = [[1.0, 0, 0]] * 50 + [[0, 2.0, 0]] + [[0, 0, 0.5]] + [[3.0, 0, 0]] * 2
    got = [r["id"] for r in S.varied(table(spark, x).repartition(3), 6).orderBy("rank").collect()]
    assert {50, 51} < set(got[:3]) and len(set(got)) == 6
    twice = table(spark, x[:3]).unionByName(table(spark, x[:3])).unionByName(table(spark, [[0, 1.0, 0]], 9))
    assert sorted(r["id"] for r in S.varied(twice, 3).collect()) == [0, 1, 9]


def test_many_tasks_meet_in_a_tree(spark):
    x, which = kinds(3)
    got = [r["id"] for r in S.varied(table(spark, x).repartition(150), 21).collect()]
    assert len(set(which[got])) == 21


def test_pivots_span():
    """Pivots of a matrix of rank 3 span its rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = S.pivoted(x, np.ones(40), 10)
    assert len(k) == 3
    q = np.linalg.qr(x[k].T)[0]
    assert np.abs(x - x @ q @ q.T).max() < 1e-9
