import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embermill.llm import reading as R

EASY, HARD = ["the cat saw a {0}", "we have the {0} and a {1}", "look at the {0} it is big"], ["insofar as the {0} of that {1} may be said to obtain", "granted that neither the {0} nor its {1} could have been reduced", "to the extent that the {0} presupposes a {1} it follows"]
SIMPLE, LEARNED = ["dog", "sun", "ball", "tree", "fish", "cup"], ["covariance", "ontology", "isotropy", "criterion", "functional", "measure"]


def text(hard: bool, n: int, rng: random.Random, words=None) -> str:
    forms, nouns = (HARD, LEARNED) if hard else (EASY, SIMPLE)
    return ". ".join(rng.choice(forms).format(*rng.sample(words or nouns, 2)) for _ in range(n)) + "."


def tables(spark, n=80, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        hard = i % 2 == 1
        docs.append((i, text(hard, 12, rng), "en", 1, "x", 0.5))
        level = rng.choice([4, 5]) if hard else rng.choice([1, 2, 3])
        if i % 17 == 3:
            level = 6 - level  # a rater errs
        labels += [(i, "r1", level, None), (i, "r1", level, None), (i, "r2", None, None)]
    docs += [(1000, text(True, 12, rng, SIMPLE), "fr", 1, "x", 0.5), (1001, text(False, 12, rng), None, 1, "x", 0.5), (1002, text(True, 1, rng), "en", 1, "x", 0.5), (1003, None, "en", 1, "x", 0.5), (1004, "", "en", 1, "x", 0.5), (1005, "x" * 50_000, None, 1, "x", 0.5), (1006, "tin roof, folded map\n" * 40, "en", 1, "x", 0.5), (1007, "Der Nebel war nicht auf dem Bild und wir sind mit der Farbe. " * 20, "en", 1, "x", 0.5), (None, text(True, 12, rng), "en", 1, "x", 0.5)]
    labels += [(5000, "r1", 5, None), (None, "r1", 5, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_words int, level string, above double")
    return d, spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int, text string")


def test_demanding_documents(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"] for r in R.demanding(docs, labels).collect()}
    # hard texts, whatever their language mark and their vocabulary; no short, foreign, listed or empty ones
    assert got == {i for i in range(80) if i % 2} | {1000, None}


def test_levels(spark):
    docs, labels = tables(spark)
    model = R.train(docs, labels)
    got = {r["doc_id"]: r for r in R.grade(docs, model).collect()}
    assert len(got) == docs.count()
    for i in (1003, 1004, 1005, 1006, 1007):
        assert not got[i]["english"] and got[i]["level"] is None and got[i]["n_words"] == 0
    assert got[1]["level"] > 3.5 > 3 > got[0]["level"] and len(got[1]["above"]) == 4
    assert got[1]["bits_q1"] <= got[1]["bits_median"] <= got[1]["bits_q3"]


def test_columns_are_kept(spark):
    docs, labels = tables(spark)
    m = R.train(docs, labels, (3,))
    got = R.grade(docs, m, keep=("lang",))
    assert {(r["doc_id"], r["lang"]) for r in got.collect()} == {(r["doc_id"], r["lang"]) for r in docs.select("doc_id", "lang").collect()}
    with pytest.raises(ValueError):
        R.grade(docs, m, keep=("level",))


@pytest.mark.parametrize(
    ("sentence", "english"),
    [
        ("O gato que estava na casa não queria sair, mas a menina o levou para o jardim e depois do almoço eles foram ao mar com os amigos, e no fim do dia voltaram a casa.", False),
        ("Il gatto che era nella casa non voleva uscire, ma la ragazza lo portò in giardino e dopo pranzo andarono al mare con gli amici, e alla fine della giornata tornarono a casa.", False),
        ("De kat die in het huis was wilde niet naar buiten, maar het meisje nam hem mee naar de tuin en na het eten gingen ze met hun vrienden naar de zee.", False),
        ("Der Nebel war nicht auf dem Bild und wir sind mit der Farbe in den Garten gegangen, weil das Licht dort so warm war.", False),
        ("The cat that was in the house did not want to go out, but the girl took him to the garden and after lunch they went to the sea with their friends.", True),
        ("Notwithstanding their considerable achievements, economists still disagree about whether monetary policy should respond to asset prices.", True),
    ],
)
def test_languages(spark, data, languages, sentence, english):
    words = [w for line in R._lines(sentence) for w in line]
    assert languages.english([words, [], words]).tolist()[0] == english == languages.english([[], words])[1]


@pytest.fixture(scope="module")
def languages(spark, data):
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    return R.train(docs, spark.read.parquet(f"{data}/../sf0.01/level_labels.parquet")).languages


def test_wrong_marks_are_corrected():
    rng = random.Random(4)
    english = [R.prose_words(text(i % 2 == 1, 8, rng))[0] for i in range(60)]
    german = [w for w in ["der nebel war nicht auf dem bild und wir sind mit der farbe im garten".split(), "das licht ist warm und die wolke steht noch nicht so hoch wie gestern".split()] for _ in range(15)]
    marks = ["de" if i % 12 == 0 else "en" for i in range(60)] + ["en" if i % 10 == 0 else "de" for i in range(30)]
    model = R.fit_languages(english + german, marks)
    assert model.english(english + german).tolist() == [True] * 60 + [False] * 30
    assert R.fit_languages(german, ["de"] * 30) is None


def test_parts_hold_the_whole_distribution():
    rng = np.random.default_rng(1)
    n = np.array([0, 1, 3, 8, 50, 0, 17])
    gap = rng.normal(0, 2, n.sum())
    parts = R._parts(gap, n)
    assert parts.shape == (7, R.PARTS) and (np.diff(parts, axis=1) >= -1e-9).all()
    for k, x in enumerate(np.split(gap, np.cumsum(n)[:-1])):
        assert abs(parts[k].mean() - (x.mean() if len(x) else 0)) < 1e-6
    w = R._weighted(rng.normal(0, 1, (200, R.PARTS)) + np.arange(200)[:, None] / 50, (np.arange(200) > 100).astype(float))
    assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9


def test_too_few_judgements(spark):
    docs, labels = tables(spark)
    for few in (labels.limit(0), labels.filter("doc_id in (0, 1)"), labels.filter("doc_id % 2 = 1")):
        assert R.grade(docs, R.train(docs, few)).count() == docs.count()
    assert R.demanding(docs, labels.limit(0)).collect() == []
    assert R.demanding(docs.limit(0), labels).collect() == []
    assert {r["doc_id"] for r in R.demanding(docs, labels.filter("doc_id < 8")).collect()} >= {1, 3}


def test_held_out_accuracy():
    rng = random.Random(9)
    texts = [R.prose_words(text(i % 2 == 1, 10, rng))[0] for i in range(200)]
    level = np.array([4.0 if i % 2 else 2.0 for i in range(200)])
    m = R.fit(texts[:100], level[:100], (3,))
    p = m.above(m.gaps(texts[100:])[0], 3)
    assert ((p >= 0.5) == (level[100:] > 3)).mean() == 1.0


@pytest.mark.parametrize(
    ("raw", "words"),
    [
        ("The cat saw it.", ["the", "cat", "saw", "it"]),
        ("The Zaͤlgo cat", ["the", "zalgo", "cat"]),
        ("guidance: 8.3\nsha f3e1b41636db\n[0.5, 1]\noutputs/a/b.npz\n--seed 7", []),
        ("moss, wide lens, soft fog\nIt is the cat", ["it", "is", "the", "cat"]),
        ("See anarchy_12.png in the <b>box</b>", ["see", "in", "the", "box"]),
        ("", []),
    ],
)
def test_prose(raw, words):
    assert R.prose_words(raw)[0] == words


@given(st.lists(st.tuples(st.floats(-5, 5), st.sampled_from([0.0, 1.0])), min_size=1, max_size=40))
def test_isotonic(points):
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    knots, values = R.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert ((values >= 0) & (values <= 1)).all()
    assert abs(np.interp(x.mean(), knots, values) - 0.5) <= 0.5


def test_probabilities_add_up():
    rng = random.Random(3)
    texts = [R.prose_words(text(i % 2 == 1, 6, rng))[0] for i in range(30)]
    g = R.fit_grams(texts, np.arange(30) % 2, 2)
    v = len(g.words)
    assert np.allclose((2.0 ** g.unigram).sum(1), 1, atol=1e-3)
    for first in list(g.words.values())[:10]:
        p = 2.0 ** (g.weight[:, [first]] + g.unigram)
        for k, b in zip(g.keys, g.bigram.T):
            if k // v == first:
                p[:, k % v] = 2.0**b
        assert np.allclose(p.sum(1), 1, atol=1e-3)


def test_all_judged_texts_train(spark):
    """A word that two texts share counts wherever these are among more texts than fit a sample."""
    rng, name = random.Random(5), lambda k: "zq" + "".join(chr(97 + k // 26**j % 26) for j in range(3))
    docs = [(i, f"{text(i // 2 % 2 == 1, 2, rng)} it is the {name(i // 2)}", None) for i in range(3_400)]
    labels = [(i, "r1", 5 if i // 2 % 2 else 1) for i in range(3_400)]
    model = R.train(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int"), (3,))
    assert {name(k) for k in range(1_700)} <= model.grams[0].words.keys()


def test_all_marked_texts_train(spark):
    rng, marks = random.Random(6), ["en", *(a + b for a in "kv" for b in "abcdefg")]
    words = {m: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(5)] for m in marks}
    rows = [(m, " ".join(rng.choices(words[m], k=9))) for m in marks for _ in range(340 if m == "en" else 12)]
    rows[0] = ("ka", rows[0][1])  # a wrong mark
    docs = spark.createDataFrame([(i, t, m.upper()) for i, (m, t) in enumerate(rows)], "doc_id bigint, text string, lang string").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(R.FOLDS)))
    got = R.train(docs, spark.createDataFrame([], "doc_id bigint, rater string, reading_level int")).languages
    assert got.names == sorted(marks)
    want = R.fit_languages([t.split() for _, t in rows], [m for m, _ in rows], fold=np.array([r["fold"] for r in docs.orderBy("doc_id").collect()]))
    assert got.names == want.names
    assert np.array_equal(got.table, want.table)


def test_training_in_tasks_is_that_in_one_place(spark):
    docs, labels = tables(spark, 240)
    cuts = (3, 2)
    got = R.train(docs, labels, cuts)
    level = labels.filter("reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("mean"))
    rows = docs.join(level, "doc_id").select("text", "mean", F.pmod(F.xxhash64("text"), F.lit(R.FOLDS)).alias("fold")).orderBy(F.xxhash64("doc_id", "text")).collect()
    texts = [R.prose_words(r["text"])[0] for r in rows]
    want = R.fit(texts, np.array([r["mean"] for r in rows]), cuts, fold=np.array([r["fold"] for r in rows]))
    for i in range(len(cuts)):
        assert got.grams[i].words.keys() == want.grams[i].words.keys() and len(got.grams[i].keys) == len(want.grams[i].keys)
        assert np.allclose(got.weights[i], want.weights[i])
        assert np.allclose(got.curves[i][0], want.curves[i][0]) and np.allclose(got.curves[i][1], want.curves[i][1])
    assert np.allclose(got.gaps(texts), want.gaps(texts), atol=1e-5)


def test_words_are_those_of_the_plain_patterns():
    """Words kept from before, and markup tried where it may begin, give what the patterns give on the whole text."""
    import re

    plain = re.compile(r"<[^<>]{1,200}>|https?://\S+|\S*[/\\]\S*\.\w+\S*|`[^`]*`|&[a-z]+;|\w*_\w+(?:\.\w+)?")
    rng = random.Random(7)
    for _ in range(20_000):
        t = "".join(rng.choices(["a", "b", "_", ".", "/", "\\", "<", ">", "`", "&", ";", " ", "\n", "http://", "1", "\xe9", "-", "'", "&amp;", "\x1c", "\u00a0", "X"], k=rng.randint(1, 16)))
        low = (R._MARKS.sub("", R.unicodedata.normalize("NFKD", t)) if not t.isascii() else t).lower()
        assert list(R._lines(t)) == [R._TOKEN.findall(line) for line in plain.sub(" ", low).split("\n")], t
