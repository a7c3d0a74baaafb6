import pytest
from helpers import rows
from pyspark.sql import functions as F

from embermill.functions.paths import folder_of, plain_path

CASES = [
    ("a/b.png", "a/b.png"),
    (None, None),
    ("", None),
    (" \t ", None),
    ("  ./a//b/../c.png\t", "a/c.png"),
    ("/img?path=a%2Fb.png", "a/b.png"),
    ("/img?w=3&path=a/b.png&x=1", "a/b.png"),
    ("http://h:80/outputs/a/b.png", "a/b.png"),
    ("http://h/img?path=outputs%2Fa%2Fb.png", "a/b.png"),
    ("outputs/outputs/a", "outputs/a"),
    ("..\\..\\x\\y.png", "x/y.png"),
    ("a%ZZ.png", "a%ZZ.png"),
    ("a+b%20c.png", "a+b c.png"),
    ("/../a/.", "a"),
    ("outputs", None),
    ("Outputs/x", "Outputs/x"),
    ("%20a/b%20", "a/b"),
    ("a/b/../../../c/d", "c/d"),
    ("a/..b/c..", "a/..b/c.."),
    ("100%", "100%"),
    ("a/" * 3000 + "b", "a/" * 3000 + "b"),
]


def test_plain_path(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, rel string")
    got = {r["i"]: r["p"] for r in df.select("i", plain_path(F.col("rel")).alias("p")).collect()}
    assert [got[i] for i in range(len(CASES))] == [b for _, b in CASES]


@pytest.mark.parametrize(("path", "folder"), [("a/b/c.png", "a/b"), ("c.png", ""), ("a/c", "a")])
def test_folder(spark, path, folder):
    assert rows(spark.range(1).select(folder_of(F.lit(path)))) == [(folder,)]
