import pytest
from helpers import rows
from pyspark.sql import functions as F

from embermill.operators import compaction as C
from embermill.operators.gallery import stored_files

ITEMS = "rel string, scanned_at timestamp_ntz, size bigint, path string, folder string, s int"


def items(spark, data):
    return spark.createDataFrame(data, "rel string, scanned_at string, size bigint, path string, folder string, s int").withColumn("scanned_at", F.col("scanned_at").cast("timestamp_ntz"))


def test_stored_files(spark):
    df = items(
        spark,
        [
            ("a/x.png", "2025-01-01", 10, "clash", "clash", 1),
            ("./a/x.png", "2025-01-02", 20, None, None, 2),
            ("./a/x.png", "2025-01-02", 20, None, None, 2),  # an exact copy
            ("a/y.png", "2025-01-01", 5, None, None, 3),
            ("a/y.png", "2025-01-03", None, None, None, 3),  # gone
            ("a/z.png", None, 7, None, None, 4),  # a scan without time is the oldest
            ("a/z.png", "2025-01-01", 8, None, None, 4),
            ("a/t.png", "2025-01-01", None, None, None, 5),  # a tie: the size wins
            ("a/t.png", "2025-01-01", 3, None, None, 5),
            (None, "2025-01-01", 1, None, None, 6),
            ("", "2025-01-01", 1, None, None, 6),
        ],
    )
    assert rows(stored_files(df)) == [("a/t.png", "a", 3), ("a/x.png", "a", 20), ("a/z.png", "a", 8)]
    assert rows(stored_files(df.limit(0))) == []


def listing(spark, groups):
    return spark.createDataFrame([(f, f"{f}/{i}", s) for f, sizes in groups.items() for i, s in enumerate(sizes)], "folder string, path string, size bigint")


def test_suffering(spark):
    f = listing(spark, {"many": [10] * 24, "few": [10] * 23, "large": [65_536] * 30, "edge": [65_535] + [65_536] * 23, "mixed": [1] * 23 + [10**9]})
    assert rows(C.suffering(f).select("folder", "n_files")) == [("edge", 24), ("many", 24)]
    assert rows(C.suffering(f.limit(0))) == []
    # null sizes are missing files
    assert rows(C.suffering(listing(spark, {"n": [10] * 23 + [None] * 5}))) == []


def test_regroup_holds_every_file_once(spark):
    f = listing(spark, {"a": list(range(100, 1100)), "b": [0] * 30, "c": [10**6] * 50})
    got = C.regroup(f, target_bytes=20_000).collect()
    assert sorted(r["path"] for r in got) == sorted(p for (p,) in f.filter("folder <> 'c'").select("path").collect())
    packs = {}
    for r in got:
        packs.setdefault((r["folder"], r["pack"]), []).append((r["pack_offset"], r["size"]))
    total = sum(range(100, 1100))
    assert len([p for p in packs if p[0] == "a"]) <= total / 20_000 * 1.5 + 8
    for members in packs.values():
        at = 0
        for offset, size in sorted(members):
            assert offset == at
            at += size
        assert at <= 22_000
    assert len([p for p in packs if p[0] == "b"]) == 1


@pytest.fixture
def fragmented(spark, tmp_path):
    path = str(tmp_path / "t")
    t = C.CompactedTable(spark, path, "folder")
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 < 8, "hot one").otherwise("cold").alias("folder"))
    t.append(df.filter("folder = 'hot one'").repartition(30))
    t.append(df.filter("folder = 'cold'").coalesce(1))
    return t, df


def files_of(t, partition):
    return sum(r["files"] for r in t.live().collect() if r["partition"] == partition)


def test_compaction_keeps_the_rows(fragmented):
    t, df = fragmented
    before = rows(t.read().select("id", "folder"))
    out = t.compact(min_files=10, target_bytes=1 << 20)
    assert (out["partitions"], out["files_before"], out["files_after"]) == (1, 30, 1)
    assert rows(t.read().select("id", "folder")) == before == rows(df)
    assert (files_of(t, "hot one"), files_of(t, "cold")) == (1, 1)
    assert t.compact(min_files=10)["partitions"] == 0
    assert t.snapshot(out["version"])["op"] == "compact"
    # a reader of an earlier snapshot keeps its rows until these are removed
    assert rows(t.read(2).select("id", "folder")) == before
    assert t.vacuum() == 1
    assert rows(t.read().select("id", "folder")) == before and t.compact(min_files=10)["partitions"] == 0
    t.append(df.limit(5))
    assert t.read().count() == 4005


def more(spark, lo, n=10, folder="hot one"):
    return spark.range(lo, lo + n).select("id", F.lit(folder).alias("folder"))


def test_an_append_beside_a_compaction_loses_nothing(spark, fragmented):
    t, df = fragmented
    want = rows(df.union(more(spark, 5000)))
    # published between the plan and the commit
    out = t.compact(min_files=10, before_commit=lambda: t.append(more(spark, 5000)))
    assert out["partitions"] == 1 and rows(t.read().select("id", "folder")) == want
    # an append whose files are there when the compaction plans and commits, published afterwards
    t.append(more(spark, 6000, 300).repartition(30))
    done = []
    t.append(more(spark, 7000), before_publish=lambda: done.append(t.compact(min_files=10)))
    want = sorted(want + [tuple(r) for r in more(spark, 6000, 300).union(more(spark, 7000)).collect()], key=repr)
    assert done[0]["partitions"] == 1 and rows(t.read().select("id", "folder")) == want
    # a writer that dies before it publishes has written nothing, and is cleared away
    with pytest.raises(ZeroDivisionError):
        t.append(more(spark, 8000), before_publish=lambda: 1 / 0)
    assert rows(t.read().select("id", "folder")) == want
    with pytest.raises(ZeroDivisionError):
        t.append(more(spark, 9000, 300).repartition(30))
        t.compact(min_files=10, before_commit=lambda: 1 / 0)
    want = sorted(want + [tuple(r) for r in more(spark, 9000, 300).collect()], key=repr)
    assert rows(t.read().select("id", "folder")) == want
    t.vacuum(grace=0)
    assert rows(t.read().select("id", "folder")) == want
    assert t.compact(min_files=10)["partitions"] == 1 and rows(t.read().select("id", "folder")) == want


def test_two_compactions_of_one_partition_conflict(spark, fragmented):
    t, df = fragmented
    with pytest.raises(C.ConflictError):
        t.compact(min_files=10, before_commit=lambda: C.CompactedTable(spark, t.path, "folder").compact(min_files=10))
    assert rows(t.read().select("id", "folder")) == rows(df) and files_of(t, "hot one") == 1


def test_a_version_is_published_once(fragmented):
    t, _ = fragmented
    assert not t._publish(2, {"op": "append"})
    assert t.snapshot(2)["op"] == "append" and t.versions() == [1, 2]


def test_what_isn_t_taken(spark, fragmented):
    t, df = fragmented
    for bad in (df.withColumn("_gen", F.lit("x")), df.withColumn("folder", F.lit(1)), df.withColumn("id", F.lit("x")), df.withColumn("extra", F.lit(1))):
        with pytest.raises(ValueError):
            t.append(bad)
    assert t.append(df.limit(0)) == 3 and rows(t.read().select("id", "folder")) == rows(df)


def test_compaction_in_batches(spark, tmp_path):
    t = C.CompactedTable(spark, str(tmp_path / "t"), "folder")
    df = spark.range(600).select("id", F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("folder"))
    t.append(df.repartition(20, "id"))
    out = t.compact(min_files=10, batch=2)
    assert (out["partitions"], out["files_after"]) == (5, 5) and out["files_before"] > 80 and len(t.versions()) == 4
    assert rows(t.read().select("id", "folder")) == rows(df)


def test_compaction_of_odd_names(spark, tmp_path):
    t = C.CompactedTable(spark, str(tmp_path / "t"), "folder")
    names = ["a+b/c d", "50%", "%2B", None, "ü=1"]
    df = spark.range(500).withColumn("folder", F.get(F.array(*[F.lit(n) for n in names]), (F.col("id") % 5).cast("int")))
    t.append(df.repartition(12))
    t.append(df.filter("id < 0"))
    out = t.compact(min_files=10)
    assert (out["partitions"], out["files_after"]) == (5, 5)
    assert rows(t.read().select("id", "folder")) == rows(df)
    t.append(df.limit(7))
    assert t.vacuum() == 2 and t.read().count() == 507  # the replaced generation and the empty one
