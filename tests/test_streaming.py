from helpers import rows
from pyspark.sql import functions as F

from embermill.streaming import tails


def write(spark, path, data):
    spark.createDataFrame(data, "job_id bigint, seq bigint, line string").coalesce(1).write.mode("append").parquet(path)


def test_tail_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    write(spark, src, [(1, i, f"l{i}") for i in range(5)])
    tails.tail(tails.lines_source(spark, src), out, mark).awaitTermination()
    write(spark, src, [(1, i, f"l{i}") for i in range(5, 8)])
    for _ in range(2):  # the second run finds nothing new
        tails.tail(tails.lines_source(spark, src), out, mark).awaitTermination()
    assert rows(spark.read.parquet(out)) == [(1, i, f"l{i}") for i in range(8)]


def test_bounded_tail_is_the_buffer(spark):
    for n in (0, 1, 10, 11, 12, 13, 14, 15, 30):
        buffer = []
        for i in range(n):
            buffer.append(i)
            if len(buffer) > 10:
                del buffer[:3]
        df = spark.createDataFrame([(1, i, "x") for i in range(n)], "job_id bigint, seq bigint, line string")
        assert [r["seq"] for r in tails.bounded_tail(df, 10, 3).orderBy("seq").collect()] == buffer
        assert tails.kept_count(n, 10, 3) == len(buffer)


def test_bounded_tail_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, i, "x") for i in range(12)] + [(2, 0, "x")])
    q = tails.bounded_tail_stream(tails.lines_source(spark, src), 10, 3).writeStream.outputMode("update").format("memory").queryName("buffers").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("buffers")) == [(1, 12, 3), (2, 1, 0)]


def test_incremental_scores(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    score = lambda df: df.select("rel", F.length("rel").alias("score"))
    run = lambda m: tails.incremental_scores(spark.readStream.schema("rel string").parquet(src), out, m, score).awaitTermination()
    spark.createDataFrame([("a",), ("bb",), ("a",)], "rel string").write.parquet(src)
    run(mark)
    spark.createDataFrame([("bb",), ("ccc",)], "rel string").write.mode("append").parquet(src)
    run(mark)
    run(mark + "2")  # even from the beginning, nothing is scored twice
    assert rows(spark.read.parquet(out)) == [("a", 1), ("bb", 2), ("ccc", 3)]


def test_windows_in_batch_and_stream(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    whole = rows(tails.windowed_counts(e).select(F.col("start").cast("string"), "event_type", "n"))
    src = str(tmp_path / "in")
    e.write.parquet(src)
    q = tails.windowed_counts(spark.readStream.schema(e.schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("windows").select(F.col("start").cast("string"), "event_type", "n")) == whole


def test_hunt_goes_on_where_it_stopped(spark, tmp_path):
    from embermill.streaming import loops

    path = str(tmp_path / "hunt")
    item = lambda rel, x: spark.createDataFrame([(rel, x)], "rel string, x double")
    generate = lambda base: lambda n: item(f"g{base + n}", float(base + n))
    frontier = lambda df: df.filter("rel like 'g%'").select("rel", (-F.col("x")).alias("place"))
    picks = []

    def explore(picked, n):
        picks.extend(r["rel"] for r in picked.collect())
        return picked.select(F.concat(F.lit("e"), "rel").alias("rel"), F.lit(0.0).alias("x"))

    assert loops.hunt(spark, path, generate(0), frontier, explore, 4, every=2, each=1) == {"rounds": 4, "explored": 2}
    assert loops.hunt(spark, path, generate(10), frontier, explore, 2, every=2, each=3) == {"rounds": 2, "explored": 3}
    assert picks[:2] == ["g2", "g4"] and picks[2:4] == ["g12", "g11"] and len(set(picks)) == 5
    assert spark.read.parquet(f"{path}/items").count() == 6 + 5
    assert loops.hunt(spark, path, generate(20), frontier, explore, 9, stop=lambda: True)["rounds"] == 0
    assert loops.hunt(spark, path, generate(20), frontier, explore, 9, seconds=-1.0)["rounds"] == 0
    jobs = spark.createDataFrame([(3,)], "id bigint")
    assert loops.lost(jobs, 4) and not loops.lost(jobs, 3) and loops.lost(jobs.limit(0), 1)
