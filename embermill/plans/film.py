"""Queries of films, grids and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from embermill.operators import film as M
from embermill.plans.common import backend_sql, rnd, values, values_sql, vectors
from embermill.plans.registry import registry
from embermill.plans.statistics import _slerp_sql
from embermill.sources.tables import table

add = registry.add

_EASE = {"linear": "u", "smooth": "u * u * (3.0 - 2.0 * u)", "smoother": "u * u * u * (u * (u * 6.0 - 15.0) + 10.0)"}


@add(
    "ease_curves",
    "WITH u AS (SELECT event_id, value / 100.0 AS t, greatest(0.0::double, least(1.0::double, value / 100.0)) AS u FROM events) "
    + " UNION ALL ".join(f"SELECT event_id, '{k}' AS easing, round({e}, 6) + 0.0 AS y FROM u" for k, e in _EASE.items()),
)
def ease_curves(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("value") / 100.0).alias("t"))
    curves = F.array(*[F.struct(F.lit(k).alias("easing"), rnd(M.ease(F.col("t"), k), 6).alias("y")) for k in M.EASINGS])
    return e.select("event_id", F.inline(curves))


_PLAN = """p AS (SELECT f AS frame, CASE WHEN f = 48 THEN 3 ELSE f // 12 END AS segment, CASE WHEN f = 48 THEN 1.0::double ELSE (f % 12) / 12.0::double END AS u FROM range(49) AS g(f)),
plan AS (SELECT frame, segment::int AS segment, u * u * (3.0 - 2.0 * u) AS t FROM p)"""


@add("frame_plan", f"WITH {_PLAN} SELECT frame, segment, round(t, 6) + 0.0 AS t FROM plan")
def frame_plan(spark: SparkSession, d: str) -> DataFrame:
    return M.frame_plan(spark, 5, 12, "smooth").select("frame", "segment", rnd("t", 6).alias("t"))


_COUNTS = [(3, 4, False), (3, 6, True), (3, 6, False), (2, 1, False), (64, 46, True), (1, 10, False), (3, 0, False)]


@add("frame_count", f"SELECT keys, per, loop, CASE WHEN keys >= 2 AND per >= 1 THEN (CASE WHEN loop THEN keys ELSE keys - 1 END) * per + 1 END AS frames FROM {values_sql(_COUNTS, 'keys, per, loop')}")
def frame_count(spark: SparkSession, d: str) -> DataFrame:
    k = values(spark, _COUNTS, "keys int, per int, loop boolean")
    n = (F.col("keys") - F.when(F.col("loop"), 0).otherwise(1)) * F.col("per") + 1
    return k.withColumn("frames", F.when((F.col("keys") >= 2) & (F.col("per") >= 1), n))


@add("noise_window", "WITH u AS (SELECT event_id, greatest(0.0::double, least(1.0::double, (value / 100.0 - 0.3) / 0.4)) AS u FROM events) SELECT event_id, round(u * u * (3.0 - 2.0 * u), 6) + 0.0 AS y FROM u")
def noise_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", rnd(M.noise_window(F.col("value") / 100.0, 0.4), 6).alias("y"))


def keyframes(spark: SparkSession, d: str, first: int) -> DataFrame:
    """Five neighbouring vectors as keyframes."""
    return vectors(spark, d).filter(F.col("id").between(first, first + 4)).select(F.col("id").alias("ord"), "e")


def _keys_sql(name: str, first: int) -> str:
    return f"""{name} AS (SELECT (vec_id - {first})::int AS segment, embedding::double[] AS a, lead(embedding::double[]) OVER (ORDER BY vec_id) AS b FROM embeddings WHERE vec_id BETWEEN {first} AND {first + 4})"""


_POS = "unnest(range(64))::int AS pos"


@add(
    "trajectory",
    f"WITH {_PLAN}, {_keys_sql('k', 10)}, s AS (SELECT frame, {_POS}, unnest({_slerp_sql('a', 'b', 't')}) AS v FROM plan JOIN k USING (segment)) SELECT frame, pos, round(v, 5) + 0.0 AS v FROM s",
)
def trajectory(spark: SparkSession, d: str) -> DataFrame:
    return M.trajectory(keyframes(spark, d, 10), M.frame_plan(spark, 5, 12, "smooth")).select("frame", "pos", rnd("v", 5).alias("v"))


@add(
    "film_frames",
    f"""WITH {_PLAN}, {_keys_sql('k', 10)}, {_keys_sql('m', 30)}, w AS (SELECT *, greatest(0.0::double, least(1.0::double, (t - 0.25) / 0.5)) AS x FROM plan),
    n AS (SELECT frame, segment, x * x * (3.0 - 2.0 * x) AS t FROM w),
    s AS (SELECT frame, 'cond' AS part, {_POS}, unnest(a) * (1.0 - t) + t * unnest(b) AS v FROM plan JOIN k USING (segment)
      UNION ALL SELECT frame, 'noise', {_POS}, unnest({_slerp_sql('a', 'b', 't')}) FROM n JOIN m USING (segment)) SELECT frame, part, pos, round(v, 5) + 0.0 AS v FROM s""",
)
def film_frames(spark: SparkSession, d: str) -> DataFrame:
    f = M.film_frames(keyframes(spark, d, 10), keyframes(spark, d, 30), M.frame_plan(spark, 5, 12, "smooth"), "lerp", 0.5)
    return f.select("frame", "part", "pos", rnd("v", 5).alias("v"))


@add("resume_frames", f"WITH {_PLAN} SELECT frame, segment, round(t, 6) + 0.0 AS t FROM plan WHERE frame NOT IN (SELECT event_id FROM events WHERE event_type = 'view' AND event_id IS NOT NULL)")
def resume_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames that aren't there yet; here those whose number is no view event's."""
    there = table(spark, d, "events").filter("event_type = 'view'").select(F.col("event_id").alias("frame"))
    return M.frame_plan(spark, 5, 12, "smooth").join(there, "frame", "left_anti").select("frame", "segment", rnd("t", 6).alias("t"))


_SIZES = [(513, 777, 1.0), (1024, 512, 4.0), (640, 480, 1.5), (8, 8, 1.0), (2048, 2048, 1.0), (100, 3000, 0.5), (24, 40, 1.0), (1000, 999, 2.0)]


@add(
    "target_size",
    f"""WITH s AS (SELECT *, least(1.0::double, 2048.0::double / greatest(w * f, h * f)) AS k FROM {values_sql(_SIZES, 'w, h, f')})
    SELECT w, h, f, greatest(16, round_even(w * f * k / 16, 0)::int * 16) AS tw, greatest(16, round_even(h * f * k / 16, 0)::int * 16) AS th FROM s""",
)
def target_size(spark: SparkSession, d: str) -> DataFrame:
    tw, th = M.target_size(F.col("w"), F.col("h"), F.col("f"))
    return values(spark, _SIZES, "w int, h int, f double").withColumns({"tw": tw, "th": th})


_STEPS = [(30, 0.3), (20, 1.5), (28, 0.0), (1, 0.5), (50, 0.75), (8, -1.0)]


@add("denoise_plan", f"SELECT steps, denoise, greatest(0.05::double, least(1.0::double, denoise)) AS clamped, greatest(1, trunc(steps * greatest(0.05::double, least(1.0::double, denoise)))::int) AS run FROM {values_sql(_STEPS, 'steps, denoise')}")
def denoise_plan(spark: SparkSession, d: str) -> DataFrame:
    c = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("denoise")))
    return values(spark, _STEPS, "steps int, denoise double").select("steps", "denoise", c.alias("clamped"), F.greatest(F.lit(1), (F.col("steps") * c).cast("int")).alias("run"))


_LENGTHS = [(512,), (1024,), (1000,), (1536,), (700,), (2048,), (3000,)]


@add(
    "tile_grid",
    f"""WITH l AS (SELECT n, greatest(0, n - 768) AS last FROM {values_sql(_LENGTHS, 'n')})
    SELECT DISTINCT n, least(s, last)::int AS start FROM l, range(0, 3000, 640) AS g(s) WHERE s <= last + 639""",
)
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, _LENGTHS, "n int").select("n", F.explode(M.tile_starts(F.col("n"), 768, 128)).alias("start"))


_RATIOS = [(1048576, 1.0), (1048576, 1.7777), (589824, 0.5625), (262144, 3.0), (4194304, 0.75)]


@add(
    "aspect_dims",
    f"""SELECT area, ratio, greatest(64, floor(sqrt(area * ratio) / 64 + 0.5)::int * 64) AS w, greatest(64, floor(sqrt(area / ratio) / 64 + 0.5)::int * 64) AS h FROM {values_sql(_RATIOS, 'area, ratio')}""",
)
def aspect_dims(spark: SparkSession, d: str) -> DataFrame:
    w, h = M.aspect_dims(F.col("area"), F.col("ratio"))
    return values(spark, _RATIOS, "area int, ratio double").withColumns({"w": w, "h": h})


@add(
    "feather_blend",
    """WITH t AS (SELECT event_id % 100 AS y, user_id % 10 AS x, value AS v, sqrt(1 + event_id % 7) AS weight FROM events)
    SELECT y, x, round(greatest(0.0::double, least(255.0::double, sum(v * weight) / greatest(sum(weight), 1e-6))), 4) + 0.0 AS v FROM t GROUP BY y, x""",
)
def feather_blend(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping tiles; here events laid on a grid."""
    t = table(spark, d, "events").select((F.col("event_id") % 100).alias("y"), (F.col("user_id") % 10).alias("x"), F.col("value").alias("v"), F.sqrt(1 + F.col("event_id") % 7).alias("weight"))
    return M.feather_blend(t).select("y", "x", rnd("v", 4).alias("v"))


@add("grid_layout", "SELECT vec_id AS id, (vec_id % 8 * 64)::bigint AS x, (vec_id // 8 * 64)::bigint AS y FROM embeddings")
def grid_layout(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 8 * 64).alias("x"), F.floor(F.col("vec_id") / 8).cast("bigint").alias("y8")).select("id", "x", (F.col("y8") * 64).alias("y"))


@add(
    "offsize_keys",
    """WITH k AS (SELECT o_custkey AS film, o_orderkey AS key, 512 + 8 * (o_orderkey % 3) AS width, first_value(512 + 8 * (o_orderkey % 3)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS w0 FROM orders)
    SELECT film, key, width, w0 FROM k WHERE width <> w0""",
)
def offsize_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes of another size than the film's first one; orders of a customer stand in for the keyframes of a film."""
    k = table(spark, d, "orders").select(F.col("o_custkey").alias("film"), F.col("o_orderkey").alias("key"), (512 + 8 * (F.col("o_orderkey") % 3)).alias("width"), "o_orderdate")
    w = W.partitionBy("film").orderBy("o_orderdate", "key")
    return k.withColumn("w0", F.first("width").over(w)).filter("width <> w0").select("film", "key", "width", "w0")


@add("mixed_backend", f"SELECT bucket, count(DISTINCT b) AS backends, count(DISTINCT b) > 1 AS mixed FROM (SELECT bucket, {backend_sql('name', ('flux2', 'krea2', 'sdxl', 'sd2'), chr(39) + 'sd15' + chr(39))} AS b FROM items WHERE name IS NOT NULL) GROUP BY bucket")
def mixed_backend(spark: SparkSession, d: str) -> DataFrame:
    from embermill.operators.records import backend_of

    n = table(spark, d, "items").filter("name is not null").groupBy("bucket").agg(F.count_distinct(backend_of(F.col("name"))).alias("backends"))
    return n.withColumn("mixed", F.col("backends") > 1)


@add("seed_schedule", "SELECT id AS job_id, (1000 + 8 * (row_number() OVER (PARTITION BY action ORDER BY id) - 1))::bigint AS seed FROM jobs")
def seed_schedule(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("action").orderBy("id")
    return table(spark, d, "jobs").select(F.col("id").alias("job_id"), (1000 + 8 * (F.row_number().over(w) - 1)).cast("bigint").alias("seed"))


@add("round_robin", "SELECT id AS job_id, (['sd15', 'sd2', 'sdxl'])[(rn % 3 + 1)::int] AS backend, rn % 4 = 0 AS analyse FROM (SELECT id, row_number() OVER (PARTITION BY action ORDER BY id) AS rn FROM jobs)")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("action").orderBy("id"))
    j = table(spark, d, "jobs").select(F.col("id").alias("job_id"), rn.alias("rn"))
    names = F.array(*[F.lit(b) for b in ("sd15", "sd2", "sdxl")])
    return j.select("job_id", F.get(names, F.col("rn") % 3).alias("backend"), (F.col("rn") % 4 == 0).alias("analyse"))


_TEMPS, _SAMPLERS, _GUIDANCES = [(0.8,), (1.0,), (1.6,)], [("diagonal", 0), ("pca", 1), ("hybrid", 2)], [(3.5,), (7.0,)]


@add(
    "combo_grid",
    f"""SELECT corpus, temp, sampler, guidance FROM corpora, {values_sql(_TEMPS, 'temp')}, {values_sql(_SAMPLERS, 'sampler, needs').replace(' AS t(', ' AS s(')}, {values_sql(_GUIDANCES, 'guidance').replace(' AS t(', ' AS g(')}
    WHERE sampler <> 'hybrid' OR branch = 'base'""",
)
def combo_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid of a session, without the combinations a corpus doesn't support."""
    g = table(spark, d, "corpora")
    for rows, schema in ((_TEMPS, "temp double"), (_SAMPLERS, "sampler string, needs int"), (_GUIDANCES, "guidance double")):
        g = g.crossJoin(F.broadcast(values(spark, rows, schema)))
    return g.filter((F.col("sampler") != "hybrid") | (F.col("branch") == "base")).select("corpus", "temp", "sampler", "guidance")


@add("sweep_grid", f"SELECT temp, seed, (row_number() OVER (ORDER BY temp, seed) - 1)::int AS cell FROM {values_sql(_TEMPS, 'temp')}, range(1, 5) AS s(seed)")
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    g = values(spark, _TEMPS, "temp double").crossJoin(spark.range(1, 5).withColumnRenamed("id", "seed"))
    return g.withColumn("cell", (F.row_number().over(W.orderBy("temp", "seed")) - 1).cast("int"))


_FILMS = [("a.mp4", 49, 24.0, "slerp", "smooth", True, None), ("b.mp4", None, 12.0, "lerp", None, False, 2.0), ("c.mp4", 13, None, None, None, False, None)]


@add(
    "film_summary",
    f"""SELECT name, concat_ws(' · ', coalesce(frames::varchar, '?') || ' frames', coalesce(fps::int::varchar, '?') || ' fps', CASE WHEN frames IS NOT NULL AND fps > 0 THEN round(frames / fps, 1)::varchar || 's' END,
    CASE WHEN interp IS NOT NULL THEN interp || '/' || coalesce(easing, '?') END, CASE WHEN loop THEN 'loop' END, CASE WHEN refined IS NOT NULL THEN 'refined' END) AS summary FROM {values_sql(_FILMS, 'name, frames, fps, interp, easing, loop, refined')}""",
)
def film_summary(spark: SparkSession, d: str) -> DataFrame:
    f = values(spark, _FILMS, "name string, frames int, fps double, interp string, easing string, loop boolean, refined double")
    known = lambda c, unit: F.concat(F.coalesce(F.col(c).cast("int").cast("string"), F.lit("?")), F.lit(unit))
    took = F.when(F.col("frames").isNotNull() & (F.col("fps") > 0), F.concat(F.round(F.col("frames") / F.col("fps"), 1).cast("string"), F.lit("s")))
    style = F.when(F.col("interp").isNotNull(), F.concat_ws("/", "interp", F.coalesce("easing", F.lit("?"))))
    return f.select("name", F.concat_ws(" · ", known("frames", " frames"), known("fps", " fps"), took, style, F.when(F.col("loop"), "loop"), F.when(F.col("refined").isNotNull(), "refined")).alias("summary"))


@add("eta", "SELECT id AS job_id, round(60.0 * 8 / greatest(epoch(ended - started), 1e-3), 2) + 0.0 AS per_minute, round(epoch(ended - started) / 8 * 4, 2) + 0.0 AS left_s FROM jobs WHERE started IS NOT NULL AND ended IS NOT NULL")
def eta(spark: SparkSession, d: str) -> DataFrame:
    """Rate and rest of a run of which 8 images are done and 4 are left."""
    j = table(spark, d, "jobs").filter("started is not null and ended is not null")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s = (micros("ended") - micros("started")) / 1e6
    return j.select(F.col("id").alias("job_id"), rnd(60.0 * 8 / F.greatest(s, F.lit(1e-3)), 2).alias("per_minute"), rnd(s / 8 * 4, 2).alias("left_s"))
