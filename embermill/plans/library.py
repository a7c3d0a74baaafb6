"""Queries of the image library: joins, ranking, frontier, bands, retention, incremental work, lineage, taste."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from embermill.functions import rng
from embermill.operators import library as L
from embermill.operators import lineage as A
from embermill.operators import prompts as P
from embermill.operators import records as R
from embermill.operators import taste as S
from embermill.plans.common import GAL, LONG, backend_sql, gallery, rnd, side_sql, sidecar, values, vectors
from embermill.plans.registry import registry
from embermill.sources.tables import prompt_lines, table
from embermill.streaming import tails

add = registry.add
_BUCKET = "CASE " + " ".join(f"WHEN starts_with(name, '{prefix}') THEN '{bucket}'" for prefix, bucket in (("anarchy_", "generated"), ("temperature_sweep", "temperature"), ("sampler_sweep", "sampler"), ("mined_marginals", "marginals"))) + " END"


@add("gallery_buckets", f"WITH {GAL} SELECT {_BUCKET} AS bucket, count(*) AS n, sum(size)::bigint AS bytes FROM gal GROUP BY 1 HAVING {_BUCKET} IS NOT NULL")
def gallery_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d).withColumn("bucket", L.bucket_of(F.col("name"))).filter("bucket is not null")
    return g.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_NAMES = ["anarchy_1.png", "temperature_sweep.png", "temperature_sweep_2.png", "sampler_sweep3.png", "mined_marginals.png", "my_anarchy_1.png", "Anarchy_1.png", "photo.png", ""]


@add("bucket_rules", f"SELECT name, {_BUCKET} AS bucket FROM (SELECT unnest({_NAMES}) AS name)")
def bucket_rules(spark: SparkSession, d: str) -> DataFrame:
    """Names that are no bucket's, or only just."""
    return values(spark, [(n,) for n in _NAMES], "name string").withColumn("bucket", L.bucket_of(F.col("name")))


@add("sidecar_metric", f"WITH {GAL} SELECT rel, CASE WHEN json_valid(meta_raw) THEN round((meta_raw->>'$.distance')::double, 3) + 0.0 END AS distance, CASE WHEN json_valid(meta_raw) THEN meta_raw->>'$.sampler' END AS sampler FROM gal")
def sidecar_metric(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the JSON sidecars, typed; a sidecar that is cut off has none."""
    meta = F.from_json("meta_raw", "distance double, sampler string, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    g = gallery(spark, d).select("rel", meta.alias("m"))
    ok = F.col("m._broken").isNull()
    return g.select("rel", rnd(F.when(ok, F.col("m.distance")), 3).alias("distance"), F.when(ok, F.col("m.sampler")).alias("sampler"))


@add("folder_counts", f"WITH {GAL} SELECT folder, count(*) AS n FROM gal GROUP BY folder")
def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return gallery(spark, d).groupBy("folder").agg(F.count("*").alias("n"))


@add("gallery_join", f"WITH {GAL}, a AS (SELECT rel, score AS value FROM gal WHERE score IS NOT NULL), b AS (SELECT rel, nov AS value FROM gal WHERE nov IS NOT NULL) SELECT g.rel, g.size, a.value AS score, b.value AS novelty FROM gal g LEFT JOIN a USING (rel) LEFT JOIN b USING (rel)")
def gallery_join(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    cache = lambda c: g.filter(F.col(c).isNotNull()).select("rel", F.col(c).alias("value"))
    return L.gallery(g.select("rel", "size"), score=cache("score"), novelty=cache("nov"))


FAVS = "favs AS (SELECT rel FROM gal WHERE fav)"


@add("favorites_bucket", f"WITH {GAL}, {FAVS} SELECT rel, mtime FROM gal JOIN favs USING (rel)")
def favorites_bucket(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    return g.select("rel", "mtime").join(g.filter("fav").select("rel"), "rel")


@add("elite_scan", f"WITH {GAL}, {FAVS} SELECT rel FROM gal SEMI JOIN favs USING (rel) WHERE {backend_sql('name', ('flux2', 'krea2', 'sdxl', 'sd2'), chr(39) + 'sd15' + chr(39))} = 'sdxl' AND rel IN (SELECT rel FROM vectors WHERE rel IS NOT NULL)")
def elite_scan(spark: SparkSession, d: str) -> DataFrame:
    """Favourites of a backend that have a vector."""
    g, v = gallery(spark, d), table(spark, d, "vectors")
    return g.filter(F.col("fav") & (R.backend_of(F.col("name")) == "sdxl")).select("rel").join(v.filter("rel is not null").select("rel"), "rel", "left_semi")


@add("incremental_todo", f"WITH {GAL} SELECT rel FROM gal ANTI JOIN (SELECT DISTINCT rel FROM vectors WHERE rel IS NOT NULL) USING (rel)")
def incremental_todo(spark: SparkSession, d: str) -> DataFrame:
    return gallery(spark, d).select("rel").join(table(spark, d, "vectors").filter("rel is not null").select("rel"), "rel", "left_anti")


@add("incremental_merge", f"WITH {GAL} SELECT rel, 0 AS new FROM vectors WHERE rel IS NOT NULL UNION ALL SELECT rel, 1 FROM gal ANTI JOIN (SELECT DISTINCT rel FROM vectors WHERE rel IS NOT NULL) USING (rel)")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "vectors").filter("rel is not null").select("rel").withColumn("new", F.lit(0))
    return L.incremental(gallery(spark, d).select("rel"), there, "rel", lambda todo: todo.withColumn("new", F.lit(1)))


_SCORE = f"10 * {rng.uniform_sql(rng.key_sql(5, 'score', 'rel'))}"


@add("incremental_scores", f"WITH {GAL} SELECT rel, round(coalesce(score, {_SCORE}), 4) + 0.0 AS score FROM gal")
def incremental_scores(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    draw = 10 * rng.uniform(rng.key(5, "score", F.col("rel")))
    out = L.incremental(g.select("rel"), g.filter("score is not null").select("rel", "score"), "rel", lambda todo: todo.withColumn("score", draw))
    return out.select("rel", rnd("score", 4).alias("score"))


@add("score_random", f"WITH {GAL} SELECT rel, round({_SCORE}, 4) + 0.0 AS score FROM gal")
def score_random(spark: SparkSession, d: str) -> DataFrame:
    """The random scorer, through the scorer slot (Arrow batches)."""
    out = S.scored(gallery(spark, d).select("rel"), S.get_scorer("Random", seed=5, id="rel"))
    return out.select("rel", rnd("score", 4).alias("score"))


@add("newest_per_bucket", f"WITH {GAL}, k AS (SELECT bucket, rel, row_number() OVER (PARTITION BY bucket ORDER BY mtime DESC NULLS LAST, rel)::int AS rank FROM gal) SELECT * FROM k WHERE rank <= 50")
def newest_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    return L.newest_per_bucket(gallery(spark, d), 50).select("bucket", "rel", "rank")


@add("top_rated", f"WITH {GAL} SELECT rel, score FROM gal WHERE score IS NOT NULL ORDER BY score DESC, rel LIMIT 80")
def top_rated(spark: SparkSession, d: str) -> DataFrame:
    return L.top_rated(gallery(spark, d)).select("rel", "score")


_RATED = f"{GAL}, rated AS (SELECT rel, nov, coalesce(res, score) AS r FROM gal WHERE nov IS NOT NULL AND ((res IS NOT NULL AND res <> 0) OR score IS NOT NULL))"


@add("pareto_front", f"WITH {_RATED}, k AS (SELECT *, max(r) OVER (ORDER BY nov DESC, rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rated) SELECT rel, nov, r FROM k WHERE top IS NULL OR r > top")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return L.pareto_front(L.rated(gallery(spark, d)))


@add(
    "pareto_layers",
    f"""WITH RECURSIVE {_RATED}, p AS (
      SELECT 0 AS layer, rel, nov, r, coalesce(r > max(r) OVER (ORDER BY nov DESC, rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS front FROM rated
      UNION ALL SELECT layer + 1, rel, nov, r, coalesce(r > max(r) OVER (ORDER BY nov DESC, rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) FROM p WHERE NOT front)
    SELECT rel, nov, r, layer::int AS layer FROM p WHERE front ORDER BY layer, r DESC, nov DESC, rel LIMIT 120""",
)
def pareto_layers(spark: SparkSession, d: str) -> DataFrame:
    return L.pareto_layers(L.rated(gallery(spark, d)))


_ORDERS = {"new": "1", "score": "coalesce(score, -1.0) DESC", "far": "coalesce(dist, -1.0) DESC", "near": "coalesce(dist, 1e9::double)", "nov": "coalesce(nov, -1.0) DESC", "res": "coalesce(res, -1.0) DESC"}
_FINITE = "dist IS NULL OR (NOT isnan(dist) AND NOT isinf(dist))"  # the client's numbers


@add(
    "sort_orders",
    f"WITH {GAL}, f AS (SELECT * FROM gal WHERE {_FINITE}) " + " UNION ALL ".join(f"SELECT '{k}' AS sorted_by, rel, row_number() OVER (ORDER BY {o}, mtime DESC NULLS LAST, rel) AS place FROM f" for k, o in _ORDERS.items()),
)
def sort_orders(spark: SparkSession, d: str) -> DataFrame:
    """The client's six orders."""
    g = gallery(spark, d).select("rel", "mtime", "score", "dist", "nov", "res").filter(F.col("dist").isNull() | (F.abs("dist") < float("inf")))
    out = None
    for key in _ORDERS:
        one = L.resort(g, key).select(F.lit(key).alias("sorted_by"), "rel", "place")
        out = one if out is None else out.unionByName(one)
    return out


@add("page_nav", f"WITH {GAL}, k AS (SELECT rel, mtime, row_number() OVER (ORDER BY mtime DESC NULLS LAST, rel) AS place FROM gal) SELECT rel, place, ((place - 1) // 200 + 1)::bigint AS page FROM k WHERE place BETWEEN 201 AND 600")
def page_nav(spark: SparkSession, d: str) -> DataFrame:
    """Pages two and three of the newest-first list (paging is what is asked for)."""
    g = L.resort(gallery(spark, d).select("rel", "mtime", "score", "dist", "nov", "res"), "new").filter(F.col("place").between(201, 600))
    return g.select("rel", "place", (F.floor((F.col("place") - 1) / 200) + 1).alias("page"))


@add("page_neighbours", "SELECT id, lag(id) OVER (PARTITION BY action ORDER BY id DESC) AS prev, lead(id) OVER (PARTITION BY action ORDER BY id DESC) AS next FROM jobs")
def page_neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("action").orderBy(F.desc("id"))
    return table(spark, d, "jobs").select("id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))


@add("jobs_recent", "SELECT id, action, status FROM jobs ORDER BY id DESC LIMIT 12")
def jobs_recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").orderBy(F.desc("id")).limit(12).select("id", "action", "status")


@add("hunt_next", f"WITH {GAL} SELECT rel FROM gal ANTI JOIN (SELECT DISTINCT rel FROM gal WHERE score >= 5) USING (rel) WHERE nov IS NOT NULL ORDER BY nov DESC, rel LIMIT 2")
def hunt_next(spark: SparkSession, d: str) -> DataFrame:
    """The first two of the frontier's order that haven't been visited (here: have no score of 5 or more)."""
    g = gallery(spark, d)
    return g.filter("nov is not null").join(g.filter("score >= 5").select("rel"), "rel", "left_anti").orderBy(F.desc("nov"), "rel").limit(2).select("rel")


_MEASURED = "m AS (SELECT bucket, dist FROM gal WHERE dist IS NOT NULL AND NOT isnan(dist) AND NOT isinf(dist) AND dist >= 0)"
_BAND = "count(*) AS n, round(avg(dist), 8) + 0.0 AS mean, (list_sort(list(dist)))[(count(*) // 4 + 1)::int] AS lo, (list_sort(list(dist)))[(3 * count(*) // 4 + 1)::int] AS hi"


def _measured(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    return g.filter(F.col("dist").isNotNull() & ~F.isnan("dist") & (F.abs("dist") < float("inf")) & (F.col("dist") >= 0))


_STARRED = f"starred AS (SELECT rel, name, ({side_sql('distance')})::double AS dist, ({side_sql('temperature')})::double AS temperature, {side_sql('sampler')} AS sampler FROM gal WHERE fav)"


def starred(spark: SparkSession, d: str) -> DataFrame:
    """Favourites with what their sidecars say."""
    s = sidecar("distance double", "temperature double", "sampler string")
    return gallery(spark, d).filter("fav").select("rel", "name", s["distance"].alias("dist"), s["temperature"].alias("temperature"), s["sampler"].alias("sampler"))


@add("taste_band", f"WITH {GAL}, {_STARRED}, m AS (SELECT dist FROM starred WHERE dist IS NOT NULL) SELECT 'all' AS band, {_BAND} FROM m HAVING count(*) > 0")
def taste_band(spark: SparkSession, d: str) -> DataFrame:
    """Where the favourites' distances lie: their number, mean and raw quartiles."""
    one = F.when(F.col("dist").isNotNull(), "all")  # always; a literal would leave the joins on it without a key
    q = L.index_quantiles(starred(spark, d).filter("dist is not null").withColumn("band", one), ["band"], "dist", 8)  # ties of two digits are rounded differently by each engine
    return q.withColumn("mean", rnd("mean", 8))


_STAR_BACKEND = backend_sql("name", ("sdxl", "sd15", "sd2", "flux2", "krea2"))


@add(
    "taste_bands",
    f"""WITH {GAL}, {_STARRED}, b AS (SELECT {_STAR_BACKEND} AS backend, dist FROM starred WHERE dist <> 0)
    SELECT backend, count(*) AS n, round(avg(dist), 5) + 0.0 AS mean, round(greatest(0.35::double, stddev_pop(dist)), 5) + 0.0 AS spread, count(*) >= 10 AS enough FROM b WHERE backend IS NOT NULL GROUP BY 1""",
)
def taste_bands(spark: SparkSession, d: str) -> DataFrame:
    """The favourites' distances by backend, with the spread that the band arm draws with."""
    s = starred(spark, d).filter("dist <> 0").withColumn("backend", R.starred_backend(F.col("name"))).filter("backend is not null")
    n = s.groupBy("backend").agg(F.count("*").alias("n"), rnd(F.avg("dist"), 5).alias("mean"), rnd(F.greatest(F.lit(S.LEAST_SPREAD), F.stddev_pop("dist")), 5).alias("spread"))
    return n.withColumn("enough", F.col("n") >= S.ARM_POINTS)


@add("dist_bands", f"WITH {GAL}, {_MEASURED} SELECT coalesce(bucket, '-') AS bucket, {_BAND} FROM m GROUP BY 1")
def dist_bands(spark: SparkSession, d: str) -> DataFrame:
    """The same statistics of all measured images, by bucket."""
    m = _measured(spark, d).withColumn("bucket", F.coalesce("bucket", F.lit("-")))
    return L.index_quantiles(m, ["bucket"], "dist", 8).withColumn("mean", rnd("mean", 8))


_BACKEND = backend_sql("name", ("flux2", "krea2", "sdxl", "sd2"), "'sd15'")


@add("detect_backend", f"WITH {GAL} SELECT rel, {_BACKEND} AS backend FROM gal")
def detect_backend(spark: SparkSession, d: str) -> DataFrame:
    return gallery(spark, d).select("rel", R.backend_of(F.col("name")).alias("backend"))


def _variants_sql(source: str, keys: str) -> str:
    three, refine = ("sd15", "sd2", "sdxl"), "CASE WHEN contains(name, 'anarchy_sdxl') OR contains(name, 'anarchy_flux2') OR contains(name, 'anarchy_krea2') THEN 'sdxl' WHEN contains(name, 'anarchy_sd2') THEN 'sd2' ELSE 'sd15' END"
    upscale = f"CASE WHEN side IN {three} THEN side ELSE {backend_sql('name', three, chr(39) + 'sd15' + chr(39))} END"
    return f"SELECT {keys}, {_BACKEND} AS by_name, coalesce(nullif(side, ''), {_BACKEND}) AS film, {refine} AS refine, {upscale} AS upscale, regexp_extract(name, '^anarchy_([a-z0-9]+)_', 1) AS invert FROM {source}"


@add("detect_backend_variants", f"WITH {GAL}, m AS (SELECT rel, name, {side_sql('backend')} AS side FROM gal) {_variants_sql('m', 'rel')}")
def detect_backend_variants(spark: SparkSession, d: str) -> DataFrame:
    side = sidecar("backend string")["backend"]
    return gallery(spark, d).select("rel", *[c.alias(k) for k, c in R.backend_variants(F.col("name"), side).items()])


_ODD = [("anarchy_sd15_sdxl-look_1.png", None), ("mysd2pic.png", None), ("anarchy_sd2.png", None), ("anarchy_SDXL_1.png", "sdxl"), ("x_anarchy_krea2_1.png", ""), ("anarchy_flux2_1.png", "flux2"), ("anarchy_sdxl_1.png", "krea2"), ("anarchy_sdxlturbo.png", "sd2"), ("anarchy_new9_1.png", None)]


@add("backend_rules", _variants_sql("(VALUES " + ", ".join(f"('{n}', {'NULL' if s is None else chr(39) + s + chr(39)})" for n, s in _ODD) + ") AS t(name, side)", "name"))
def backend_rules(spark: SparkSession, d: str) -> DataFrame:
    """Names and sidecars on which the rules differ."""
    v = values(spark, _ODD, "name string, side string")
    return v.select("name", *[c.alias(k) for k, c in R.backend_variants(F.col("name"), F.col("side")).items()])


@add(
    "keyframe_tensors",
    f"""WITH {GAL}, k AS (SELECT rel AS key FROM gal WHERE nov IS NOT NULL ORDER BY nov DESC, rel LIMIT 40), g AS (SELECT rel AS key, list(tensor) AS have FROM vectors WHERE rel IS NOT NULL GROUP BY 1)
    SELECT key, NOT coalesce(list_contains(have, 'clip'), false) AS no_clip, NOT coalesce(list_contains(have, 'embeds'), false) AS no_embeds FROM k LEFT JOIN g USING (key)""",
)
def keyframe_tensors(spark: SparkSession, d: str) -> DataFrame:
    """The keyframes of a film (the forty most novel images) with the tensors it needs, and which they lack."""
    v = table(spark, d, "vectors").filter("rel is not null").select(F.col("rel").alias("key"), "tensor", "e").dropDuplicates(["key", "tensor"])
    keys = gallery(spark, d).filter("nov is not null").orderBy(F.desc("nov"), "rel").limit(40).select(F.col("rel").alias("key"))
    t = L.keyframe_tensors(v, keys, ("clip", "embeds"))
    return t.select("key", F.array_contains("missing", "clip").alias("no_clip"), F.array_contains("missing", "embeds").alias("no_embeds"))


@add("most_starred", f"WITH {GAL}, b AS (SELECT {_STAR_BACKEND} AS backend FROM gal WHERE fav) SELECT backend, count(*) AS n FROM b WHERE backend IS NOT NULL GROUP BY 1 ORDER BY n DESC, backend LIMIT 1")
def most_starred(spark: SparkSession, d: str) -> DataFrame:
    """The backend of most favourites; no row where the names of none tell one."""
    b = gallery(spark, d).filter("fav").select(R.starred_backend(F.col("name")).alias("backend")).filter("backend is not null")
    return b.groupBy("backend").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "backend").limit(1)


@add(
    "taste_infer",
    f"""WITH {GAL}, {_STARRED}, b AS (SELECT {backend_sql('rel', ('sd2', 'sdxl', 'sd15'), end='')} AS backend FROM starred)
    SELECT 'backend' AS knob, backend AS option, count(*) AS n, NULL::double AS mean FROM b WHERE backend IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'sampler', sampler, count(*), NULL FROM starred WHERE sampler <> '' GROUP BY 2
    UNION ALL SELECT 'temperature', NULL, count(temperature), round(avg(temperature), 5) + 0.0 FROM starred UNION ALL SELECT 'stars', NULL, count(*), NULL FROM starred""",
)
def taste_infer(spark: SparkSession, d: str) -> DataFrame:
    """What the favourites say of each knob: how often each backend and sampler, the temperatures, how many there are."""
    s = starred(spark, d)
    none = F.lit(None).cast("string")
    count = lambda knob, df, option: df.groupBy(option.alias("option")).agg(F.count("*").alias("n")).select(F.lit(knob).alias("knob"), "option", "n", F.lit(None).cast("double").alias("mean"))
    backend = s.withColumn("b", R._named(F.col("rel"), ("sd2", "sdxl", "sd15"), "")).filter("b is not null")
    total = s.agg(F.count("temperature").alias("t"), rnd(F.avg("temperature"), 5).alias("mean"), F.count("*").alias("n"))
    temperature = total.select(F.lit("temperature").alias("knob"), none.alias("option"), F.col("t").alias("n"), "mean")
    stars = total.select(F.lit("stars").alias("knob"), none.alias("option"), "n", F.lit(None).cast("double").alias("mean"))
    return count("backend", backend, F.col("b")).unionByName(count("sampler", s.filter("sampler <> ''"), F.col("sampler"))).unionByName(temperature).unionByName(stars)


@add("novelty_nn", "SELECT a.vec_id AS id, round(1 - max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 4) + 0.0 AS novelty FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1")
def novelty_nn(spark: SparkSession, d: str) -> DataFrame:
    return L.novelty(vectors(spark, d)).select("id", rnd("novelty", 4).alias("novelty"))


@add("novelty_median", f"WITH {GAL} SELECT round(median(nov), 4) + 0.0 AS median, count(nov) AS n FROM gal")
def novelty_median(spark: SparkSession, d: str) -> DataFrame:
    return gallery(spark, d).agg(rnd(F.median("nov"), 4).alias("median"), F.count("nov").alias("n"))


@add("nearest_token", "SELECT a.vec_id AS q, arg_max(b.vec_id, (round(list_dot_product(a.embedding::double[], b.embedding::double[]), 10), -b.vec_id)) AS token FROM embeddings a JOIN embeddings b ON b.vec_id >= 8 WHERE a.vec_id < 8 GROUP BY 1")
def nearest_token(spark: SparkSession, d: str) -> DataFrame:
    """Eight prompt tokens against the vocabulary (the other vectors)."""
    v = vectors(spark, d)
    return L.nearest_token(v.filter("id < 8").select(F.col("id").alias("q"), "e"), v.filter("id >= 8").select("id", "e"))


@add("running_best", "SELECT event_id, max(value) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_best(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.max("value").over(w).alias("best"))


@add("combo_groups", f"WITH {GAL} SELECT bucket, {_BACKEND} AS backend, count(*) AS n, min(rel) AS first_rel FROM gal GROUP BY ALL")
def combo_groups(spark: SparkSession, d: str) -> DataFrame:
    return gallery(spark, d).groupBy("bucket", R.backend_of(F.col("name")).alias("backend")).agg(F.count("*").alias("n"), F.min("rel").alias("first_rel"))


@add("film_list", "SELECT j.id, j.action, max(r.n) AS n FROM jobs j LEFT JOIN run_requests r ON r.job_id = j.id WHERE j.action IN ('film', 'explore') GROUP BY ALL")
def film_list(spark: SparkSession, d: str) -> DataFrame:
    """Films with what their manifests hold, if there are any; here jobs and their forms."""
    j = table(spark, d, "jobs").filter(F.col("action").isin("film", "explore")).select("id", "action")
    r = table(spark, d, "run_requests").select(F.col("job_id").alias("id"), "n")
    return j.join(r, "id", "left").groupBy("id", "action").agg(F.max("n").alias("n"))


# --- retention and lineage ------------------------------------------------------------------------------------------

# Pointers of the fixture: each event's parent is the event before it, except every ninth, which begins a chain.
EDGES = "edges AS (SELECT event_id AS child, event_id - 1 AS parent, event_type AS kind FROM events WHERE event_id % 9 <> 0)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_id % 9 <> 0").select(F.col("event_id").alias("child"), (F.col("event_id") - 1).alias("parent"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("node"), F.col("event_type").alias("kind"), "value")


def _up(start: str, hops: int, on: str = "true") -> str:
    return f"""up AS (WITH RECURSIVE r(node, anc, hop) AS (SELECT event_id, event_id, 0 FROM events WHERE {start}
      UNION ALL SELECT r.node, e.parent, r.hop + 1 FROM r JOIN edges e ON e.child = r.anc WHERE r.hop < {hops} AND {on}) SELECT * FROM r)"""


@add("lineage_root", f"WITH {EDGES}, {_up('true', 4)}, f AS (SELECT u.node, arg_min(u.anc, u.hop) AS root FROM up u JOIN events v ON v.event_id = u.anc AND v.event_type = 'signup' GROUP BY 1) SELECT event_id AS node, root FROM events LEFT JOIN f ON f.node = event_id")
def lineage_root(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of five nodes upwards that has conditioning (here: is a sign-up)."""
    n = nodes(spark, d)
    return A.root_with(n.select("node"), edges(spark, d), n.filter("kind = 'signup'").select("node"))


@add("inherit_attr", f"WITH {EDGES}, {_up('true', 5)}, f AS (SELECT u.node, arg_min(v.value, u.hop) AS value, arg_min(u.anc, u.hop) AS origin FROM up u JOIN events v ON v.event_id = u.anc AND v.value > 100 GROUP BY 1) SELECT event_id AS node, f.value, origin FROM events LEFT JOIN f ON f.node = event_id")
def inherit_attr(spark: SparkSession, d: str) -> DataFrame:
    """A node's own value if it is above 100, else the nearest ancestor's."""
    n = nodes(spark, d)
    return A.inherit(n.select("node"), edges(spark, d), n.filter("value > 100").select("node", "value"))


@add("protected_set", f"WITH {EDGES}, {_up('user_id % 10 = 0', 6)} SELECT DISTINCT anc AS rel FROM up")
def protected_set(spark: SparkSession, d: str) -> DataFrame:
    fav = table(spark, d, "events").filter("user_id % 10 = 0").select(F.col("event_id").alias("rel"))
    return L.protected(fav, edges(spark, d))


@add("wipe_candidates", f"WITH {EDGES}, {_up('user_id % 10 = 0', 6)} SELECT event_id AS rel, value AS score FROM events WHERE value < 5.0 AND event_id NOT IN (SELECT anc FROM up)")
def wipe_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("rel"), F.col("value").alias("score"))
    return L.wipe_candidates(e, protected_set(spark, d))


@add("wipe_prune", f"WITH {GAL}, gone AS (SELECT rel FROM gal WHERE score < 5.0 AND NOT fav) SELECT 'scores' AS cache, rel FROM gal WHERE score IS NOT NULL AND rel NOT IN (SELECT rel FROM gone) UNION ALL SELECT 'novelty', rel FROM gal WHERE nov IS NOT NULL AND rel NOT IN (SELECT rel FROM gone)")
def wipe_prune(spark: SparkSession, d: str) -> DataFrame:
    g = gallery(spark, d)
    gone = L.wipe_candidates(g.select("rel", "score"), g.filter("fav").select("rel")).select("rel")
    prune = lambda name, c: g.filter(F.col(c).isNotNull()).select("rel").join(gone, "rel", "left_anti").select(F.lit(name).alias("cache"), "rel")
    return prune("scores", "score").unionByName(prune("novelty", "nov"))


@add("favorite_toggle", f"WITH {GAL}, {FAVS}, t AS (SELECT rel FROM gal WHERE size % 50 = 0) SELECT rel FROM favs WHERE rel NOT IN (SELECT rel FROM t) UNION SELECT rel FROM t WHERE rel NOT IN (SELECT rel FROM favs)")
def favorite_toggle(spark: SparkSession, d: str) -> DataFrame:
    """Favourites after toggling some: those that were are no longer, the others are."""
    g = gallery(spark, d)
    fav, t = g.filter("fav").select("rel"), g.filter("size % 50 = 0").select("rel")
    return fav.join(t, "rel", "left_anti").unionByName(t.join(fav, "rel", "left_anti"))


@add("generation_ancestor", f"WITH {EDGES}, {_up('true', 5, chr(101) + '.kind = ' + chr(39) + 'view' + chr(39))} SELECT node, arg_max(anc, hop) AS ancestor FROM up GROUP BY 1")
def generation_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Upwards for as long as the node reached is a refinement (here: a view)."""
    n = nodes(spark, d)
    return A.climb_while(n.select("node"), edges(spark, d), n.select("node", "kind"), "view")


# --- taste ----------------------------------------------------------------------------------------------------------


def _training(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return S.training_rows(v, v.filter("id % 9 = 0").select("id"))


@add(
    "resonance_grad1",
    f"""WITH pos AS (SELECT vec_id AS id, embedding, 1.0::double AS y FROM embeddings WHERE vec_id % 9 = 0),
    neg AS (SELECT vec_id AS id, embedding, 0.0::double AS y FROM embeddings WHERE vec_id % 9 <> 0 QUALIFY row_number() OVER (ORDER BY md5({rng.key_sql(0, 'resonance', 'vec_id')}), vec_id) <= 5 * (SELECT count(*) FROM pos)),
    t AS (SELECT * FROM pos UNION ALL SELECT * FROM neg), n AS (SELECT count(*)::double AS n, sum(y) AS p FROM t),
    x AS (SELECT CASE WHEN y = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END * (0.5 - y) / n AS g, unnest(range(len(embedding)))::int AS pos, unnest(embedding)::double AS v FROM t, n)
    SELECT pos, round(-0.5 * sum(g * v), 5) + 0.0 AS w FROM x GROUP BY pos""",
)
def resonance_grad1(spark: SparkSession, d: str) -> DataFrame:
    return S.first_gradient(_training(spark, d)).select("pos", rnd("w", 5).alias("w"))


_LEARNED = f"""pos AS (SELECT vec_id AS id, embedding::double[] AS e, 1.0::double AS y FROM embeddings WHERE vec_id % 9 = 0),
    neg AS (SELECT vec_id AS id, embedding::double[] AS e, 0.0::double AS y FROM embeddings WHERE vec_id % 9 <> 0 QUALIFY row_number() OVER (ORDER BY md5({rng.key_sql(0, 'resonance', 'vec_id')}), vec_id) <= 5 * (SELECT count(*) FROM pos)),
    rows AS (SELECT * FROM pos UNION ALL SELECT * FROM neg), sizes AS (SELECT count(*)::double AS n, sum(y) AS p FROM rows),
    t AS (SELECT e, y, CASE WHEN y = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END / n AS weight FROM rows, sizes),
    steps AS (SELECT 0 AS step, list_transform(range(64), lambda x: 0.0::double) AS w, 0.0::double AS b
      UNION ALL SELECT step + 1, list_transform(range(1, 65), lambda k: w[k] - 0.5 * (gw[k] + 1e-3 * w[k])), b - 0.5 * gb
      FROM (SELECT any_value(step) AS step, any_value(w) AS w, any_value(b) AS b, list(gx ORDER BY pos) AS gw, any_value(gb) AS gb FROM (
        SELECT any_value(step) AS step, any_value(w) AS w, any_value(b) AS b, pos, sum(g * x) AS gx, sum(g) AS gb FROM (
          SELECT step, w, b, g, unnest(e) AS x, unnest(range(64)) AS pos FROM (SELECT step, w, b, e, weight * (1 / (1 + exp(-(list_dot_product(e, w) + b))) - y) AS g FROM steps, t WHERE step < 400)) GROUP BY pos)) WHERE step IS NOT NULL),
    learned AS (SELECT vec_id AS id, round(1 / (1 + exp(-(list_dot_product(embedding::double[], w) + b))), 4) + 0.0 AS resonance FROM embeddings, steps WHERE step = 400)"""


@add("resonance", f"WITH RECURSIVE {_LEARNED} SELECT id, resonance FROM learned")
def resonance(spark: SparkSession, d: str) -> DataFrame:
    return S.resonance(vectors(spark, d), S.fit_resonance(_training(spark, d)))


_U = rng.uniform_sql(rng.key_sql(9, "choice", "event_id"))


@add(
    "weighted_choice",
    f"""WITH c AS (SELECT bucket AS option, count(*) AS n FROM items WHERE bucket IS NOT NULL GROUP BY 1), k AS (SELECT option, sum(n + 1.0) OVER (ORDER BY option) / sum(n + 1.0) OVER () AS upto FROM c)
    SELECT event_id AS draw, arg_min(option, upto) AS choice FROM events JOIN k ON {_U} < upto GROUP BY 1""",
)
def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "items").filter("bucket is not null").groupBy(F.col("bucket").alias("option")).agg(F.count("*").alias("n"))
    return S.weighted_choice(c, table(spark, d, "events").select(F.col("event_id").alias("draw"), rng.uniform(rng.key(9, "choice", F.col("event_id"))).alias("u")))


# What is believed of each option before a star is counted.
_BACKEND_PRIOR, _SAMPLER_PRIOR = {"sdxl": 4, "flux2": 4, "sd2": 1, "sd15": 1}, {"diagonal": 1, "blend": 1, "pca": 4, "hybrid": 3}
_WEIRD = (40, 60, 90, 120, 160, 200)


@add("strategy_arm", f"SELECT event_id, CASE WHEN {_U} < 0.30 THEN 'free' WHEN {_U} < 0.55 THEN CASE WHEN user_id >= 10 THEN 'band' ELSE 'free*' END WHEN {_U} < 0.80 THEN 'axes' ELSE 'hybrid' END AS arm, CASE WHEN {_U} >= 0.30 AND {_U} < 0.55 AND user_id >= 10 THEN round(least(2.4, greatest(1.3, 1.8 + greatest(0.35::double, value / 100) * {rng.normal_sql(rng.key_sql(9, 'band', 'event_id'))})), 4) + 0.0 END AS target FROM events")
def strategy_arm(spark: SparkSession, d: str) -> DataFrame:
    """An arm for each draw, and the band arm's target; here ten points are ten in ``user_id``, the spread a hundredth
    of ``value``."""
    u = rng.uniform(rng.key(9, "choice", F.col("event_id")))
    e = table(spark, d, "events").withColumn("arm", S.strategy_arm(u, F.col("user_id")))
    target = S.band_target(rng.normal(rng.key(9, "band", F.col("event_id"))), F.lit(1.8), F.col("value") / 100)
    return e.select("event_id", "arm", F.when(F.col("arm") == "band", rnd(target, 4)).alias("target"))


def _weights_sql(prior: dict[str, int], counts: str) -> str:
    listed = ", ".join(f"('{k}', {v}.0::double)" for k, v in prior.items())
    weight = "prior + coalesce(n, 0)"
    return f"SELECT option, sum({weight}) OVER (ORDER BY option) / sum({weight}) OVER () AS upto FROM (VALUES {listed}) AS p(option, prior) LEFT JOIN ({counts}) c USING (option)"


@add(
    "guided_sampler",
    f"""WITH {GAL}, {_STARRED}, k AS ({_weights_sql(_SAMPLER_PRIOR, "SELECT sampler AS option, count(*) AS n FROM starred WHERE sampler <> '' GROUP BY 1")}), b AS ({_weights_sql(_BACKEND_PRIOR, "SELECT 'none' AS option, 0 AS n")}),
    s AS (SELECT event_id, arg_min(option, upto) AS sampler FROM events JOIN k ON {rng.uniform_sql(rng.key_sql(9, 'sampler', 'event_id'))} < upto GROUP BY 1)
    SELECT event_id, s.sampler, arg_min(option, upto) AS backend FROM events JOIN s USING (event_id) JOIN b ON {rng.uniform_sql(rng.key_sql(9, 'backend', 'event_id'))} < upto GROUP BY ALL""",
)
def guided_sampler(spark: SparkSession, d: str) -> DataFrame:
    """A sampler for each draw by the stars and a prior for each option, and a backend by the prior alone."""
    stars = taste_infer(spark, d).filter("knob = 'sampler'").select("option", "n")
    draw = lambda stream: table(spark, d, "events").select(F.col("event_id").alias("draw"), rng.uniform(rng.key(9, stream, F.col("event_id"))).alias("u"))
    sampler = S.weighted_choice(stars, draw("sampler"), _SAMPLER_PRIOR).withColumnRenamed("choice", "sampler")
    backend = S.weighted_choice(stars.limit(0), draw("backend"), _BACKEND_PRIOR).withColumnRenamed("choice", "backend")
    return sampler.join(backend, "draw").select(F.col("draw").alias("event_id"), "sampler", "backend")


_G, _X, _W, _LO = rng.normal_sql(rng.key_sql(9, "combo", "event_id")), rng.uniform_sql(rng.key_sql(9, "explore", "event_id")), rng.uniform_sql(rng.key_sql(9, "weird", "event_id")), rng.uniform_sql(rng.key_sql(9, "lo", "event_id"))


@add(
    "guided_combo",
    f"""WITH {GAL}, {_STARRED}, mu AS (SELECT CASE WHEN count(temperature) >= 2 THEN greatest(avg(temperature), 1.6) ELSE 1.9 END AS mu, count(*) AS stars FROM starred),
    e AS (SELECT *, {_X} < 0.15 OR stars = 0 AS explore, {_W} < 0.7 AS weird FROM events, mu)
    SELECT event_id, explore, CASE WHEN weird THEN ([{', '.join(map(str, _WEIRD))}])[(floor({_LO} * 6) + 1)::int] ELSE 0 END::int AS comp_lo,
    round(CASE WHEN weird THEN 1.05 + 0.35 * {_U} WHEN explore THEN 0.8 + 1.1 * {_U} ELSE greatest(1.6, least(1.9, mu + 0.18 * {_G})) END, 4) + 0.0 AS temperature FROM e""",
)
def guided_combo(spark: SparkSession, d: str) -> DataFrame:
    """A temperature for each draw of the axes' sampler: mostly low on the minor axes; else now and then anything (or
    where there are no stars), else near what was liked, within its bounds."""
    s = starred(spark, d).agg(F.count("temperature").alias("t"), F.avg("temperature").alias("m"), F.count("*").alias("stars"))
    mu = s.select(F.when(F.col("t") >= 2, F.greatest("m", F.lit(1.6))).otherwise(1.9).alias("mu"), "stars")
    key = lambda stream: rng.key(9, stream, F.col("event_id"))
    u, g = rng.uniform(key("choice")), rng.normal(key("combo"))
    e = table(spark, d, "events").crossJoin(F.broadcast(mu)).withColumns({"explore": (rng.uniform(key("explore")) < 0.15) | (F.col("stars") == 0), "weird": rng.uniform(key("weird")) < 0.7})
    lo = F.get(F.array(*[F.lit(x) for x in _WEIRD]), F.floor(rng.uniform(key("lo")) * len(_WEIRD)).cast("int"))
    t = F.when(F.col("weird"), 1.05 + 0.35 * u).when(F.col("explore"), 0.8 + 1.1 * u).otherwise(F.greatest(F.lit(1.6), F.least(F.lit(1.9), F.col("mu") + 0.18 * g)))
    return e.select("event_id", "explore", F.when(F.col("weird"), lo).otherwise(0).alias("comp_lo"), rnd(t, 4).alias("temperature"))


# --- prompts --------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("kind = 'prompt_list'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


_LINES = r"""lines AS (SELECT doc_id, line_no, regexp_replace(value, '^\s+|\s+$', '', 'g') AS prompt FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::int AS line_no, unnest(string_split(text, chr(10))) AS value FROM documents WHERE kind = 'prompt_list')),
prompts AS (SELECT doc_id, line_no, prompt FROM lines WHERE prompt <> '' AND prompt NOT LIKE '#%')"""


@add("prompt_scan", f"WITH {_LINES} SELECT doc_id, line_no, prompt FROM prompts")
def prompt_scan(spark: SparkSession, d: str) -> DataFrame:
    return prompt_lines(_lines(spark, d)).select("doc_id", "line_no", "prompt")


@add("dedupe_keep_first", f"WITH {_LINES} SELECT doc_id, line_no, prompt FROM prompts QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY doc_id, line_no) = 1")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return R.first_kept(prompt_lines(_lines(spark, d)).select("doc_id", "line_no", "prompt"), ["prompt"], ["doc_id", "line_no"])


@add("prompt_fill", f"WITH {_LINES}, c AS (SELECT prompt, 0 AS rank, doc_id * 1000 + line_no AS o FROM prompts WHERE doc_id % 2 = 0 UNION ALL SELECT prompt, 1, doc_id * 1000 + line_no FROM prompts WHERE doc_id % 2 = 1), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY rank, o) = 1) SELECT prompt, rank FROM k ORDER BY rank, o LIMIT 500")
def prompt_fill(spark: SparkSession, d: str) -> DataFrame:
    """Curated prompts first, then generated ones up to 500, each once (a wanted number is the feature)."""
    p = prompt_lines(_lines(spark, d)).select("prompt", (F.col("doc_id") % 2).cast("int").alias("rank"), (F.col("doc_id") * 1000 + F.col("line_no")).alias("o"))
    return R.first_kept(p, ["prompt"], ["rank", "o"]).orderBy("rank", "o").limit(500).select("prompt", "rank")


# A small vocabulary for both shapes.
_WORDS = {
    "subject": ["a lantern", "a harbour", "a moth", "a glasshouse", "a staircase", "an orchard"], "medium": ["ink wash", "oil sketch", "paper cutout", "photograph"], "aesthetic": ["spare", "baroque"], "lighting": ["low sun", "blue hour", "candle light"],
    "composition": ["close view", "wide view"], "mood": ["calm", "uneasy"], "palette": ["pale teal", "warm greys"], "quality": ["fine grain", "sharp focus", "soft edges"],
    "entity": ["heron", "teapot", "windmill", "beetle"], "material": ["of felt", "of glass"], "state": ["half asleep", "in bloom"], "setting": ["on salt flats", "under a tin roof"], "style": ["woodcut", "collage"], "extra": ["rim light", "haze", "candy colors"],
}


@add("prompt_gen", P.compose_sql(120, 11, P.PLAIN, _WORDS))
def prompt_gen(spark: SparkSession, d: str) -> DataFrame:
    return P.compose(spark, 120, 11, P.PLAIN, _WORDS)


@add("prompt_gen_wild", P.compose_sql(120, 12, P.WILD, _WORDS))
def prompt_gen_wild(spark: SparkSession, d: str) -> DataFrame:
    return P.compose(spark, 120, 12, P.WILD, _WORDS)


# --- jobs and logs --------------------------------------------------------------------------------------------------


@add("idle_edges", "SELECT user_id, ts FROM (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before = 'click' AND event_type = 'view'")
def idle_edges(spark: SparkSession, d: str) -> DataFrame:
    """Moments at which a state turns into another (here: a click followed by a view)."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(w))
    return e.filter("before = 'click' and event_type = 'view'").select("user_id", "ts")


@add("lost_jobs", "WITH known AS (SELECT id FROM jobs WHERE id <= (SELECT max(id) // 2 FROM jobs)) SELECT DISTINCT job_id FROM run_requests WHERE job_id > (SELECT max(id) FROM known)")
def lost_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Awaited jobs beyond the newest that is known: the server was started anew. Here the first half of the jobs is
    known."""
    jobs = table(spark, d, "jobs").select("id")
    half = jobs.agg(F.floor(F.max("id") / 2).alias("half"))
    last = jobs.crossJoin(F.broadcast(half)).filter("id <= half").agg(F.max("id").alias("last"))
    return table(spark, d, "run_requests").select("job_id").distinct().crossJoin(F.broadcast(last)).filter("job_id > last").select("job_id")


@add("durations", "SELECT id, CASE WHEN started IS NULL THEN '' WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS took FROM (SELECT id, started, greatest(0, floor((epoch_us(coalesce(ended, TIMESTAMP '2026-01-01')) - epoch_us(started)) / 1e6 + 0.5))::bigint AS s FROM jobs)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """How long each job took, or has taken up to a stated moment."""
    return table(spark, d, "jobs").select("id", R.duration(F.col("started"), F.coalesce("ended", F.lit("2026-01-01").cast("timestamp_ntz"))).alias("took"))


@add("job_states", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each job from its log of states."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))


@add(
    "bounded_tail",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC, line DESC NULLS LAST) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM log_lines)
    SELECT job_id, count(*) AS held, min(seq) AS first_seq FROM n WHERE r <= CASE WHEN n <= 500 THEN n ELSE 500 - 100 + 1 + (n - 500 - 1) % 100 END GROUP BY 1""",
)
def bounded_tail(spark: SparkSession, d: str) -> DataFrame:
    """What buffers of 500 lines that lose 100 at a time hold."""
    t = tails.bounded_tail(table(spark, d, "log_lines"), 500, 100)
    return t.groupBy("job_id").agg(F.count("*").alias("held"), F.min("seq").alias("first_seq"))


@add("log_resume", "SELECT job_id, count(*) AS n, min(seq) AS next_seq FROM log_lines WHERE seq >= 100 GROUP BY 1")
def log_resume(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a reader whose cursor stands at line 100 hasn't got."""
    return table(spark, d, "log_lines").filter("seq >= 100").groupBy("job_id").agg(F.count("*").alias("n"), F.min("seq").alias("next_seq"))


@add("windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    w = tails.windowed_counts(table(spark, d, "events"))
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- scale fixtures: the reference's joins on larger tables ---------------------------------------------------------


@add("scale_left_join", "SELECT c_mktsegment AS segment, count(*) AS n, count(o_orderkey) AS with_order, round(sum(coalesce(o_totalprice, 0)), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def scale_left_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))  # before the join: fewer rows move
    j = c.select("c_custkey", "c_mktsegment").join(per, "c_custkey", "left")
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum(F.greatest(F.coalesce("k", F.lit(0)), F.lit(1))).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("with_order"), F.round(F.sum(F.coalesce("s", F.lit(0.0))), 2).alias("total"))


@add("scale_anti_join", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 25) USING (o_orderkey) GROUP BY 1")
def scale_anti_join(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    return table(spark, d, "orders").join(l, "o_orderkey", "left_anti").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@add(
    "frontier",
    f"""WITH RECURSIVE {_LEARNED}, {LONG},
    near AS (SELECT a.vec_id AS id, round(1 - max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 4) + 0.0 AS nov FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1),
    rated AS (SELECT id, id::varchar AS rel, nov, resonance AS r FROM near JOIN learned USING (id) WHERE resonance <> 0),
    p AS (SELECT 0 AS layer, id, rel, nov, r, coalesce(r > max(r) OVER (ORDER BY nov DESC, rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS front FROM rated
      UNION ALL SELECT layer + 1, id, rel, nov, r, coalesce(r > max(r) OVER (ORDER BY nov DESC, rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) FROM p WHERE NOT front),
    shown AS (SELECT id, layer::int AS layer, nov, r FROM p WHERE front ORDER BY layer, r DESC, nov DESC, rel LIMIT 120)
    SELECT s.id, layer, nov, r, round(sqrt(avg(((v - mean) / sd) ** 2)), 3) + 0.0 AS distance FROM shown s JOIN lone l ON l.id = s.id JOIN sd USING (tensor, pos) GROUP BY ALL""",
)
def frontier(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: novelty and learned preference of every vector, the Pareto layers over both, and the whitened
    distance of what is shown."""
    from embermill.operators import distribution as D

    v = vectors(spark, d)
    both = L.novelty(v).join(S.resonance(v, S.fit_resonance(_training(spark, d))), "id")
    items = both.select(F.col("id").cast("string").alias("rel"), F.col("novelty").alias("nov"), F.col("resonance").alias("res"), F.lit(None).cast("double").alias("score"))
    layers = L.pareto_layers(L.rated(items)).withColumn("id", F.col("rel").cast("bigint"))
    gauge = D.distance(v.join(layers.select("id"), "id", "left_semi").select("tensor", "id", "e"), D.fit(v))
    return layers.join(gauge, "id").select("id", "layer", "nov", "r", rnd("distance", 3).alias("distance"))
