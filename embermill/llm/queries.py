"""Queries of the subpackage's operators, with oracle SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.llm import knn, packing, quantiles, reading, subset, tokenizer
from embermill.operators.gallery import stored_files
from embermill.plans.data_quality import FILES_SQL
from embermill.sources.tables import table

# Dimensions of the tensors.
DIMENSIONS = {"clip": 64, "embeds": 48}
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
DEFAULT_BACKEND = "sd15"
DOCS_A_BIN, COST_SHARE = 4, 0.4  # limits of ``p7_limited``; the cost as a share of the square of the capacity


def measured(spark: SparkSession, d: str) -> DataFrame:
    """``job``, ``day`` (of the file's time) and ``dist`` of every stored image; negative values count as null."""
    files = stored_files(table(spark, d, "items").withColumnRenamed("job_id", "job"), ("job", "dist", "mtime"))
    return files.select("job", F.to_date("mtime").alias("day"), F.when(F.col("dist") >= 0, F.col("dist")).alias("dist"))


def backends(spark: SparkSession, d: str) -> DataFrame:
    """(job, backend): of repeated or late forms of a job the latest received counts; null and blank are the default."""
    name = F.lower(F.regexp_replace("backend", r"\s+", ""))
    forms = table(spark, d, "run_requests").select(F.col("job_id").alias("job"), "received_at", F.coalesce(F.nullif(name, F.lit("")), F.lit(DEFAULT_BACKEND)).alias("backend"))
    return forms.groupBy("job").agg(F.max(F.struct("received_at", "backend"))["backend"].alias("backend"))


def p2_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Counted by job first, so of a job with most of the images only its buckets are joined and shuffled. Jobs
    without form have no backend and are left out."""
    by_job = quantiles.sketch(measured(spark, d), ["job"], "dist").join(backends(spark, d), "job")
    return quantiles.merge(by_job.select("backend", "sign", "bucket", "n"))


def p2_days(spark: SparkSession, d: str) -> DataFrame:
    """The sketches of separate days; ``merge`` of all of them, without the day, is ``p2_sketch``."""
    return quantiles.merge(_counted(spark, d))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Counts by backend and day, which may repeat."""
    by_job = quantiles.sketch(measured(spark, d), ["job", "day"], "dist").join(backends(spark, d), "job")
    return by_job.select("backend", F.col("day").cast("string").alias("day"), "sign", "bucket", "n")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = quantiles.percentiles(_counted(spark, d).drop("day"), ["backend"], PERCENTILES)
    return p.withColumns({c: F.round(c, 9) for c in ("estimate", "low", "high")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors")
    clip, embeds = (knn.similar_pairs(knn.usable(v, t, n)) for t, n in DIMENSIONS.items())
    return clip.unionByName(embeds)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every vector whose id is divisible by 50, against all vectors of its tensor."""
    v = table(spark, d, "vectors")
    out = []
    for t, n in DIMENSIONS.items():
        rows = knn.usable(v, t, n)
        out.append(knn.neighbours(rows, 5, knn.FAR, asking=rows.filter(F.col("id") % 50 == 0)).withColumn("tensor", F.lit(t)))
    return out[0].unionByName(out[1])


def p5_picked(spark: SparkSession, d: str) -> DataFrame:
    v, wanted = table(spark, d, "vectors"), table(spark, d, "pick_requests").filter("pick_id is not null and n_pick > 0").collect()  # the settings
    out = None
    for t, n in DIMENSIONS.items():
        mine = [r for r in wanted if r["tensor"] == t]
        if not mine:
            continue
        order = subset.varied(knn.usable(v, t, n), max(r["n_pick"] for r in mine))
        for r in mine:
            part = order.filter(F.col("rank") <= r["n_pick"]).select(F.lit(r["pick_id"]).alias("pick_id"), F.lit(t).alias("tensor"), "rank", "id")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "pick_id int, tensor string, rank int, id bigint, rel string, nov double")
    # inner joins with the picked rows, so the large sides are filtered where they lie
    ids = out.select("id").distinct()
    rels = v.select("id", "rel").join(ids, "id").filter("rel is not null").groupBy("id").agg(F.min("rel").alias("rel"))
    files = stored_files(table(spark, d, "items"), ("nov",)).select(F.col("path").alias("rel"), "nov")
    known = files.join(rels.select("rel").distinct(), "rel")
    return out.join(rels, "id", "left").join(known, "rel", "left").select("pick_id", "tensor", "rank", "id", "rel", "nov")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.decode(p6_ids(spark, d))


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokenizer.encode(table(spark, d, "documents"), counts_only=True)
    return packing.pack(sizes, table(spark, d, "containers"))


def p7_limited(spark: SparkSession, d: str) -> DataFrame:
    """As ``p7_placed``, with limits that bind beside the tokens: places for documents, and attention cost."""
    sizes = tokenizer.encode(table(spark, d, "documents"), counts_only=True)
    kinds = table(spark, d, "containers").withColumns({"max_docs": F.lit(DOCS_A_BIN), "max_cost": COST_SHARE * F.col("capacity_tokens").cast("double") ** 2})
    return packing.pack(sizes, kinds)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers of each kind there are, and how many there must be at least."""
    capacity = table(spark, d, "containers").select("container", "capacity_tokens").distinct()
    bins = p7_placed(spark, d).groupBy("container", "bin").agg(F.sum("n_tokens").alias("tokens"))
    n = bins.groupBy("container").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).join(capacity, "container")
    return n.select("container", "bins", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return reading.grade(docs, reading.train(docs, table(spark, d, "level_labels"))).withColumn("reader_level", F.round("level").cast("int"))


_MEASURED = (
    "WITH "
    + FILES_SQL.split("files AS")[0].strip().rstrip(",")
    + r""",
stored AS (SELECT job_id, mtime::date AS day, dist FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM n WHERE path <> '') WHERE rn = 1 AND size IS NOT NULL),
forms AS (SELECT job_id, max((received_at, coalesce(nullif(lower(regexp_replace(backend, '\s+', '', 'g')), ''), 'sd15')))[2] AS backend FROM run_requests GROUP BY 1),
measured AS (SELECT backend, day, dist FROM stored JOIN forms USING (job_id) WHERE dist >= 0 AND NOT isnan(dist) AND NOT isinf(dist)),
sketch AS (SELECT backend, CASE WHEN dist = 0 THEN 0 ELSE 1 END AS sign, CASE WHEN dist = 0 THEN 0 ELSE ceil(ln(dist) / ln(1.01::double / 0.99))::int END AS bucket, count(*) AS n FROM measured GROUP BY ALL),
days AS (SELECT backend, day, CASE WHEN dist = 0 THEN 0 ELSE 1 END AS sign, CASE WHEN dist = 0 THEN 0 ELSE ceil(ln(dist) / ln(1.01::double / 0.99))::int END AS bucket, count(*) AS n FROM measured GROUP BY ALL)
"""
)
_USABLE = """u AS (SELECT id, tensor, e FROM vectors WHERE len(e) = CASE tensor WHEN 'clip' THEN 64 WHEN 'embeds' THEN 48 END
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 12) AS s FROM u a JOIN u b ON a.tensor = b.tensor AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s)"""

def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source by the reader they take (null: no English prose)."""
    docs = table(spark, d, "documents")
    graded = reading.grade(docs, reading.train(docs, table(spark, d, "level_labels")), keep=("source",))
    scale = table(spark, d, "reading_scale")
    n = graded.groupBy("source", F.round("level").cast("int").alias("reading_level")).agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))
    return n.join(scale, "reading_level", "left")


SQL = {
    "p2_sketch": _MEASURED + "SELECT * FROM sketch",
    "p2_days": _MEASURED + "SELECT backend, day::varchar AS day, sign, bucket, n FROM days",
    "p2_percentiles": _MEASURED
    + f""", run AS (SELECT *, sum(n) OVER (PARTITION BY backend ORDER BY sign, bucket) AS upto, sum(n) OVER (PARTITION BY backend) AS total FROM sketch),
    q(q) AS (VALUES {", ".join(f"({q}::double)" for q in PERCENTILES)}), gw AS (SELECT ln(1.01::double / 0.99) AS w)
    SELECT backend, q, round(CASE sign WHEN 0 THEN 0 ELSE exp(bucket * w) * 0.99 END, 9) AS estimate, round(CASE sign WHEN 0 THEN 0 ELSE exp((bucket - 1) * w) END, 9) AS low, round(CASE sign WHEN 0 THEN 0 ELSE exp(bucket * w) END, 9) AS high, total::bigint AS n
    FROM run, q, gw WHERE floor(q * (total - 1)) < upto AND floor(q * (total - 1)) >= upto - n""",
    "p4_found": f"WITH {_USABLE} SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5 AND s >= 0.9",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def register(registry) -> None:
    for f in (p2_percentiles, p2_sketch, p2_days, p4_found, p4_neighbours, p5_picked, p6_ids, p6_decoded, p7_placed, p7_limited, p7_fill, p8_found, p8_levels, p8_profile):
        registry.add(f.__name__, SQL.get(f.__name__))(f)
