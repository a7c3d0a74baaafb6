"""Views of the studio's tables in the reference's terms, in both dialects, and rounding at the border of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.operators.gallery import stored_files
from embermill.plans.data_quality import FILES_SQL
from embermill.sources.tables import table


def rnd(c: Column | str, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


CARRY = ("name", "bucket", "mtime", "meta_raw", "job_id", "fav", "score", "dist", "nov", "res")


def gallery(spark: SparkSession, d: str) -> DataFrame:
    """One row for each stored image, by its plain path as ``rel``."""
    return stored_files(table(spark, d, "items"), CARRY).withColumnRenamed("path", "rel")


#: The same as CTE ``gal``.
GAL = FILES_SQL.split("files AS")[0].replace("* FROM items)", "* EXCLUDE (rel), rel AS rel0 FROM items)").strip().rstrip(",") + r""",
gal AS (SELECT path AS rel, regexp_replace(path, '/?[^/]*$', '') AS folder, size, name, bucket, mtime, meta_raw, job_id, fav, score, dist, nov, res
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM n WHERE path <> '')
  WHERE rn = 1 AND size IS NOT NULL)"""


def vectors(spark: SparkSession, d: str, grouped: bool = False) -> DataFrame:
    """(tensor, id, e) of the embeddings: one tensor, or with ``grouped`` one for each label."""
    tensor = F.col("label").cast("string") if grouped else F.lit("all")
    return table(spark, d, "embeddings").select(tensor.alias("tensor"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))


#: (tensor, id, pos, v) as CTEs ``lone`` (one tensor) and ``many`` (by label).
LONG = """lone AS (SELECT 'all' AS tensor, vec_id AS id, unnest(range(len(embedding)))::int AS pos, unnest(embedding)::double AS v FROM embeddings),
many AS (SELECT label::varchar AS tensor, vec_id AS id, unnest(range(len(embedding)))::int AS pos, unnest(embedding)::double AS v FROM embeddings),
coord AS (SELECT tensor, pos, avg(v) AS mean, greatest(stddev_pop(v), 1e-4::double) AS std FROM lone GROUP BY ALL),
coords AS (SELECT tensor, pos, avg(v) AS mean, greatest(stddev_pop(v), 1e-4::double) AS std FROM many GROUP BY ALL),
sd AS (SELECT tensor, pos, mean, greatest(std, 0.1::double * avg(std) OVER (PARTITION BY tensor)) AS sd FROM coord),
sds AS (SELECT tensor, pos, mean, greatest(std, 0.1::double * avg(std) OVER (PARTITION BY tensor)) AS sd FROM coords)"""


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], columns: str) -> str:
    def cell(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"{x!r}::double"
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def sidecar(*fields: str) -> dict[str, Column]:
    """Fields (``name type``) of the JSON sidecar ``meta_raw``; null where it is cut off or missing."""
    meta = F.from_json("meta_raw", f"{', '.join(fields)}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return {f.split()[0]: F.when(meta["_broken"].isNull(), meta[f.split()[0]]) for f in fields}


def backend_sql(name: str, backends: tuple[str, ...], otherwise: str = "NULL", end: str = "_") -> str:
    return "CASE " + " ".join(f"WHEN contains({name}, 'anarchy_{b}{end}') THEN '{b}'" for b in backends) + f" ELSE {otherwise} END"


def side_sql(field: str) -> str:
    return f"CASE WHEN json_valid(meta_raw) THEN meta_raw->>'$.{field}' END"
