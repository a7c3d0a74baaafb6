"""Queries of the core's training-data operators: p1 (small files) and p3 (log lines)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.operators import compaction, gallery, logs
from embermill.plans.registry import registry
from embermill.session import checkpoint_dir, cut
from embermill.sources.tables import table

#: Stored files in DuckDB: the plain path, then the latest scan.
FILES_SQL = r"""
u AS (SELECT regexp_replace(regexp_replace(rel, '^\s+|\s+$', '', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS x, * FROM items),
v AS (SELECT CASE WHEN x LIKE '%?%path=%' THEN regexp_extract(x, '[?&]path=([^&#]*)', 1) ELSE x END AS y, * FROM u),
w AS (SELECT '/' || replace(regexp_replace(url_decode(y), '^\s+|\s+$', '', 'g'), '\', '/') AS z, * FROM v),
n AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(z, '/(\./)+', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '^/(outputs/)?', '') AS path, * FROM w),
files AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS folder,
          arg_max(size, (scanned_at, coalesce(size, -1))) AS size_or_null, max((scanned_at, coalesce(size, -1)))[2] AS size
          FROM n WHERE path <> '' GROUP BY path HAVING max((scanned_at, coalesce(size, -1)))[2] >= 0)
"""


@registry.add("p1_found", f"WITH {FILES_SQL} SELECT folder FROM files GROUP BY folder HAVING count(*) >= 24 AND sum(size) < 65536 * count(*)")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.suffering(gallery.stored_files(table(spark, d, "items"))).select("folder")


@registry.add(
    "p1_regrouped",
    f"""WITH {FILES_SQL}, bad AS (SELECT folder FROM files GROUP BY folder HAVING count(*) >= 24 AND sum(size) < 65536 * count(*))
    SELECT folder, path, size FROM files JOIN bad USING (folder)""",
)
def p1_regrouped(spark: SparkSession, d: str) -> DataFrame:
    return compaction.regroup(gallery.stored_files(table(spark, d, "items"))).select("folder", "path", "size")


@registry.add("p1_packs")
def p1_packs(spark: SparkSession, d: str) -> DataFrame:
    packs = compaction.regroup(gallery.stored_files(table(spark, d, "items")))
    return packs.groupBy("folder", "pack").agg(F.count("*").alias("n_images"), F.sum("size").alias("bytes"))


#: Folders are far too many for partitions of a table; the first part of a path is the partition here.
_SECTION = "CASE WHEN folder = '' THEN NULL ELSE split_part(folder, '/', 1) END"


@registry.add("p1_rewritten", f"WITH {FILES_SQL} SELECT {_SECTION} AS section, path, size FROM files")
def p1_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """The stored files as a table of many small files, written by several appends, after its compaction. The table
    lies in the checkpoint folder."""
    section = F.nullif(F.substring_index("folder", "/", 1), F.lit(""))
    files = cut(gallery.stored_files(table(spark, d, "items")).select("path", "size", section.alias("section")))
    t = compaction.CompactedTable(spark, f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}", "section")
    for half in range(2):
        t.append(files.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == half).repartition(16, "path"))
    t.compact(min_files=24, small_bytes=1 << 20)
    return t.read().select("section", "path", "size")


@registry.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_entries(table(spark, d, "log_lines"), table(spark, d, "jobs"), with_message=False)


@registry.add("p3_entries")
def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_entries(table(spark, d, "log_lines"), table(spark, d, "jobs"))


@registry.add("p3_templates")
def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    """The mined head templates, their pieces separated by blanks, and the roles of keys in key=value lines."""
    mined = logs.mine_templates(cut(logs.count_heads(table(spark, d, "log_lines"))))
    found = [("head", t.replace("\x1f", " "), n) for t, n in sorted(mined.templates.items())] + [("key", f"{k}={role}", None) for k, role in sorted(mined.keys.items())]
    return spark.createDataFrame(found, "kind string, template string, n bigint")
