"""Partition-local compaction: find the partitions that hold too many small files, and rewrite only these.

Two layers use the same search. ``suffering`` and ``regroup`` work on any file listing (here the gallery's),
``CompactedTable`` on a partitioned Parquet table, whose suffering partitions it rewrites by dynamic partition
overwrite under snapshot versions and conflict checks."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

MIN_FILES = 24
SMALL_BYTES = 65_536
TARGET_BYTES = 128 * 1024 * 1024
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # Spark's directory name for null


class ConflictError(RuntimeError):
    """Another writer changed the table between planning and commit."""


def suffering(files: DataFrame, partition: str = "folder", size: str = "size", min_files: int = MIN_FILES, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Partitions with at least ``min_files`` files whose mean size is below ``small_bytes``: one row each, with
    ``n_files`` and ``bytes``.

    Sums are exact integers (the mean is compared as bytes < n * limit). Null sizes mean a missing file and don't
    count; null partitions are a partition of their own. Partial sums are made before the shuffle, so a partition
    with most of the files moves one row per task."""
    there = files.filter(F.col(size).isNotNull())
    return _crowded(there.groupBy(partition).agg(F.count("*").alias("n_files"), F.sum(F.col(size).cast("decimal(20,0)")).alias("bytes")), min_files, small_bytes)


def _crowded(sums: DataFrame, min_files: int, small_bytes: int) -> DataFrame:
    return sums.filter((F.col("n_files") >= min_files) & (F.col("bytes") < F.col("n_files") * small_bytes)).withColumn("bytes", F.col("bytes").cast("bigint"))


def regroup(files: DataFrame, partition: str = "folder", path: str = "path", size: str = "size", min_files: int = MIN_FILES, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Assign each file of each suffering partition to exactly one of few packs of about ``target_bytes``.

    Columns: partition, path, size, ``pack`` (``<salt>-<number>``), ``pack_offset`` (its first byte in the pack).
    A partition is cut by a hash of the path into salts of at most about 8 packs or 200,000 files, so that no task
    holds an unbounded partition; in a salt, files follow each other by path and the running size, divided evenly,
    gives the pack. A file larger than the target keeps a pack to itself or shares its first bytes with one.
    Repeated paths must have been removed before (``stored_files`` does). Empty input gives no rows."""
    bad = suffering(files, partition, size, min_files, small_bytes)
    salts = F.greatest(F.lit(1), F.ceil(F.col("bytes") / (8.0 * target_bytes)), F.ceil(F.col("n_files") / 200_000.0)).cast("int")
    f = files.filter(F.col(size).isNotNull()).select(partition, F.col(path).alias("path"), F.col(size).alias("size"))
    f = f.join(bad.select(partition, salts.alias("salts")), partition)
    f = f.withColumn("salt", F.pmod(F.xxhash64("path"), F.col("salts")).cast("int"))
    w = W.partitionBy(partition, "salt")
    before = F.sum("size").over(w.orderBy("path").rowsBetween(W.unboundedPreceding, -1))
    f = f.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("size").over(w))
    packs = F.greatest(F.lit(1), F.ceil(F.col("total") / float(target_bytes))).cast("bigint")
    number = F.least(packs - 1, F.floor(F.col("before") * packs / F.greatest(F.col("total"), F.lit(1))).cast("bigint"))
    f = f.withColumn("number", number)
    start = F.col("before") - F.min("before").over(W.partitionBy(partition, "salt", "number"))
    return f.select(partition, "path", "size", F.concat_ws("-", F.col("salt").cast("string"), F.col("number").cast("string")).alias("pack"), start.cast("bigint").alias("pack_offset"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class CompactedTable:
    """A Parquet table partitioned by one string column, in numbered snapshots.

    Every write puts its files into a generation of its own, ``<path>/data/_gen=<id>/<partition>=<value>``, with a
    manifest that says how many files and bytes it holds of each partition. It becomes visible when its snapshot,
    ``<path>/_snapshots/<version>.json``, is published by a rename that fails if the version exists. So nothing is ever
    changed in place: a reader keeps the files of its snapshot, a writer that dies before publishing has written
    nothing, and a compaction replaces exactly the (partition, generation) pairs that its plan lists, whatever else is
    appended meanwhile. Two compactions that replace the same pair are a ``ConflictError`` for the later one.

    ``vacuum`` removes what no current snapshot needs. File counts come from the manifests, so planning lists no
    folders; what the driver holds is a row for each partition of a batch and a number for each version."""

    MANIFEST = "partition string, gen string, files bigint, bytes bigint, removed boolean"

    def __init__(self, spark: SparkSession, path: str, partition: str):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._p("").getFileSystem(self._conf)
        self._seen: dict[int, dict] = {}

    def _p(self, sub: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path + ("/" + sub if sub else ""))

    def _names(self, sub: str) -> list[str]:
        at = self._p(sub)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    # --- snapshots

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_snapshots") if n.endswith(".json") and n[0] != ".")

    def snapshot(self, version: int) -> dict:
        if version not in self._seen:
            stream = self._fs.open(self._p(f"_snapshots/{version:012d}.json"))
            self._seen[version] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return self._seen[version]

    def _publish(self, version: int, what: dict) -> bool:
        """Whether the version is now this one; False if another writer was first."""
        draft, at = self._p(f"_snapshots/.{uuid.uuid4().hex}"), self._p(f"_snapshots/{version:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(what | {"version": version, "at": time.time()}).encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.valueOf("NONE")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self._conf).rename(draft, at, how)
        except Exception:
            self._fs.delete(draft, False)
            if not self._fs.exists(at):
                raise
            return False
        return True

    def _manifests(self, versions: list[int]) -> DataFrame:
        paths = [f"{self.path}/_manifests/{self.snapshot(v)['gen']}" for v in versions]
        if not paths:
            return self.spark.createDataFrame([], self.MANIFEST)
        return self.spark.read.schema(self.MANIFEST).parquet(*paths)

    def _since(self, version: int | None) -> list[int]:
        """The versions that make up a snapshot: from the last whole one to it."""
        upto = [v for v in self.versions() if version is None or v <= version]
        if version is not None and version not in upto:
            raise ValueError(f"no version {version}")
        whole = [v for v in upto if self.snapshot(v)["op"] == "whole"]
        return [v for v in upto if not whole or v >= whole[-1]]

    def live(self, version: int | None = None) -> DataFrame:
        """partition, gen, files, bytes: what a snapshot consists of (the latest, if none is named)."""
        m = self._manifests(self._since(version))
        gone = m.filter("removed").select(F.col("partition").alias("_p"), F.col("gen").alias("_g"))
        there = m.filter("not removed").select("partition", "gen", "files", "bytes")
        return there.join(gone, _same(F.col("partition"), F.col("_p")) & (F.col("gen") == F.col("_g")), "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, by generations; pairs that a compaction replaced are left out."""
        versions = self._since(version)
        if not versions:
            raise ValueError("the table has no version yet")
        gens = [r["gen"] for r in self.live(version).select("gen").distinct().collect()]  # at most one for each version
        df = self._data().filter(F.col("_gen").isin(gens))
        if any(self.snapshot(v)["op"] == "compact" for v in versions):
            gone = self._manifests(versions).filter("removed").select(F.col("partition").alias("_p"), F.col("gen").alias("_g"))
            df = df.join(gone, _same(F.col(self.partition), F.col("_p")) & (F.col("_gen") == F.col("_g")), "left_anti")
        return df.select(*self._schema().names)

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.snapshot(self.versions()[-1])["schema"]))

    def _data(self) -> DataFrame:
        schema = T.StructType([*self._schema().fields, T.StructField("_gen", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")

    # --- writing

    def _files(self, gen: str) -> DataFrame:
        """The partitions of a written generation with their files and bytes; contents aren't read."""
        f = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/data/_gen={gen}")
        # directory names are escaped, and name the null partition
        name = F.regexp_extract("path", rf"/{self.partition}=([^/]*)/[^/]*$", 1)
        name = F.when(name != NULL_PARTITION, F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name))
        return f.groupBy(name.alias("partition")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select("partition", F.lit(gen).alias("gen"), "files", "bytes", F.lit(False).alias("removed"))

    def _write(self, df: DataFrame, gen: str) -> None:
        """One generation. The overwrite is dynamic: a repeated attempt replaces the partitions of the failed one."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(f"{self.path}/data/_gen={gen}")

    def append(self, df: DataFrame, before_publish=None) -> int:
        """Append rows; returns the version. Rows of a null partition are kept. Appends never conflict.
        ``before_publish`` is called when the files are there and the snapshot isn't (for tests)."""
        if "_gen" in df.columns or dict(df.dtypes).get(self.partition) != "string":
            raise ValueError(f"{self.partition!r} must be a string column, and no column may be named '_gen'")
        df = df.select(*[c for c in df.columns if c != self.partition], self.partition)
        kinds = lambda s: [(f.name, f.dataType) for f in s.fields]
        if self.versions() and kinds(self._schema()) != kinds(df.schema):
            raise ValueError("the columns differ from the table's")
        gen = uuid.uuid4().hex
        self._write(df, gen)
        self._files(gen).write.parquet(f"{self.path}/_manifests/{gen}")
        if before_publish:
            before_publish()
        while True:
            version = (self.versions() or [0])[-1] + 1
            if self._publish(version, {"op": "append", "gen": gen, "schema": df.schema.json()}):
                return version

    def compact(self, min_files: int = MIN_FILES, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, before_commit=None, batch: int = 10_000) -> dict:
        """Rewrite the suffering partitions into files of about ``target_bytes``; other partitions aren't touched.

        Partitions are taken in batches, each a snapshot of its own. Returns the last version and counts. The rows of
        the new files are counted before they are published. ``before_commit`` is called between (tests put a second
        writer there)."""
        total = {"version": (self.versions() or [0])[-1], "partitions": 0, "files_before": 0, "files_after": 0}
        last = None
        while one := self._compact(min_files, small_bytes, target_bytes, before_commit, batch, last):
            last = one.pop("last")
            total = {"version": one["version"]} | {k: total[k] + one[k] for k in ("partitions", "files_before", "files_after")}
        return total

    def _compact(self, min_files: int, small_bytes: int, target_bytes: int, before_commit, batch: int, after: str | None) -> dict | None:
        base = (self.versions() or [0])[-1]
        if not base:
            return None
        live = self.live(base)
        sums = live.groupBy(F.coalesce("partition", F.lit(NULL_PARTITION)).alias("name")).agg(F.sum("files").alias("n_files"), F.sum("bytes").cast("decimal(20,0)").alias("bytes"))
        bad = _crowded(sums, min_files, small_bytes)
        plan = (bad if after is None else bad.filter(F.col("name") > after)).orderBy("name").limit(batch).collect()
        if not plan:
            return None
        outs = {r["name"]: max(1, -(-r["bytes"] // target_bytes)) for r in plan}
        sized = self.spark.createDataFrame([(None if n == NULL_PARTITION else n, k) for n, k in outs.items()], "_value string, outs int")
        mine = lambda df, column: df.join(F.broadcast(sized), _same(F.col(column), F.col("_value")))  # noqa: E731  at most a batch
        pruned = F.col(self.partition).isin([n for n in outs if n != NULL_PARTITION])
        if NULL_PARTITION in outs:
            pruned = pruned | F.col(self.partition).isNull()
        rows = mine(self.read(base).filter(pruned), self.partition)
        salt = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if c not in ("_value", "outs") and "map<" not in kind]), F.col("outs"))
        gen = uuid.uuid4().hex
        self._write(rows.withColumn("_salt", salt).repartition(max(1, min(10_000, sum(outs.values()))), self.partition, "_salt").drop("_salt", "outs", "_value"), gen)
        n, written = rows.count(), self._data().filter(F.col("_gen") == gen).count()
        if n != written:
            self._drop(gen)
            raise RuntimeError(f"{n} rows to rewrite, {written} written")
        gone = mine(live, "partition").select("partition", "gen", F.lit(0).cast("bigint").alias("files"), F.lit(0).cast("bigint").alias("bytes"), F.lit(True).alias("removed"))
        made = self._files(gen)
        made.unionByName(gone).write.parquet(f"{self.path}/_manifests/{gen}")
        if before_commit:
            before_commit()
        checked = base
        while True:
            newest = self.versions()[-1]
            others = [v for v in range(checked + 1, newest + 1) if self.snapshot(v)["op"] == "compact"]
            theirs = self._manifests(others).filter("removed").select(F.col("partition").alias("_p"), F.col("gen").alias("_g"))
            if others and not gone.join(theirs, _same(F.col("partition"), F.col("_p")) & (F.col("gen") == F.col("_g")), "left_semi").isEmpty():
                self._drop(gen)
                raise ConflictError(f"a version after {base} replaced files of this plan")
            checked = newest
            if self._publish(newest + 1, {"op": "compact", "gen": gen, "base": base, "schema": self.snapshot(newest)["schema"]}):
                break
        return {"version": newest + 1, "partitions": len(plan), "files_before": sum(r["n_files"] for r in plan), "files_after": made.agg(F.sum("files")).first()[0], "last": plan[-1]["name"]}

    def _drop(self, gen: str) -> None:
        for sub in (f"data/_gen={gen}", f"_manifests/{gen}"):
            self._fs.delete(self._p(sub), True)

    def vacuum(self, grace: float = 86_400.0) -> int:
        """Publish the latest state as a whole and delete what it doesn't need; how many folders went.

        Earlier snapshots can no longer be read afterwards. Generations that were never published are taken for those
        of dead writers after ``grace`` seconds."""
        while True:
            base = self.versions()[-1]
            gen = uuid.uuid4().hex
            self.live(base).withColumn("removed", F.lit(False)).write.parquet(f"{self.path}/_manifests/{gen}")
            if self._publish(base + 1, {"op": "whole", "gen": gen, "base": base, "schema": self.snapshot(base)["schema"]}):
                break
            self._drop(gen)
        gone = 0
        used = {r["gen"] for r in self.live(base + 1).select("gen").distinct().collect()}
        published = {self.snapshot(v)["gen"] for v in self.versions()}
        latest = {self.snapshot(v)["gen"] for v in self.versions() if v > base}
        for name in self._names("data"):
            g = name.removeprefix("_gen=")
            if name.startswith("_gen=") and g not in used | latest and (g in published or self._old(f"data/{name}", grace)):
                gone += bool(self._fs.delete(self._p(f"data/{name}"), True))
        earlier = [v for v in self._since(base) if self.snapshot(v)["op"] == "compact"]
        for r in self._manifests(earlier).filter("removed").filter(F.col("gen").isin(list(used))).select("partition", "gen").toLocalIterator():
            value = NULL_PARTITION if r["partition"] is None else self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r["partition"])
            gone += bool(self._fs.delete(self._p(f"data/_gen={r['gen']}/{self.partition}={value}"), True))
        for g in self._names("_manifests"):
            if g in published - latest or (g not in published and self._old(f"_manifests/{g}", grace)):
                self._fs.delete(self._p(f"_manifests/{g}"), True)
        return gone

    def _old(self, sub: str, grace: float) -> bool:
        return self._fs.getFileStatus(self._p(sub)).getModificationTime() / 1000 <= time.time() - grace
