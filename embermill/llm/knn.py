"""The k most similar vectors of every vector by multiprobe p-stable hashing.

Vectors are scaled to length 1 (so Euclidean distance orders like cosine) and exact copies are put together. A table
hashes a vector by several functions floor((a x + b) / w), a drawn from the normal distribution, which is 2-stable. A
vector lies in its own bucket of every table, and asks its own and the perturbed buckets that most likely hold
neighbours, in the order of the estimated success of each set of steps (the squared distances to the crossed
boundaries). How many tables, functions and probes are needed is measured on a bounded sample (``fitted_plan``).

Buckets that hold too many vectors are cut into parts that every question visits, and the questions of one bucket into
blocks, so no row is left out and no task holds an unbounded side, however dense a group is. Coordinates travel as two
bytes each; all candidates that their rounding may have put in a wrong order are ranked by exact distance."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from embermill.functions.vector import dot, let, norm
from embermill.session import cut, share


@dataclass(frozen=True)
class Plan:
    """Parameters of the index."""

    tables: int = 3
    functions: int = 4
    width: float = 1.2
    probes: int = 4  # buckets asked in each table, with the own one
    most: int = 4000  # vectors in a bucket before it is cut into parts
    asked: int = 30_000  # questions to one part that are compared in one task
    seed: int = 17


def near_plan(n: int, bucket: int = 400) -> Plan:
    """For neighbours of cosine 0.9 or more among ``n`` vectors: as many functions as give buckets of about
    ``bucket`` vectors (a function of width 1.2 parts unit vectors into about 3.4 cells), and as many probes as keep
    the recall of such pairs above 0.98 (README)."""
    m = min(16, max(2, round(math.log(max(n, 1) / bucket) / math.log(3.4)))) if n > bucket else 2
    return Plan(tables=3 if m <= 5 else 4, functions=m, probes=max(4, 2 * m - 4))


#: For the neighbours of stated questions, however far: wide buckets, most of which are asked. Where the nearest
#: vectors are hardly nearer than the rest, no hashing finds them among less.
FAR = Plan(tables=2, functions=2, width=1.4, probes=8)
NEAR = 0.9  # the similarity from which on ``near_plan`` is for
SIMILAR_DIGITS = 9
SLACK = 5e-4  # by how much two-byte coordinates may misplace a similarity, with a margin
#: Bounds of the sample on which a plan is fitted: rows, and of these the questions.
SAMPLE_ROWS, SAMPLE_QUESTIONS = 4_000, 300
TARGET = 0.95  # recall on the sample
MOVE = 200  # comparisons that cost as much as moving a question to a bucket
SMALL = 500_000  # rows of two numbers that may be broadcast


def usable(vectors: DataFrame, tensor: str, dim: int, vector: str = "e", id: str = "id") -> DataFrame:
    """``id`` and ``v`` (array<double>) of the vectors of a tensor that are not null, have ``dim`` numbers, all
    finite, not all zero."""
    e = F.col(vector).cast("array<double>")
    # the largest size of a number, nulls counted as NaN, which is above all numbers
    largest = F.aggregate(e, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(F.coalesce(x, F.lit(float("nan"))))))
    fine = let(largest, lambda m: (m > 0) & (m < float("inf")))
    return vectors.filter((F.col("tensor") == tensor) & F.col(id).isNotNull()).filter((F.size(e) == dim) & fine).select(F.col(id).alias("id"), e.alias("v"))


class _Hashes:
    """The functions of all tables; the same on every worker."""

    def __init__(self, p: Plan, dim: int):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.a = rng.standard_normal((p.tables, dim, p.functions))
        self.b = rng.uniform(0, p.width, (p.tables, 1, p.functions))
        self.mix = rng.integers(1, 2**63 - 1, (p.tables, p.functions), dtype=np.int64) | 1
        self.sets = self._order(p.functions, p.probes)

    @staticmethod
    def _order(m: int, probes: int) -> np.ndarray:
        """Sets of perturbations in the order of their expected score, as 0/1 rows over the 2m boundaries sorted by
        distance (the j-th and the (2m + 1 - j)-th are the two of one function, so no set holds both)."""
        score = np.array([(j * (j + 1)) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + ((2 * m + 1 - j) * (2 * m + 2 - j)) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)])
        out, heap = [()], [(score[0], (0,))]
        while heap and len(out) < probes:
            s, a = heapq.heappop(heap)
            if not any(2 * m - 1 - j in a for j in a):
                out.append(a)
            j = a[-1] + 1
            if j < 2 * m:
                heapq.heappush(heap, (s + score[j], (*a, j)))
                heapq.heappush(heap, (s - score[j - 1] + score[j], (*a[:-1], j)))
        return np.array([[j in a for j in range(2 * m)] for a in out])

    def keys(self, cells: np.ndarray, t: int) -> np.ndarray:
        """The keys of buckets; equal ones of different buckets only add comparisons."""
        with np.errstate(over="ignore"):
            return ((cells.astype(np.int64) + 7919) * self.mix[t]).sum(1) + t

    def _cells(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        u = (x @ self.a[t] + self.b[t]) / self.p.width
        cells = np.floor(u)
        return cells, u - cells

    def home(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.keys(self._cells(x, t)[0], t)

    def ask(self, x: np.ndarray, t: int) -> np.ndarray:
        """The keys of the asked buckets of table ``t``, probes x rows."""
        m = self.p.functions
        cells, part = self._cells(x, t)
        to = np.concatenate([part, 1 - part], axis=1)
        order = np.argsort(to, axis=1, kind="stable")
        out = []
        for s in self.sets:
            c = cells.copy()
            for j in np.flatnonzero(s):
                which = order[:, j]
                c[np.arange(len(x)), which % m] += np.where(which < m, -1, 1)
            out.append(self.keys(c, t))
        return np.array(out)


def _codes(x: np.ndarray) -> np.ndarray:
    """Coordinates as two bytes each, in units of the vector's largest."""
    return np.rint(x * (32767 / np.abs(x).max(1, keepdims=True))).astype(np.int16)


def _coded(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The unit vectors of a column of codes."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 1), np.float32)
    ends = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_binary(flat.type) else np.int32)[flat.offset : flat.offset + len(flat) + 1]
    x = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int16).reshape(len(flat), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    step = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(step)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per direction: class and code; the members of classes of several: id, class, copies). Directions equal
    to nine digits are one class, named by its lowest id, so copies, whatever their number, are hashed and compared
    once. Of an id with several vectors one counts."""

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in it:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                key = np.frombuffer(b"".join([hashlib.md5(r.tobytes()).digest() for r in np.round(x, SIMILAR_DIGITS) + 0.0]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key[:, 0]), pa.array(key[:, 1]), _binary(_codes(x))], ["id", "k1", "k2", "u"])

    kind = dict(rows.dtypes)["id"]
    k = cut(rows.select("id", "v").mapInArrow(keyed, f"id {kind}, k1 bigint, k2 bigint, u binary"))
    if k.count() > k.select("id").distinct().count():
        k = cut(k.groupBy("id").agg(F.min(F.struct("k1", "k2", "u")).alias("s")).select("id", "s.*"))
    several = cut(k.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.count("*").alias("copies")).filter("copies > 1"))
    several = F.broadcast(several) if several.count() <= SMALL else several
    first = k.join(several, ["k1", "k2"], "left").filter(F.col("class").isNull() | (F.col("id") == F.col("class")))
    return cut(first.select(F.col("id").alias("class"), "u")), cut(k.join(several, ["k1", "k2"]).select("id", "class", "copies"))


def fitted_plan(first: DataFrame, k: int, target: float = TARGET) -> Plan:
    """The cheapest plan by which the questions of a sample find a share of at least ``target`` of their ``k`` nearest
    among all rows, found by comparing them with every row. ``first``: class and u (codes).

    The sample is bounded (``SAMPLE_ROWS``, ``SAMPLE_QUESTIONS``; by a hash). Where no plan of less reaches the target,
    everything is compared."""
    n = first.count()
    some = first.select("class", "u").orderBy(F.xxhash64("class"), "class").limit(SAMPLE_ROWS).toArrow()
    held = _coded(some["u"])
    questions, ids = held[:SAMPLE_QUESTIONS], some["class"].to_numpy()[:SAMPLE_QUESTIONS]
    shared = share(first.sparkSession, (questions, ids))
    kind = dict(first.dtypes)["class"]

    def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared()
        for b in it:
            for lo in range(0, b.num_rows, 20_000):
                part = b.slice(lo, 20_000)
                s = q @ _coded(part.column(1)).T
                s[own[:, None] == part.column(0).to_numpy()[None, :]] = -9
                at = np.argsort(-s, axis=1)[:, :k]
                r = np.repeat(np.arange(len(q)), at.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), part.column(0).take(pa.array(at.ravel())), pa.array(s[r, at.ravel()].astype(float)), part.column(1).take(pa.array(at.ravel()))], ["q", "class", "s", "u"])

    found = first.select("class", "u").mapInArrow(nearest, f"q int, class {kind}, s double, u binary")
    order = W.partitionBy("q").orderBy(F.desc("s"), "class")
    true = found.filter("s > -2").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("q", "u").toArrow()
    everything = Plan(tables=1, functions=1, width=100.0, probes=3)
    if not true.num_rows:
        return everything
    of, near = true["q"].to_numpy(), _coded(true["u"])
    best, least = everything, math.inf
    for functions in range(1, 17):
        for width in (1.2, 1.8):
            plan = Plan(4, functions, width, min(64, 3**functions))
            h = _Hashes(plan, held.shape[1])
            rank, share_of = [], []
            for t in range(plan.tables):
                asked = h.ask(questions, t)
                hit = asked[:, of] == h.home(near, t)[None, :]
                rank.append(np.where(hit.any(0), hit.argmax(0), 10**6))
                keys, sizes = np.unique(h.home(held, t), return_counts=True)
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                share_of.append((np.where(keys[at] == asked, sizes[at], 0) / len(held)).mean(1).cumsum())
            for tables in range(1, plan.tables + 1):
                first_hit = np.min(rank[:tables], axis=0)
                for probes in range(1, len(share_of[0]) + 1):
                    cost = n * sum(c[probes - 1] for c in share_of[:tables]) + MOVE * tables * (probes + 1)
                    if cost < least and (first_hit < probes).mean() >= target:
                        best, least = Plan(tables, functions, width, probes), cost
    return best


def _sides(first: DataFrame, asked: DataFrame, plan: Plan, dim: int) -> tuple[DataFrame, DataFrame]:
    """(place, class, u) of the questions and of the held vectors. A place is one part of a bucket with one block of
    its questions: neither side has many more rows than ``plan.asked`` and ``plan.most``."""
    hashes, kind = share(first.sparkSession, _Hashes(plan, dim)), dict(first.dtypes)["class"]

    def counts(side: str):
        def batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = hashes()
            for b in it:
                x = _coded(b.column(0))
                if len(x):
                    key, n = np.unique(np.concatenate([h.home(x, t) if side == "held" else h.ask(x, t).ravel() for t in range(plan.tables)]), return_counts=True)
                    none = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n if side == "held" else none), pa.array(none if side == "held" else n)], ["key", "held", "asked"])

        return batch

    def homes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes()
        for b in it:
            x = _coded(b.column(1))
            for t in range(plan.tables if len(x) else 0):
                yield pa.RecordBatch.from_arrays([pa.array(h.home(x, t)), b.column(0), b.column(1)], ["key", "class", "u"])

    def questions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes()
        for b in it:
            x = _coded(b.column(1))
            for t in range(plan.tables if len(x) else 0):
                for keys in h.ask(x, t):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0), b.column(1)], ["key", "class", "u"])

    # the buckets that hold or are asked too much, counted in the batches first
    size = "key bigint, held bigint, asked bigint"
    load = first.select("u").mapInArrow(counts("held"), size).unionByName(asked.select("u").mapInArrow(counts("asked"), size))
    load = load.groupBy("key").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).filter((F.col("held") > 0) & ((F.col("held") > plan.most) | (F.col("asked") > plan.asked)))
    cuts = cut(load.select("key", F.ceil(F.col("held") / plan.most).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("asked") / plan.asked)).cast("int").alias("blocks")))
    cuts = F.broadcast(cuts) if cuts.count() <= SMALL else cuts
    shape = f"key bigint, class {kind}, u binary"

    def placed(side: DataFrame, one: str, every: str) -> DataFrame:
        """The part (of the held vectors) and block (of the questions) of each row: one of the ones, all others."""
        side = side.join(cuts, "key", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "blocks")})
        side = side.withColumn(one, F.pmod(F.xxhash64("class", F.lit(one)), F.col(one)).cast("int"))
        side = side.withColumn(every, F.explode(F.sequence(F.lit(0), F.col(every) - 1)))
        return side.select(F.xxhash64("key", "parts", "blocks").alias("place"), "class", "u")

    held = placed(first.select("class", "u").mapInArrow(homes, shape), "parts", "blocks")
    asks = placed(asked.select("class", "u").mapInArrow(questions, shape), "blocks", "parts")
    return asks, held


def neighbours(rows: DataFrame, k: int = 5, plan: Plan | None = None, asking: DataFrame | None = None, least: float = -1.0) -> DataFrame:
    """(id, neighbour, rank, similarity): for every row (or every one of ``asking``, with column id) the ``k`` most
    similar other rows that the index finds, by cosine similarity, ties by id.

    ``rows``: id and v (array<double>), all usable and of one length; repeated rows count once. With ``least``, only
    neighbours of at least that similarity. Without a plan, ``near_plan`` serves a ``least`` of 0.9 or more, and
    ``fitted_plan`` any other. A row's copies are its neighbours of similarity 1; of larger groups of copies each row
    gets ``k``. Rows without any other row in their buckets come out without neighbours."""
    spark = rows.sparkSession
    head = rows.select(F.size("v")).first()
    kind = dict(rows.dtypes)["id"]
    if head is None:
        return spark.createDataFrame([], T.StructType.fromDDL(f"id {kind}, neighbour {kind}, rank int, similarity double"))
    dim = head[0]
    first, members = _classes(rows)
    if plan is None:
        plan = near_plan(first.count()) if least >= NEAR else fitted_plan(first, k)
    asked = first
    if asking is not None:
        some = members.join(asking.select("id"), "id", "left_semi").select("class").union(asking.select(F.col("id").alias("class")))
        asked = first.join(some, "class", "left_semi")
    asks, held = _sides(first, asked, plan, dim)
    number = to_arrow_type(first.schema["class"].dataType)
    found_types = pa.schema([("class", number), ("other", number), ("s", pa.float32())])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        """Questions against the vectors of one part of a bucket, in slices: the best of each question, with all that
        may be as good."""
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            a, b = _coded(left["u"]), _coded(right["u"])
            own, other = left["class"].to_numpy(), right["class"].to_numpy()
            order = np.argsort(other)
            b, other = np.ascontiguousarray(b[order].T), other[order]
            for lo in range(0, len(a), 1024):
                s, mine = a[lo : lo + 1024] @ b, own[lo : lo + 1024]
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                same = np.flatnonzero(other[at] == mine)
                s[same, at[same]] = -9
                low = np.full(len(s), max(least, -2.0) - SLACK, np.float32)
                if least > -1:  # few are near enough: one pass over all finds them
                    r, c = np.divmod(np.flatnonzero(s.ravel() >= low[0]), s.shape[1])
                    many = np.flatnonzero(np.bincount(r, minlength=len(s)) > k)
                    if len(many):
                        low[many] = np.maximum(low[many], np.partition(s[many], -k, axis=1)[:, -k] - SLACK)
                        near = s[r, c] >= low[r]
                        r, c = r[near], c[near]
                else:
                    if s.shape[1] > k:
                        low = np.maximum(low, np.partition(s, -k, axis=1)[:, -k] - SLACK)
                    r, c = np.nonzero(s >= low[:, None])
                out.append((mine[r], other[c], s[r, c]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found_types)], schema=found_types)

    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = asks.repartition(parts, "place").groupBy("place").cogroup(held.repartition(parts, "place").groupBy("place")).applyInArrow(rank, f"class {kind}, other {kind}, s float")
    # the order is made in double from the vectors themselves
    pairs = found.repartition("class").groupBy("class", "other").agg(F.max("s").alias("s"))
    kth = F.nth_value("s", k).over(W.partitionBy("class").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    few = cut(pairs.withColumn("kth", kth).filter(F.col("kth").isNull() | (F.col("s") >= F.col("kth") - SLACK)).select("class", "other"))
    exact = rows.select(F.col("id").alias("class"), "v")
    if few.count() <= SMALL:
        exact = exact.join(F.broadcast(few.select("class").union(few.select("other")).distinct()), "class", "left_semi")
        few = F.broadcast(few)
    scaled = let(F.array_max(F.transform("v", lambda x: F.abs(x))), lambda m: F.transform("v", lambda x: x / m))
    exact = exact.select("class", scaled.alias("v"))
    exact = exact.select("class", let(norm(F.col("v")), lambda n: F.transform("v", lambda x: x / n)).alias("v"))
    both = exact.join(few, "class").join(exact.select(F.col("class").alias("other"), F.col("v").alias("w")), "other")
    both = both.select("class", "other", F.round(dot(F.col("v"), F.col("w")), 12).alias("s")).groupBy("class", "other").agg(F.max("s").alias("s")).filter(F.col("s") >= least)
    return _expand(both, members, k, asking)


def _expand(pairs: DataFrame, members: DataFrame, k: int, asking: DataFrame | None) -> DataFrame:
    """From classes to rows: each row's first k among its own copies and the first copies of each neighbouring class
    (k + 1 of them are enough). ``members``: the rows of classes of several; any other class is a row itself."""
    members = F.broadcast(members) if members.count() <= SMALL else members
    copies = members.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("id"))).filter(F.col("r") <= k + 1)
    copies = copies.groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    own = members.join(copies, "class").select("id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("s")).filter(F.col("id") != F.col("neighbour"))
    away = pairs.join(members.filter(F.col("copies") > k).select("class"), "class", "left_anti").join(members.select("id", "class"), "class", "left")
    away = away.join(copies.withColumnRenamed("class", "other"), "other", "left")
    away = away.select(F.coalesce("id", "class").alias("id"), F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"), "s")
    both = own.unionByName(away)
    both = both if asking is None else both.join(asking.select("id"), "id", "left_semi")
    order = W.partitionBy("id").orderBy(F.desc("s"), "neighbour")
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("id", "neighbour", "rank", F.col("s").alias("similarity"))


def similar_pairs(rows: DataFrame, k: int = 5, least: float = 0.9, plan: Plan | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of at least ``least`` cosine similarity of which one is among the k most
    similar of the other; each pair once."""
    n = neighbours(rows, k, plan, least=least)
    return n.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
