"""A varied subset by tournament-pivoted rank-revealing QR with deflated rounds.

Records are the rows of a matrix of features: a record's similarities to the landmarks, a bounded sample of the records,
each landmark divided by the root of its number of similar records (over all data). So a row of a group weighs much, a
row that stands only for itself little, and a large group no more than a small one. (The features are folded into
``WIDTH`` columns by random signs, which keeps lengths and angles; the vector itself is appended with a small weight.)

In a round every block of rows nominates those that QR with pivoting picks, one after the other the row with the
largest part outside the span of those picked; nominations meet pairwise in a tree, where the union is pivoted again,
until one set is left. Between rounds every row is deflated by its similarity to the picked rows. Blocks are made by a
hash of the id, so the result is a function of the data, not of how they lie in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embermill.operators.library import placed
from embermill.session import cut, share

ROUND = 256  # picks of one round
BLOCK, TREE = 4096, 8  # rows of a block; sets that meet, pair by pair, in one task
LANDMARKS, WIDTH = 4096, 1024
TELLS = 0.3  # cosine below which two records have nothing in common
OWN = 0.05  # squared weight of the vector itself, where a landmark without similar records has about 1
POOL = 512
ZERO = 1e-5


def pivoted(rows: np.ndarray, weight: np.ndarray, most: int) -> list[int]:
    """The rows that QR with pivoting picks, in order. The pivot is the largest weighted part outside the span of the
    picked rows; ties go to the first.

    Parts only shrink, so the rows with the largest ones are pivoted among themselves until the next would fall behind
    a row outside; then all rows are brought up to date at once."""
    left = rows * weight[:, None].astype(rows.dtype)
    size = np.einsum("ij,ij->i", left, left)
    picked: list[int] = []
    while len(picked) < min(most, len(rows)):
        pool = np.sort(np.argsort(-size, kind="stable")[:POOL])
        outside = np.delete(size, pool).max(initial=0.0)
        part, here, basis = left[pool].copy(), size[pool].copy(), []
        while len(picked) < most:
            i = int(np.argmax(np.round(here, 6)))
            if here[i] <= ZERO or (basis and here[i] < outside):
                break
            q = part[i] / np.linalg.norm(part[i])
            part -= np.outer(part @ q, q)
            here = np.einsum("ij,ij->i", part, part)
            basis.append(q)
            picked.append(int(pool[i]))
            here[np.isin(pool, picked)] = -1
        if not basis:
            break
        q = np.array(basis)
        left -= (left @ q.T) @ q
        size = np.einsum("ij,ij->i", left, left)
        size[picked] = -1
    return picked


@dataclass
class _Features:
    """What turns unit vectors into feature rows."""

    landmarks: np.ndarray  # unit vectors, dim x landmarks, in the order of their columns
    scale: np.ndarray  # of each landmark, with its random sign
    starts: np.ndarray  # where the landmarks of each column begin
    tells: float

    def similar(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.clip((x @ to - self.tells) * (1 / (1 - self.tells)), 0, 1)

    def rows(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.starts) + x.shape[1]), np.float32)
        for lo in range(0, len(x), 1024):
            part = self.similar(x[lo : lo + 1024], self.landmarks) * self.scale
            out[lo : lo + 1024, : len(self.starts)] = np.add.reduceat(part, self.starts, axis=1)
        out[:, len(self.starts) :] = OWN**0.5 * x
        return out

    def weights(self, x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """What is left of each row beside its most similar chosen one."""
        near = np.zeros(len(x), np.float32)
        for lo in range(0, len(chosen), 1024):
            near = np.maximum(near, self.similar(x, chosen[lo : lo + 1024].T).max(1))
        return 1 - near


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _features(units: DataFrame, tells: float, landmarks: int) -> _Features:
    """The landmarks, by a hash of the id, and how many records of all are similar to each."""
    some = units.orderBy(F.xxhash64("id"), "id").select("x").limit(landmarks).toArrow()
    marks = np.ascontiguousarray(_matrix(some["x"]).T)
    rng = np.random.default_rng(11)
    columns = np.arange(marks.shape[1]) if marks.shape[1] <= WIDTH else rng.integers(0, WIDTH, marks.shape[1])
    order = np.argsort(columns, kind="stable")
    marks, columns = np.ascontiguousarray(marks[:, order]), columns[order]
    f = _Features(marks, np.ones(len(columns), np.float32), np.unique(columns, return_index=True)[1], tells)
    shared = share(units.sparkSession, f)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, total, n = shared(), 0.0, 0
        for b in it:
            for lo in range(0, b.num_rows, 2048):
                total = total + g.similar(_matrix(b.column(0).slice(lo, 2048)), g.landmarks).sum(0, dtype=np.float64)
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["mark", "similar", "n"])

    found = units.select("x").mapInArrow(sums, "mark bigint, similar double, n bigint").groupBy("mark").agg(F.round(F.sum("similar"), 3).alias("similar"), F.sum("n").alias("n")).orderBy("mark").toArrow()
    degree = found["similar"].to_numpy()
    usual = min(float(np.median(degree)), 0.01 * found["n"][0].as_py())
    sign = np.ones(len(columns)) if len(columns) <= WIDTH else rng.choice([-1.0, 1.0], len(columns))
    f.scale = (sign * np.sqrt((usual + 1) / (degree + usual))).astype(np.float32)
    return f


def varied(rows: DataFrame, n: int, tells: float = TELLS, landmarks: int = LANDMARKS) -> DataFrame:
    """(rank, id): ``n`` different rows in the order of picking, or all where there are no more; the first m of them
    are the subset of size m.

    ``rows``: id and v (array<double>), usable vectors of one length; of rows with one id the first vector counts. Once
    everything left is a multiple of a picked row, the lowest ids follow. The picked ids and vectors, n rows, and
    ``landmarks`` vectors are held by the driver and sent to every task; if n reaches the number of rows, nothing is
    picked and all are returned by id."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["id"]
    out = T.StructType.fromDDL(f"rank int, id {kind}")
    if n <= 0:
        return spark.createDataFrame([], out)
    total = rows.select("id").distinct().count()
    if n >= total:
        return placed(rows.select("id").distinct(), [F.col("id")], "rank").select(F.col("rank").cast("int").alias("rank"), "id")
    units = _units(rows, kind, -(-total // BLOCK))
    features = _features(units, tells, landmarks)
    ids: list = []
    chosen = np.zeros((0, 0), np.float32)
    while len(ids) < n:
        got = _tournament(units, kind, features, ids, chosen, min(ROUND, n - len(ids)))
        if not got:
            break
        ids += [i for i, _ in got]
        new = np.array([v for _, v in got])
        chosen = new if not len(chosen) else np.vstack([chosen, new])
    if len(ids) < n:
        taken = spark.createDataFrame([(i,) for i in ids], f"id {kind}")
        rest = units.select("id").join(F.broadcast(taken), "id", "left_anti").orderBy("id").limit(n - len(ids))
        ids += [r["id"] for r in rest.collect()]
    return spark.createDataFrame([(k + 1, i) for k, i in enumerate(ids)], out)


def _units(rows: DataFrame, kind: str, blocks: int) -> DataFrame:
    """(block, id, x): the vectors at length 1 in single precision, each id once; the rows of a block lie together."""

    def scaled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                x = x / np.abs(x).max(1, keepdims=True)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    def once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in it:
            ids = b.column(1).to_pylist()
            keep = [i != before for i, before in zip(ids, [last, *ids])]
            last = ids[-1] if ids else last
            yield b.filter(pa.array(keep, pa.bool_()))

    placed_in = rows.select("id", "v").mapInArrow(scaled, f"id {kind}, x binary").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "x")
    parts = max(1, min(blocks, 20_000))
    return cut(placed_in.repartition(parts, "block").sortWithinPartitions("block", "id", "x").mapInArrow(once, f"block int, id {kind}, x binary"))


def _tournament(units: DataFrame, kind: str, features: _Features, ids: list, chosen: np.ndarray, most: int) -> list[tuple]:
    """One round: the picked (id, unit vector) in order."""
    shared = share(units.sparkSession, (features, set(ids), chosen))
    shape = f"slot int, place int, id {kind}, x binary"

    def play(held: tuple, ids: pa.Array, x: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The best of some rows, taken in the order of their ids."""
        f, taken, picked = held
        order = pa.array(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"))
        ids, x = ids.take(order), x.take(order)
        v = _matrix(x)
        w = f.weights(v, picked) if len(picked) else np.ones(len(v), np.float32)
        if taken:
            w[[i in taken for i in ids.to_pylist()]] = 0
        best = pa.array(pivoted(f.rows(v), w, most), pa.int64())
        return ids.take(best), x.take(best)

    def batch(slot: int, ids: pa.Array, x: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), slot, np.int32)), pa.array(np.arange(len(ids), dtype=np.int32)), ids, x], ["slot", "place", "id", "x"])

    def nominate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, have = shared(), None, []
        for b in it:
            of = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if have and of[lo] != block:
                        yield batch(block, *play(held, *_joined(have)))
                        have = []
                    block = int(of[lo])
                    have.append((b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)))
        if have:
            yield batch(block, *play(held, *_joined(have)))

    def meet(table: pa.Table) -> pa.Table:
        held = shared()
        table = table.combine_chunks()
        slots = table["slot"].to_numpy()
        sets = []
        for s in sorted(set(slots.tolist())):
            part = table.filter(pa.array(slots == s))
            sets.append((part["id"].combine_chunks(), part["x"].combine_chunks()))
        while len(sets) > 1:  # pair by pair
            sets = [play(held, *_joined(sets[k : k + 2])) if k + 1 < len(sets) else sets[k] for k in range(0, len(sets), 2)]
        return pa.Table.from_batches([batch(int(slots[0]) // TREE, *sets[0])])

    level = units.mapInArrow(nominate, shape)
    width = units.select(F.max("block")).first()[0] + 1
    while width > 1:
        level = level.withColumn("_meet", (F.col("slot") / TREE).cast("int")).groupBy("_meet").applyInArrow(lambda t: meet(t.drop_columns(["_meet"])), shape)
        width = -(-width // TREE)
    last = level.orderBy("place").toArrow()
    return list(zip(last["id"].to_pylist(), _matrix(last["x"]))) if last.num_rows else []


def _joined(parts: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, pa.Array]:
    ids, x = (pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in column]) for column in zip(*parts))
    return ids, x
