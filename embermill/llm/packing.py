"""Filling containers of fixed capacity by vector best fit.

An item takes tokens, one place among the container's documents, and attention cost (the square of its tokens). It
goes to the open container that it fits under all three capacities and that it leaves with the least weighted norm of
what remains (or, by the other rule, whose remaining space points most its way). Items are taken by falling size.

Shards of bounded size are packed side by side; then, round by round, the emptiest containers of all shards are opened
again and their items packed together, until one shard is left, so the waste of many shards isn't added up."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embermill.session import cut

SHARD_ITEMS = 16_000
REOPEN = 8  # a round opens the emptiest containers up to one item in so many
WEIGHTS = (1.0, 0.05, 0.05)  # tokens, documents, attention cost


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The container number of each size; the sizes must be in falling order, none above the capacity."""
    n = len(sizes)
    out = np.empty(n, np.int64)
    tokens, docs, cost, number = np.empty(n, np.float64), np.empty(n, np.float64), np.empty(n, np.float64), np.empty(n, np.int64)
    wt, wd, wc = weights[0] / max(capacity, 1) ** 2, weights[1] / max(max_docs, 1) ** 2, weights[2] / max(max_cost, 1.0) ** 2
    least = np.minimum.accumulate(sizes[::-1])[::-1]  # of this and all later items
    top = opened = 0
    for i in range(n):
        s = float(sizes[i])
        if i % 256 == 0 and top:
            live = (tokens[:top] >= least[i]) & (docs[:top] >= 1)
            k = int(live.sum())
            for a in (tokens, docs, cost, number):
                a[:k] = a[:top][live]
            top = k
        best = -1
        if top:
            fits = np.flatnonzero((tokens[:top] >= s) & (docs[:top] >= 1) & (cost[:top] >= s * s))
            if len(fits):
                t, d, c = tokens[fits], docs[fits], cost[fits]
                if rule == "norm":
                    score = wt * (t - s) ** 2 + wd * (d - 1) ** 2 + wc * (c - s * s) ** 2
                else:
                    score = -(wt * t * s + wd * d + wc * c * s * s) / np.sqrt(wt * t * t + wd * d * d + wc * c * c + 1e-30)
                best = int(fits[np.argmin(score)])
        if best < 0:
            best = top
            tokens[top], docs[top], cost[top], number[top] = capacity, max_docs, max_cost, opened
            top += 1
            opened += 1
        tokens[best] -= s
        docs[best] -= 1
        cost[best] -= s * s
        out[i] = number[best]
    return out


def pack(items: DataFrame, containers: DataFrame, id: str = "doc_id", size: str = "n_tokens", max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every item in one container of each kind of ``containers`` (container, capacity_tokens).

    Columns: container, bin, ``id``, piece, start, n_tokens. An item that no container holds, for its tokens or its
    attention cost, is cut into pieces as large as one holds, each with a container to itself, and one rest, which is
    packed like an item; no other item is cut. Null and negative sizes count as 0; items of size 0 take a place but no
    tokens. The limits ``max_docs`` and ``max_cost`` hold for every kind, those of columns with these names in
    ``containers`` for theirs; without any, a container takes as many documents as tokens and the square of its tokens
    in cost, which binds no items that have tokens. Rows with equal ids are separate items, ties of size go by id.
    Kinds without name or positive capacity are left out; empty tables give no rows."""
    spark, kind = items.sparkSession, dict(items.dtypes)[id]
    sized = cut(items.select(F.col(id).alias("id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size")))
    limits = {}
    for r in containers.collect():  # the settings
        r = r.asDict()
        if r["container"] is not None and (r["capacity_tokens"] or 0) > 0:
            cap = int(r["capacity_tokens"])
            limits[r["container"], cap] = max(1, int(r.get("max_docs") or max_docs or cap)), max(1.0, float(r.get("max_cost") or max_cost or float(cap) ** 2))
    kinds = sorted((c, cap, min(cap, math.isqrt(int(cost)))) for (c, cap), (_, cost) in limits.items())
    if not kinds:
        return spark.createDataFrame([], T.StructType.fromDDL(f"container string, bin string, {id} {kind}, piece int, start bigint, n_tokens bigint"))
    each = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("bigint").alias("capacity"), F.lit(k).cast("bigint").alias("largest")) for c, n, k in kinds])
    # rows are told apart by number, not id: of one id (or none) there may be any number
    both = sized.select("id", "size", F.monotonically_increasing_id().alias("row"), F.inline(each))
    over, full = F.col("size") > F.col("largest"), F.floor(F.col("size") / F.col("largest")).cast("int")
    cuts = both.filter(over).withColumn("pieces", full)
    whole = cuts.select("container", "largest", "row", "id", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    whole = whole.select("container", F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("piece").cast("string")).alias("bin"), "id", "piece", (F.col("piece") * F.col("largest")).alias("start"), F.col("largest").alias("size"))
    rest = F.when(over, F.col("size") % F.col("largest")).otherwise(F.col("size"))
    piece = F.when(over, full).otherwise(0)
    todo = both.filter(~over | (rest > 0)).select("container", "capacity", "row", "id", piece.alias("piece"), (piece * F.col("largest")).alias("start"), rest.alias("size"))

    schema = f"container string, capacity bigint, row bigint, bin string, id {kind}, piece int, start bigint, size bigint, again boolean"

    def packed(level: int, reopen: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "id", "row"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            cap = int(pdf["capacity"].iloc[0])
            sizes = pdf["size"].to_numpy()
            bins = best_fit(sizes, cap, *limits[pdf["container"].iloc[0], cap], rule)
            fill = np.bincount(bins, weights=sizes)
            held = np.bincount(bins)
            again = np.zeros(len(fill), bool)
            if reopen:
                order = np.argsort(fill, kind="stable")
                again[order[np.cumsum(held[order]) <= len(pdf) / reopen]] = True
                again &= fill < cap
            pdf["bin"] = [f"{level}-{s}-{b}" for s, b in zip(pdf["shard"], bins)]
            pdf["again"] = again[bins]
            return pdf[[c.split()[0] for c in schema.split(", ")]]

        return one

    n = max(sized.count(), 1)
    out, level = whole, 0
    while True:
        shards = max(1, math.ceil(n / shard_items))
        reopen = REOPEN if shards > 1 else 0
        sharded = todo.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(shards)).cast("int"))
        done = cut(sharded.repartition(max(2, min(shards * 2, 4000)), "container", "shard").groupBy("container", "shard").applyInPandas(packed(level, reopen), schema))
        out = out.unionByName(done.filter(~F.col("again")).select("container", "bin", "id", "piece", "start", "size"))
        if shards == 1:
            break
        todo = done.filter("again").select("container", "capacity", "row", "id", "piece", "start", "size")
        n, level = math.ceil(n / REOPEN), level + 1
    return out.withColumnsRenamed({"id": id, "size": "n_tokens"})
