"""Analytics of the image library: ranking, Pareto layers, quantile bands, novelty, retention, incremental work."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from embermill.session import cut

# Which file names belong to which bucket; the first prefix that fits counts.
BUCKETS = (("anarchy_", "generated"), ("temperature_sweep", "temperature"), ("sampler_sweep", "sampler"), ("mined_marginals", "marginals"))
FIRST_STAR, SMALLEST_SCORE = 80, 5.0
SLOT = 0.001  # relative width of the slots of ``index_quantiles``
MOST_KEYS = 64  # keyframes of a film


def bucket_of(name: Column) -> Column:
    """The gallery's bucket of a file name; null for names of no bucket, which the gallery doesn't show."""
    c = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, bucket in BUCKETS:
        c = c.when(name.startswith(prefix), bucket)
    return c


def gallery(items: DataFrame, **caches: DataFrame) -> DataFrame:
    """Items left-joined by rel with caches of (rel, value), each under its name. Caches grow with the gallery, so the
    planner chooses how to join by their measured size."""
    for name, cache in caches.items():
        items = items.join(cache.select("rel", F.col("value").alias(name)), "rel", "left")
    return items


def newest_per_bucket(items: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest of each bucket with their rank; ties by rel. The rank filter limits each task's rows before
    the shuffle."""
    w = W.partitionBy("bucket").orderBy(F.col("mtime").desc_nulls_last(), "rel")
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_rated(items: DataFrame, n: int = FIRST_STAR) -> DataFrame:
    return items.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "rel").limit(n)


def resort(items: DataFrame, key: str) -> DataFrame:
    """``place`` of each item in one of the client's orders: nulls last, ties by mtime (newest) and rel.

    A total order of all items is what is asked for: a range-partitioned sort, then each row's place from the sizes of
    the ranges before it; no single-task window."""
    orders = {"new": [F.col("mtime").desc_nulls_last()], "score": [F.coalesce("score", F.lit(-1.0)).desc()], "far": [F.coalesce("dist", F.lit(-1.0)).desc()], "near": [F.coalesce("dist", F.lit(1e9)).asc()], "nov": [F.coalesce("nov", F.lit(-1.0)).desc()], "res": [F.coalesce("res", F.lit(-1.0)).desc()]}
    if key not in orders:
        raise ValueError(f"unknown order {key!r}")
    return placed(items, [*orders[key], F.col("mtime").desc_nulls_last(), F.col("rel").asc()])


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their 1-based place in a total order, without bringing them into one task."""
    s = cut(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    s = s.withColumn("_i", F.col("_i").bitwiseAND((1 << 33) - 1))
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per task
    return s.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn(name, F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")


def rated(items: DataFrame) -> DataFrame:
    """Items fit for the frontier, with ``r``: the resonance, or where that is missing or 0 the score, to be eligible;
    a resonance of 0 ranks as 0."""
    ok = F.col("nov").isNotNull() & ((F.col("res").isNotNull() & (F.col("res") != 0)) | F.col("score").isNotNull())
    return items.filter(ok).withColumn("r", F.coalesce("res", "score"))


def pareto_front(items: DataFrame) -> DataFrame:
    """The first layer: no item of higher (or equal, earlier) novelty has an r as large.

    Every task first keeps its own front, which holds all rows of the whole front; only these meet."""

    def front(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["nov", "rel"], ascending=[False, True], kind="stable")
        return rows[rows["r"] > rows["r"].cummax().shift(fill_value=-np.inf)]

    def local(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _folded(it, front)

    return _front(items.select("rel", "nov", "r").mapInPandas(local, "rel string, nov double, r double")).filter("front").drop("front")


def _folded(it: Iterator[pd.DataFrame], keep, least: int = 50_000) -> Iterator[pd.DataFrame]:
    """What ``keep`` leaves of all rows of a task. New rows are taken in when they are as many as those kept, so the
    work stays near linear even where most rows are kept."""
    kept, waiting, n = None, [], 0
    for pdf in it:
        waiting.append(pdf)
        n += len(pdf)
        if n >= max(least, 0 if kept is None else len(kept)):
            kept, waiting, n = keep(pd.concat(waiting if kept is None else [kept, *waiting])), [], 0
    if waiting:
        kept = keep(pd.concat(waiting if kept is None else [kept, *waiting]))
    if kept is not None:
        yield kept


def _front(rows: DataFrame) -> DataFrame:
    """Rows with whether they are on the front: r above the running maximum in the order of falling novelty. The
    maximum runs in the ranges of a sort and, by a row for each range, between them."""
    s = cut(rows.orderBy(F.desc("nov"), "rel").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    tops = s.groupBy("_p").agg(F.max("r").alias("_m"))
    before = tops.select("_p", F.max("_m").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    here = F.max("r").over(W.partitionBy("_p").orderBy("_i").rowsBetween(W.unboundedPreceding, -1))
    top = F.greatest(here, F.col("_before"))
    s = s.join(F.broadcast(before), "_p")
    return s.withColumn("_top", top).withColumn("front", F.col("_top").isNull() | (F.col("r") > F.col("_top"))).drop("_p", "_i", "_m", "_before", "_top")


def pareto_layers(items: DataFrame, most: int = 120, one_task: int = 500_000) -> DataFrame:
    """(rel, nov, r, layer): layers peeled one after the other until ``most`` items are shown, by layer, r falling,
    novelty and rel.

    In the order of falling novelty a row joins the first layer whose greatest r is below its own, which a binary
    search finds. A row's layer among some rows is never above that among all, and no layer is empty, so rows of
    layer ``most`` or more in their own task can't be shown and are left there. What is left meets in one task, or, if
    it is more than ``one_task`` rows (very wide layers), is peeled layer by layer in parallel."""

    def layers(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["nov", "rel"], ascending=[False, True], kind="stable").reset_index(drop=True)
        tops: list[float] = []  # negated, so they rise
        out = []
        for r in pdf["r"]:
            at = bisect.bisect_right(tops, -r)
            # tops hold -max r of each layer, rising; the first layer with max r < r
            if at == len(tops):
                tops.append(-r)
            else:
                tops[at] = -r
            out.append(at)
        return pdf.assign(layer=np.array(out, "int32"))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = layers(rows)
        return rows.loc[rows["layer"] < most, ["rel", "nov", "r"]]

    def local(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _folded(it, first)

    few = cut(items.select("rel", "nov", "r").mapInPandas(local, "rel string, nov double, r double"))
    if few.count() <= one_task:
        whole = few.groupBy().applyInPandas(lambda pdf: layers(pdf), "rel string, nov double, r double, layer int")
    else:
        whole, shown, layer = None, 0, 0
        while shown < most:
            f = cut(_front(few))
            this = f.filter("front").drop("front").withColumn("layer", F.lit(layer))
            n = this.count()
            if not n:
                break
            whole = this if whole is None else whole.unionByName(this)
            few, shown, layer = f.filter("not front").drop("front"), shown + n, layer + 1
    return whole.orderBy("layer", F.desc("r"), F.desc("nov"), "rel").limit(most)


def index_quantiles(df: DataFrame, keys: list[str], value: str, digits: int = 2) -> DataFrame:
    """(keys, n, mean to ``digits``, lo, hi): values of the raw ranks n // 4 and 3n // 4 (not interpolated), without
    nulls.

    No group is gathered: values are counted once each, and the ranks found on running counts, first over logarithmic
    slots of a fixed relative width (so that wild values leave the others apart), then within the slots that hold a
    wanted rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    stats = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), digits).alias("mean"))
    x = F.col(value)
    slot = F.when(x == 0, 0).otherwise(F.signum(x).cast("int") * (F.ceil(F.log(F.abs(x)) / SLOT).cast("int") + 1_000_000))
    counts = counts.withColumn("_s", slot)
    w = W.partitionBy(*keys).orderBy("_s")  # a bounded number of slots
    slots = counts.groupBy(*keys, "_s").agg(F.sum("c").alias("_m")).withColumn("_end", F.sum("_m").over(w)).join(stats, keys)
    lo, hi = F.floor(F.col("n") / 4), F.floor(3 * F.col("n") / 4)
    start = F.col("_end") - F.col("_m")
    held = [(start <= r) & (r < F.col("_end")) for r in (lo, hi)]
    slots = slots.filter(held[0] | held[1]).select(*keys, "_s", "n", "mean", start.alias("_before"))
    at = counts.join(slots, [*keys, "_s"]).withColumn("_upto", F.sum("c").over(W.partitionBy(*keys, "_s").orderBy(value)) + F.col("_before"))
    hit = lambda rank: F.min(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("c") <= rank), x))
    return at.groupBy(*keys, "n", "mean").agg(hit(lo).alias("lo"), hit(hi).alias("hi"))


def novelty(vectors: DataFrame, asking: DataFrame | None = None, block: int = 16_384) -> DataFrame:
    """(id, novelty): 1 less the largest cosine to any other vector (by id), 4 digits; nothing for fewer than two.

    Exact and in blocks: rows are put into blocks by a hash, every pair of blocks meets in one task as a product of
    two matrices, taken in slices of 2,048 rows. Work grows with the square, as the definition does, and what is moved
    with the number of blocks; ``asking`` limits the asking side (a stated query set)."""
    v = cut(vectors.select("id", F.col("e").cast("array<double>").alias("e")))
    n = v.count()
    if n < 2:
        return v.limit(0).select("id", F.lit(0.0).alias("novelty"))
    blocks = max(min(4, -(-n // 256)), -(-n // block))
    kind = dict(vectors.dtypes)["id"]
    b = v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def packed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("block").agg(F.collect_list(F.struct("id", "e")).alias("p")).select("block", F.col("p.id").alias("ids"), F.flatten("p.e").alias("m"))  # about `block` rows each

    q = packed(b if asking is None else b.join(asking.select("id"), "id", "left_semi"))
    q = q.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = q.join(packed(b).select(F.col("block").alias("to"), F.col("ids").alias("ids2"), F.col("m").alias("m2")), "to")

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda m, k: (x := np.asarray(m, float).reshape(k, -1)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        for pdf in it:
            for r in pdf.itertuples():
                i, j = np.asarray(r.ids), np.asarray(r.ids2)
                x, y = unit(r.m, len(i)), unit(r.m2, len(j)).T
                for lo in range(0, len(i), 2048):
                    s = x[lo : lo + 2048] @ y
                    s[i[lo : lo + 2048, None] == j[None, :]] = -np.inf
                    yield pd.DataFrame({"id": i[lo : lo + 2048], "s": s.max(1)})

    spread = pairs.select("ids", "m", "ids2", "m2").repartition(max(2, min(blocks * blocks, 4000)))
    top = spread.mapInPandas(best, f"id {kind}, s double").groupBy("id").agg(F.max("s").alias("s"))
    return top.select("id", F.round(1 - F.col("s"), 4).alias("novelty"))


def nearest_token(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(q, token): the vocabulary row of the largest dot product with each query row, ties to the lowest id.

    The queries are a stated, short set (tokens of one prompt) and are broadcast in one row; the vocabulary is read
    once, each task keeps its best."""
    packed = queries.agg(F.sort_array(F.collect_list(F.struct("q", "e"))).alias("qs"))

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict = {}
        for pdf in it:
            if not len(pdf):
                continue
            q = [x["q"] for x in pdf["qs"].iloc[0]]
            a = np.array([x["e"] for x in pdf["qs"].iloc[0]])
            s = a @ np.stack(pdf["e"].to_numpy()).T
            ids = pdf["id"].to_numpy()
            for k, row in zip(q, s):
                m = row.max()
                i = ids[np.isclose(row, m, rtol=0, atol=1e-12)].min()
                if k not in top or (m, -i) > (top[k][0], -top[k][1]):
                    top[k] = (m, i)
        if top:
            yield pd.DataFrame({"q": list(top), "s": [t[0] for t in top.values()], "id": [t[1] for t in top.values()]})

    kinds = dict(queries.dtypes)["q"], dict(vocabulary.dtypes)["id"]
    found = vocabulary.select("id", F.col("e").cast("array<double>").alias("e")).crossJoin(F.broadcast(packed)).mapInPandas(best, f"q {kinds[0]}, s double, id {kinds[1]}")
    return found.groupBy("q").agg(F.max(F.struct(F.round("s", 10).alias("s"), (-F.col("id")).alias("i"))).alias("m")).select("q", (-F.col("m.i")).alias("token"))


def protected(favorites: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """(rel): favorites and their ancestors up to ``hops`` edges (child, parent) away."""
    from embermill.operators.lineage import ancestors

    up = ancestors(favorites.select(F.col("rel").alias("node")), edges, hops).select(F.col("ancestor").alias("rel"))
    return favorites.select("rel").union(up).distinct()


def wipe_candidates(scores: DataFrame, keep: DataFrame, least: float = SMALLEST_SCORE) -> DataFrame:
    """Scored items below ``least`` that aren't protected."""
    return scores.filter(F.col("score").isNotNull() & (F.col("score") < least)).join(keep, "rel", "left_anti")


def keyframe_tensors(vectors: DataFrame, keys: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """(key, missing, e): for each keyframe the wanted tensors' vectors by name, and the names of those it lacks. Only
    the wanted tensors are read. ``vectors``: (key, tensor, e). More than 64 keyframes are an error."""
    keys = cut(keys.select("key"))
    if keys.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keyframes")
    got = vectors.filter(F.col("tensor").isin(*wanted)).join(F.broadcast(keys), "key", "left_semi")
    have = got.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("tensor", "e"))).alias("e"))
    out = keys.join(have, "key", "left")
    names = F.array(*[F.lit(t) for t in wanted])
    return out.select("key", F.array_except(names, F.coalesce(F.map_keys("e"), F.array().cast("array<string>"))).alias("missing"), "e")


def incremental(todo: DataFrame, done: DataFrame, key: str, work) -> DataFrame:
    """What is done already, and ``work`` on the rest: nothing is computed twice, and a repeated run adds nothing."""
    return done.unionByName(work(todo.join(done.select(key), key, "left_anti")))


def films(videos: DataFrame, manifests: DataFrame) -> DataFrame:
    """The films, newest first: ``videos`` (dir, name, mtime, size), each with its folder's manifest (dir, text of
    film.json; repeated ones count once), whose fields are null where it is missing or no JSON."""
    fields = "frames int, fps double, refine string, interp string, easing string, loop boolean, backend string, duration double, keyframes array<string>"
    parsed = F.from_json("text", f"{fields}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    m = manifests.groupBy("dir").agg(F.min("text").alias("text")).select("dir", parsed.alias("m"))
    known = [F.when(F.col("m._broken").isNull(), F.col(f"m.{f.split()[0]}")).alias(f.split()[0]) for f in fields.split(", ")]
    return videos.join(m, "dir", "left").select("dir", "name", "mtime", "size", *known).orderBy(F.desc("mtime"), "dir", "name")
