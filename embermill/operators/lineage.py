"""Bounded walks along parent pointers. Every hop is an equi-join, so nodes are never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(node, ancestor, hop), hop from 1 to ``hops``: each ancestor at its least distance. A node may have several
    parents; cycles end by the bound. Nodes without edges have no rows."""
    e = edges.filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("child", "parent").distinct()
    line = start.select("node", F.array("node").alias("path"))
    for _ in range(hops):
        # one join for each hop; a path that has ended meets no edge again
        line = line.join(e, F.element_at("path", -1) == F.col("child"), "left").select("node", F.when(F.col("parent").isNotNull(), F.concat("path", F.array("parent"))).otherwise(F.col("path")).alias("path"))
    up = line.select("node", F.posexplode("path").alias("hop", "ancestor")).filter("hop > 0")
    return up.groupBy("node", "ancestor").agg(F.min("hop").alias("hop"))


def root_with(start: DataFrame, edges: DataFrame, fit: DataFrame, tested: int = 5) -> DataFrame:
    """(node, root): the first of a node itself and its ancestors that is in ``fit`` (node), testing ``tested`` nodes
    in all; null where none is, or a pointer dangles before."""
    up = ancestors(start, edges, tested - 1)
    line = start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hop")).unionByName(up)
    ok = line.join(fit.select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_semi")
    root = ok.groupBy("node").agg(F.min_by("ancestor", "hop").alias("root"))
    return start.select("node").distinct().join(root, "node", "left")


def inherit(start: DataFrame, edges: DataFrame, values: DataFrame, hops: int = 5) -> DataFrame:
    """(node, value, origin): a node's own value of ``values`` (node, value), else that of its nearest ancestor."""
    line = start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hop")).unionByName(ancestors(start, edges, hops))
    v = values.filter(F.col("value").isNotNull()).select(F.col("node").alias("ancestor"), "value")
    got = line.join(v, "ancestor").groupBy("node").agg(F.min(F.struct("hop", "ancestor", "value")).alias("s"))
    return start.select("node").distinct().join(got, "node", "left").select("node", F.col("s.value").alias("value"), F.col("s.ancestor").alias("origin"))


def climb_while(start: DataFrame, edges: DataFrame, kinds: DataFrame, kind: str, hops: int = 5) -> DataFrame:
    """(node, ancestor): up from each node for as long as the node reached is of ``kind``, at most ``hops`` steps."""
    e = edges.filter(F.col("parent").isNotNull()).select("child", "parent").join(kinds.filter(F.col("kind") == kind).select(F.col("node").alias("child")), "child", "left_semi")
    line = start.select("node", F.col("node").alias("ancestor")).distinct()
    for _ in range(hops):
        line = line.join(e, F.col("ancestor") == F.col("child"), "left").select("node", F.coalesce("parent", "ancestor").alias("ancestor"))
    return line
