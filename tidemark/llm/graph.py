"""Connected components without collecting links: alternating large and small stars, each round a table.

Edges are first dealt to tasks of CHUNK, each of which puts the stars of its own components in their place, again as long
as that halves them; rounds of stars join what several tasks hold. A component ends as a star, whose centre neighbours
all its nodes. The neighbours of a node with more than HOT are dealt to several tasks, each of which gets a copy of the
node's row.

Defined cases: an edge of a node with itself, or with a null end, makes no component; repeated edges count once; no
edges give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, small, written

HOT = 512
#: Edges that one task turns into stars before the rounds: 1 MB, whatever the number of edges.
CHUNK = 1 << 16


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def _salted(rows: DataFrame, nodes: DataFrame, hot: int) -> DataFrame:
    """rows (a, b) with m of their node a (u, m, n): nodes of more than hot rows go in parts."""
    crowded = nodes.where(F.col("n") > hot).select("u", F.ceil(F.col("n") / F.lit(hot)).cast("int").alias("parts"))
    if crowded.isEmpty():
        return rows.join(nodes, F.col("a") == F.col("u")).select("a", "b", "m")
    crowded = small(crowded)
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(crowded.withColumnRenamed("u", "h"), F.col("a") == F.col("h"), "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    copies = nodes.join(crowded, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("of"))
    return dealt.join(copies, (F.col("a") == F.col("u")) & (F.col("part") == F.col("of"))).select("a", "b", "m")


def _stars(batches):
    """(a, b): each node of one task's edges but the least of its component, with that one."""
    ends = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    up = np.arange(len(nodes))
    while True:
        # Nodes are in order, so the lesser index is the lesser node; roots link to lesser roots until no edge joins two.
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            break
        np.minimum.at(up, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (up[up] != up).any():
            up = up[up]
    some = up != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[up[some]])], names=["a", "b"])


def _contracted(edges: DataFrame, chunk: int) -> tuple[DataFrame, tuple, bool]:
    """edges as stars of the tasks they were dealt to, their mark, and whether one task held them all."""
    mark = _mark(edges)
    while True:
        tasks = max(1, math.ceil(mark[0] / chunk))
        old, before = edges, mark[0]
        edges = written(edges.repartition(tasks).mapInArrow(_stars, "a long, b long"), "edges")
        discard(old)
        mark = _mark(edges)
        if tasks == 1 or 2 * mark[0] > before:
            return edges, mark, tasks == 1


def components(edges: DataFrame, most_rounds: int = 60, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    edges, mark, settled = _contracted(edges, chunk)
    for _ in range(most_rounds):
        if settled:
            break
        # Large star: every greater neighbour of a node links to the least of the node's neighbourhood.
        both = edges.union(edges.select("b", "a"))
        nodes = written(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "nodes")
        large = _salted(both.where("b > a"), nodes, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node's lesser neighbours, and it itself, link to the least of them.
        floor = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        lesser = large.join(floor, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = lesser.union(floor.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        old, edges = edges, written(star, "edges")
        discard(old)
        discard(nodes)
        now = _mark(edges)
        settled, mark = now == mark, now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
