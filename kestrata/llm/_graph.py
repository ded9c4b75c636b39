"""Connected components of an edge table: forests of parts, and alternating large and small stars between them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, hinted, remove, written

PART_EDGES = 1 << 20  # of a task; its memory is bounded by them
BROADCAST_ROWS = 500_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of all nodes of the edges, but for the least ones themselves; ascending."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(x):
        # hook each tree to the least one that it has an edge to, then let all nodes see their root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    inner = root != np.arange(len(node))
    return node[inner], node[root[inner]]


def _forest(part: int):
    """From edges (a, b), a forest of stars that connects what they connect, of ``part`` edges at a time."""

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            if n and n + batch.num_rows > part:
                a, b = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [(a, b)], len(a)
                if n > part // 2:
                    yield rows(a, b)
                    held, n = [], 0
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
        if n:
            yield rows(*least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


def _stars(e: DataFrame, large: bool) -> DataFrame:
    """Join each node's neighbours to the least of them: the larger ones (large star) or the smaller ones (small star)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _finished(e: DataFrame) -> DataFrame:
    """e (a, b): edges to the least node of a star, with ``whole``: whether the star is a component.

    It is where none of its nodes is in another star.
    """
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("m")).unionByName(e.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("m")))
    nodes = nodes.groupBy("node").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), (F.count("*") > F.count("m")).alias("centre"))
    shared = cut(nodes.filter("lo < hi or lo is not null and centre").select("node"))
    open_ = e.join(shared.withColumnRenamed("node", "a"), "a").select("b").unionByName(shared.select(F.col("node").alias("b"))).distinct()
    open_ = cut(open_.withColumn("__open", F.lit(True)))
    return e.join(hinted(open_, BROADCAST_ROWS), "b", "left").select("a", "b", F.col("__open").isNull().alias("whole"))


def connected_components(edges: DataFrame, part: int = PART_EDGES) -> DataFrame:
    """edges (a, b) of longs -> (node, component), component the least node reachable; nodes without edges are absent.

    Edges always lead from the larger node a to the smaller b.  Each round
    replaces the edges of every part of at most ``part`` by a forest of stars;
    where one part holds all, that is the answer.  Else large and small stars
    join the parts, and stars that are whole components are done.
    Each round is a constant number of shuffles and is written out as a table,
    and the table before it is deleted; rounds grow with the logarithm of the
    nodes, and only what isn't done takes part in them.  Neither forests nor
    stars raise the sum of both ends over all edges, and stars lower it unless
    the edges are stars already, which are done then.
    """
    spark = edges.sparkSession
    e, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    n, found = e.count(), []
    while n:
        parts, old = -(-n // part), path
        e, path = written(e.coalesce(parts).mapInArrow(_forest(part), "a long, b long"))
        remove(spark, old)
        if parts == 1:
            found.append((e, path))
            break
        old = path
        e, path = written(_stars(_stars(e, True), False))
        remove(spark, old)
        old = path
        e, path = written(_finished(e))
        remove(spark, old)
        found.append((e.filter("whole").select("a", "b"), path))
        e = e.filter("not whole").select("a", "b")
        n = e.count()
        if n:
            e, path = written(e)
    if not found:
        found.append((e, path))
    e = reduce(DataFrame.unionByName, [x for x, _ in found])
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = cut(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    for _, path in found:
        remove(spark, path)
    return out
