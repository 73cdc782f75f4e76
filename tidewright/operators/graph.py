"""Connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A graph that has so few edges, at the start or after some rounds, is finished by one task.
FEW_EDGES = 20_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage in the checkpoint folder: the one that ``spark.checkpoint.dir`` names;
    only where it is unset and the master is local (tests on one machine), a new local one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _finished(edges: DataFrame) -> DataFrame:
    """(node, to): the smallest reachable node of every node of a few edges, by union and find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for a, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(c, c)
                x, y = root(a), root(c)
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.fromiter(map(root, nodes), np.int64, len(nodes)))], names=["node", "to"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, to bigint")


def _pointers(edges: DataFrame) -> DataFrame:
    """(node, to): every node points to the least among itself and its neighbours; pointers are doubled
    until all end at a root, the least node of its tree."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    points = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"))
    while True:
        onward = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
        further = cut(points.join(onward, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        points = further.select("node", "to")
        if further.filter("moved").isEmpty():
            return points


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as rows (node, root), root the smallest node.

    Contraction: each round points every node to a root and renames edges by it until none is left;
    a root is the least node of its tree, so the last one is the least of its component. Rounds
    and doublings grow with the logarithm of the longest path. Pointers come from a
    map-side-combined minimum and are written as tables of their own before they are joined, so
    that a node with most of the edges is split over tasks by adaptive execution. Once no more
    than ``few`` edges are left, one task ends it. The driver learns how many edges are left.
    """
    spark = edges.sparkSession
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        n = now.count()
        if not n:
            return spark.createDataFrame([], "node long, root long") if labels is None else labels.withColumnRenamed("label", "root")
        points = cut(_finished(now)) if n <= few else _pointers(now)
        if labels is None:
            labels = points.withColumnRenamed("to", "label")
        else:
            labels = cut(labels.join(points.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        if n <= few:
            return labels.withColumnRenamed("label", "root")
        a, b = points.select(F.col("node").alias("a"), F.col("to").alias("x")), points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        now = now.join(a, "a").join(b, "b").filter("x <> y")
        now = cut(now.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
