"""Connected components of an edge table, each labelled by its smallest node."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

EDGES = "a long, b long"


class Union:
    """Union-find over hashable nodes; roots are the smallest of their sets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _forest(batches):
    """Edges of a partition as stars: at most one edge a node."""
    own = Union()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            own.join(a, b)
    nodes = [x for x in own.up if own.root(x) != x]
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([own.root(x) for x in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge; label is its component's smallest node.

    Large-star and small-star steps by turns until nothing changes, after each
    partition has reduced its own edges to stars. Minima are summed up before
    the shuffle, so a node with very many edges is no burden to one task.
    """
    now = saved(edges.select("a", "b").where("a <> b").mapInArrow(_forest, EDGES).distinct())
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        now = saved(small.where("a <> b").distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def relabel(values: np.ndarray, a: int, b: int) -> None:
    """Gives all places that hold a's value b's value, or the other way round, by the smaller."""
    x, y = values[a], values[b]
    values[values == max(x, y)] = min(x, y)
