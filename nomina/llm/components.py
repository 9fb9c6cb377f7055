"""Connected components of a link table, kept on the executors: union-find within partitions, contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomina.llm.common import stored


class UnionFind:
    """Disjoint sets of integers whose root is their smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch's links only a spanning star for each of its groups."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(a, b)
        pairs = [(x, sets.root(x)) for x in list(sets.up) if sets.root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the smallest id reachable. Nulls and a = b are ignored.

    Each round hooks a vertex to its smallest neighbour, follows those parents to their roots by doubling, and keeps the
    links between different roots; the rounds needed grow with the logarithm of the longest chain."""
    edges = stored(links.select("a", "b").filter("a != b").mapInArrow(_forest, "a long, b long").distinct())
    found = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        tree = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("up")))
        while True:
            up = tree.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            tree = stored(tree.join(up, "up").select("id", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")))
            if not tree.filter("moved").limit(1).count():
                break
        tree = tree.select("id", "up")
        if found is None:
            found = tree
        else:
            found = stored(found.join(tree.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up", "left").select("id", F.coalesce("upper", "up").alias("up")))
        of = tree.select(F.col("id").alias("x"), F.col("up").alias("y"))
        edges = edges.join(of.withColumnRenamed("x", "a"), "a").select(F.col("y").alias("p"), "b").join(of.withColumnRenamed("x", "b"), "b")
        edges = stored(edges.select(F.col("p").alias("a"), F.col("y").alias("b")).filter("a != b").distinct())
    if found is None:
        found = edges.select(F.col("a").alias("id"), F.col("b").alias("up"))
    return found.select("id", F.col("up").alias("component"))
