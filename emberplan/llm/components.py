"""Connected components of an edge table, with every step in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

#: Nodes that a task contracts at once.
HELD = 300_000


def _local(batches):
    """Contracts a task's edges to stars of their smallest node; other tasks' edges come later."""
    import pyarrow as pa

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def out():
        found = [(x, root(x)) for x in parent]
        found = [x for x in found if x[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > HELD:
            yield out()
            parent.clear()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u long, v long); root is the least node of its
    component. Loops and repeated edges do no harm; null ends are left out.

    Tasks first contract what they hold, in as few tasks as HELD allows. Then large-star and
    small-star rounds: each hangs a node's neighbours on its least neighbour, so paths shrink by
    halves until nothing changes; stars of any size are joins and minima, never lists.
    """
    e = materialise(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    tasks = -(-e.count() // (HELD // 2)) or 1
    e = materialise(e.repartition(tasks).mapInArrow(tidy(_local), "u long, v long"), "edges")
    mark = None
    while tasks > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
