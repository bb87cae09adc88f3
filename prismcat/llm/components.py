"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is grouped minima and joins on node ids, so no component is ever gathered anywhere; hubs are summed before
the shuffle, and their edges stay where they are: a hub's minimum comes to them by broadcast. The number of rounds grows
with the logarithm of the longest path. Each round is a written table, so lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismcat.llm.common import freed, written

#: At most so many nodes are hubs, and a node of so few edges is none.
HUBS, HUB = 10_000, 64


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest connected node of each node of some pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: root(x) for x in list(parent)}


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars: fewer edges and shorter paths before the first shuffle."""
    for batch in batches:
        found = union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        edges = [(x, r) for x, r in found.items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """a, b of the edges and m of their a, from least (a, m, n: the rows of a among the edges, or more).

    A node of more than `hub` rows is a hub. The n add up to 2 * edges at most, so a `hub` of 2 * edges / HUBS leaves
    HUBS of them to broadcast, and other nodes have no more than that share of the rows.
    """
    hubs = F.broadcast(least.where(F.col("n") > hub).select("a", "m"))
    others = least.where(F.col("n") <= hub).select("a", "m")
    return edges.join(hubs, "a").unionByName(edges.join(hubs.select("a"), "a", "left_anti").join(others, "a")).select("a", "b", "m")


def connected_components(edges: DataFrame, *, rounds: int = 100, hubs: int = HUBS, hub: int = HUB) -> DataFrame:
    """(id, component): for each node of the edges (first two columns) the smallest node connected with it.

    Rows with a null node and loops connect nothing; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    u, v = edges.columns[:2]
    pairs = edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = written(spark, pairs.mapInArrow(freed(_stars), "a long, b long").distinct(), "edges")
    for _ in range(rounds):
        # done: each node points to one other, and what is pointed to points nowhere
        state = now.agg(F.count("*").alias("n"), F.count_distinct("a").alias("m")).first()
        if state["n"] == state["m"] and not now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi").head(1):
            break
        many = max(hub, -(-2 * state["n"] // hubs))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = written(spark, _with_least(both.where("b > a"), least, many).select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, lowest, many).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(spark, small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
