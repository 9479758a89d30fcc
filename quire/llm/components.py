"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import BROADCAST_ROWS, hot_from, join_hot
from quire.session import persist_table


def _joined(left: DataFrame, nodes: DataFrame, many: int) -> DataFrame:
    """left with the row of the table nodes (a, m, n) of its a: nodes are broadcast if few, else only those of more than many edges."""
    if nodes.count() <= BROADCAST_ROWS // 2:
        return left.join(F.broadcast(nodes), "a")
    return join_hot(left, nodes, ["a"], "n", many)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, component (least node of it) of edges (a, b); nodes without an edge don't occur.

    Alternates large-star and small-star steps: every node is tied to the least of its
    neighbours until nothing changes, in a logarithmic number of rounds for practical
    purposes. Each round is a group-by on the node, with partial aggregation, and a join
    in which the nodes are broadcast if they are at most BROADCAST_ROWS / 2, else those of many
    edges (the centres of stars), so that no task gets all edges of one; its tables are written
    to the shared folder, so lineage stays short. Raises a RuntimeError where the given number
    of rounds doesn't settle it. A null node has no edges.
    """
    now = persist_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        many = hot_from(2 * before[0])
        least = persist_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "nodes")
        large = persist_table(_joined(both.filter("b > a"), least, many).select(F.col("b").alias("a"), F.col("m").alias("b")), "edges")
        low = persist_table(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "nodes")
        small = _joined(large, low, many).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = persist_table(small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
