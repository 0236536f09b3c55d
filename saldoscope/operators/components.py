"""Connected components of any graph, by star contraction in joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, durable


def _least(links: DataFrame, node: str, other: str) -> DataFrame:
    """Least neighbour of each node; combines before the shuffle, so a hub costs one row a task."""
    return links.groupBy(node).agg(F.min(other).alias("least"))


def _upward(edges: DataFrame) -> DataFrame:
    """All larger neighbours of a node are linked to the least node it sees, itself included."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
    seen = both.where("other > node").join(_least(both, "node", "other"), "node")
    return seen.select(F.col("other").alias("hi"), F.least("node", "least").alias("lo")).distinct()


def _downward(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    seen = edges.join(_least(edges, "hi", "lo"), "hi")
    return seen.select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    Nodes may be of any type that can be ordered, also structs. Loops and edges with a null end
    are ignored. Every round turns trees towards stars, writes its edges to the shared folder
    and drops the round before; edges never grow in number, and few rounds are needed.
    """
    e = durable(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    while True:
        after = durable(_downward(_upward(e)))
        # stars: every upper node has one lower node, which is no upper node itself
        chained = after.select(F.col("lo").alias("hi")).join(after.select("hi"), "hi", "left_semi")
        forked = after.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
        done = chained.union(forked).isEmpty()
        drop(e)
        e = after
        if done:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
