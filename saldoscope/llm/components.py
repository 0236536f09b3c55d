"""Connected components by alternating large-star and small-star, as joins and aggregates.

Every round keeps at most as many edges as before and shuffles them by node; a node with many
neighbours only adds rows that are combined before the shuffle, and the join back to its
minimum is a plain equi-join that adaptive execution may split. Each round is written to the
shared folder, so a lost executor repeats one round at most.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v): all rows of u get the smallest of u and its v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(low, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _star(down)
    return (near.select(F.col("v").alias("x"), "m").union(near.select(F.col("u").alias("x"), "m"))
            .where("x != m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    inner = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return twice.union(inner).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Loops and repeated edges are allowed; an edge with a null end is ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v and u is not null and v is not null").distinct()
    while True:
        e = cut(_small(_large(e)))
        if _is_forest_of_stars(e):
            break
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return cut(pairs.union(e.select("v", "v").distinct()))
