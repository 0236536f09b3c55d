"""The graph across accounts: who pays whom, cycles, communities and connected entities.

A node is a subject: the owner of one or more accounts of the book. A counterparty becomes a
node if its subject id is that of an owner; payments to anyone else are not part of the graph.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import drop, durable
from . import base as B
from .base import KEY
from .components import components

#: Smallest flow of an edge that connects entities.
STRONG = 300_000.0


def entity_edges(txn: DataFrame, accounts: DataFrame, least: float = 0.0) -> DataFrame:
    """(src, dst, n, flow): payments between owners, money in whole cents; ``least`` is the smallest flow of an edge.

    Payments are summed per account, counterparty and direction before names are read, so the
    text work and both joins see one row for each of those. Payments to oneself are left out,
    and so are names without a letter or digit: they say nothing of who it is.
    """
    owners = accounts.select(KEY, N.unique_identifier(F.col("owner")).alias("me")).where("not startswith(me, '_')").distinct()
    out = F.col("amount") < 0
    paid = txn.where("amount <> 0").groupBy(KEY, "counterparty", out.alias("out")).agg(F.count("*").alias("n"), F.sum(F.abs(B.cents("amount"))).alias("flow"))
    paid = paid.withColumn("other", N.unique_identifier(F.coalesce("counterparty", F.lit("")))).join(owners, KEY)
    paid = paid.join(owners.select(F.col("me").alias("other")).distinct(), "other", "left_semi").where("other <> me")
    ends = paid.select(F.when(F.col("out"), F.col("me")).otherwise(F.col("other")).alias("src"), F.when(F.col("out"), F.col("other")).otherwise(F.col("me")).alias("dst"), "n", "flow")
    return ends.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("flow").alias("flow")).where(F.col("flow") >= F.lit(least) * 100)


def _ranked(edges: DataFrame) -> DataFrame:
    """Edges with the rank of both ends: degree, then name. Ranks differ between nodes."""
    pairs = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("p")).select("p.*").distinct()
    degree = pairs.groupBy("node").agg(F.count("*").alias("d"))

    def with_rank(df, end, name):
        rank = degree.select(F.col("node").alias(end), F.struct("d", F.col("node").alias("v")).alias(name))
        return df.join(rank, end)

    return with_rank(with_rank(edges.select("src", "dst", "flow").where("src <> dst"), "src", "rs"), "dst", "rd")


def _rotated(*nodes: str):
    """Nodes of a cycle, beginning with the smallest name."""
    path = F.array(*nodes)
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat(F.slice(path, at, F.lit(len(nodes))), F.slice(path, F.lit(1), at - 1))


def entity_cycles(edges: DataFrame) -> DataFrame:
    """(length, path, flow): every directed cycle of three and of four owners, once.

    The node of the highest rank (degree first) of a cycle is its top. Two halves go through it:
    x → y → top and top → w → x. Halves are joined in their lower middle node, so a hub is a
    middle only below the few nodes of still higher degree; with m edges there are of the order
    of m times the root of m halves at most, whatever the degrees. No cycle is left out.
    """
    e = durable(_ranked(edges))
    first = e.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("flow").alias("f1"), F.col("rs").alias("rx"))
    up = e.where("rd > rs").select(F.col("src").alias("y"), F.col("dst").alias("z"), F.col("flow").alias("f2"), F.col("rd").alias("rz"))
    to_top = durable(first.join(up, "y").where("rz > rx").select("x", "y", "z", (F.col("f1") + F.col("f2")).alias("f_up")))
    down = e.where("rs > rd").select(F.col("src").alias("z"), F.col("dst").alias("w"), F.col("flow").alias("f3"), F.col("rs").alias("rz"))
    last = e.select(F.col("src").alias("w"), F.col("dst").alias("x"), F.col("flow").alias("f4"), F.col("rd").alias("rx"))
    from_top = down.join(last, "w").where("rz > rx").select("z", "w", "x", (F.col("f3") + F.col("f4")).alias("f_down"))
    closing = e.select(F.col("src").alias("z"), F.col("dst").alias("x"), F.col("flow").alias("f_down"))
    three = to_top.join(closing, ["x", "z"]).select(F.lit(3).alias("length"), _rotated("x", "y", "z").alias("path"), (F.col("f_up") + F.col("f_down")).alias("flow"))
    four = to_top.join(from_top, ["x", "z"]).where("y <> w").select(F.lit(4).alias("length"), _rotated("x", "y", "z", "w").alias("path"), (F.col("f_up") + F.col("f_down")).alias("flow"))
    return three.union(four).select("length", F.array_join("path", " > ").alias("path"), (F.col("flow") / 100.0).alias("flow"))


def entity_communities(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, community) by label propagation: in each round every owner takes the label most of
    the owners around them have, the smallest one on ties. Directions and amounts play no part.

    All nodes change at once, so a round is one join and two aggregates that combine before
    they shuffle. A label has no more votes at a node than the node has neighbours.
    """
    ends = edges.where("src <> dst")
    links = durable(ends.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(ends.select("dst", "src")).distinct())
    labels = links.select("node", F.col("node").alias("community")).distinct()
    for k in range(rounds):
        votes = links.join(labels.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.count("*").alias("n"))
        new = durable(votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("community")))
        if k:
            drop(labels)
        labels = new
    return labels


def entity_components(edges: DataFrame) -> DataFrame:
    """(node, component): owners connected by payments of any direction; named after the smallest."""
    return components(edges)
