"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import broadcast_up_to, cut_and_count


def _ranked(node: str) -> Column:
    """Nodes in a scattered but fixed order, so that a chain of neighbours contracts in few rounds."""
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("v"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with one node of its component, the same for all of them.

    Each round every node moves onto its first neighbour in a scattered order, unless it is itself first among them; links
    between the images form the next, smaller graph.  Rounds grow with the logarithm of the longest chain.  Hubs are
    pre-aggregated before the shuffle, and the joins that follow are plain equi-joins, which adaptive execution splits; the
    moves of a round, two numbers a node, are broadcast once they are few enough (`common.BROADCAST_ROWS`).
    Links to a null or to itself join nothing; an empty table gives an empty table.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_ranked("b")).alias("m"))
        moves = first.select(F.col("a").alias("node"), F.least(F.col("m"), _ranked("a")).getField("v").alias("root"))
        moves, n = cut_and_count(moves)
        if found is None:
            found = moves
        else:
            later = broadcast_up_to(moves.select(F.col("node").alias("root"), F.col("root").alias("__to")), n)
            found = cut_lineage(found.join(later, "root", "left").select("node", F.coalesce("__to", "root").alias("root")))
        x = broadcast_up_to(moves.select(F.col("node").alias("a"), F.col("root").alias("ra")), n)
        y = broadcast_up_to(moves.select(F.col("node").alias("b"), F.col("root").alias("rb")), n)
        edges = edges.join(x, "a").join(y, "b").where("ra <> rb")
        edges, left = cut_and_count(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if not left:
            return found
