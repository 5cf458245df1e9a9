"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a long, b long); root is the smallest node of its component.

    Each round, every node points to the smallest of itself and its neighbours;
    the pointers, which only go down, are followed to their ends, and the links
    are drawn again between those ends. A round leaves at most half of the nodes
    that still have links, so rounds grow with the logarithm of the nodes. No
    component or neighbourhood is ever gathered in one task: the minimum is
    taken map-side first, and joins have one row a node on one side.
    """
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "pointers")
        while True:
            nxt = to.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            moved = written(to.join(nxt, to["to"] == nxt["_n"], "left").select("node", F.coalesce("_t", "to").alias("to"), (F.coalesce("_t", "to") != F.col("to")).alias("moved")), "pointers")
            to = moved.select("node", "to")
            if moved.where("moved").isEmpty():
                break
        if roots is None:
            roots = to.select("node", F.col("to").alias("root"))
        else:
            nxt = to.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            roots = written(roots.join(nxt, roots["root"] == nxt["_n"], "left").select("node", F.coalesce("_t", "root").alias("root")), "roots")
        of_a = to.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        of_b = to.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        drawn = links.join(of_a, "a").join(of_b, "b").where("ra <> rb")
        links = written(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
