"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.llm.work import Work


def connected(work: Work, edges: DataFrame) -> DataFrame:
    """The smallest node reachable: (node, root) for every node of ``edges`` (a, b), two 64-bit ids.

    Each round every node points to its smallest neighbour, pointers are followed once, and the edges are redrawn between
    the nodes pointed to; what is left shrinks at least by half, and stars and cliques vanish in one round. Rows are only
    joined and summed by node, so a node with many edges adds up before the shuffle. An empty table gives an empty table.
    """
    rest = work.put(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first, jumps = rest, []
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        ahead = low.select(F.col("a").alias("b"), F.col("b").alias("to"))
        jump = work.put(low.join(ahead, "b").select(F.col("a").alias("node"), "to"))
        jumps.append(jump)
        ends = rest.join(jump.select(F.col("node").alias("a"), F.col("to").alias("u")), "a").join(jump.select(F.col("node").alias("b"), F.col("to").alias("v")), "b")
        past, rest = rest, work.put(ends.where("u != v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        if past is not first:
            work.drop(past)
    # every node has the pointer of the first round; the later ones lead on from there
    roots = jumps[0].withColumnRenamed("to", "root") if jumps else first.select(F.col("a").alias("node"), F.col("a").alias("root"))
    for jump in jumps[1:]:
        roots = roots.join(jump.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    roots = work.put(roots)
    work.drop(first, rest, *jumps)
    return roots
