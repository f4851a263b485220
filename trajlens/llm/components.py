"""Connected components by contraction: near neighbours take one name, then names are joined in the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import discard, keep


def two_way(edges: DataFrame) -> DataFrame:
    """Both directions of each edge of ``a`` and ``b``, once, without loops and nulls."""
    edges = edges.select("a", "b").where("a != b")
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def near_names(both: DataFrame, level: int = 0) -> DataFrame:
    """``node, root``: root is the node of least hash among those at most two steps away.

    Nodes with one root are connected. All nodes around a centre get one root, as the centre hands it on. Neighbours
    are combined before the shuffle and never gathered.
    """
    def rank(column: str) -> Column:
        return F.struct(F.xxhash64(F.col(column), F.lit(level)).alias("h"), F.col(column).alias("n"))

    one = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a")).alias("m"))
    far = both.join(one.select(F.col("a").alias("b"), "m"), "b")
    return far.groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("node"), F.col("m")["n"].alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge; nodes are connected exactly if their roots are equal.

    ``edges`` has two long columns ``a`` and ``b``; repeats, loops and nulls are harmless. Each level shrinks the graph by
    a constant factor in expectation, because hashes are drawn anew; stars are done after one.
    """
    both, names, level = keep(two_way(edges)), [], 0
    while True:
        found = keep(near_names(both, level))
        names.append(found)
        mine = found.select(F.col("node").alias("a"), F.col("root").alias("x"))
        other = found.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = both.where("a < b").join(mine, "a").join(other, "b").where("x != y")
        smaller = keep(two_way(left.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        discard(both)
        both, level = smaller, level + 1
        if both.isEmpty():
            break
    out = names[-1]
    for found in reversed(names[:-1]):
        up = out.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = found.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out
