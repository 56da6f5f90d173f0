"""Connected components of a large graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import remove, with_groups, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it. `n`: how many edges there are."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    tied = with_groups(both, least, ["u"], "n", F.col("v"), 2 * n, own={"m": F.min("v")}).where("v > u")
    return tied.select(F.col("v").alias("a"), F.least("u", "_group.m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges have a > b; there are about `n`."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    tied = with_groups(edges, least, ["a"], "n", F.col("b"), n, own={"m": F.min("b")}).select("a", "b", F.col("_group.m").alias("m"))
    return tied.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For edges (a, b) of long nodes: each node with an edge, and the smallest node it reaches: columns node, label.

    Every round is written to the shared folder, so no lineage grows and a lost executor costs one round. The rounds end
    when the edges no longer change; by then they are stars around the smallest nodes. The middle of a star may have as many
    edges as its component has nodes; `with_groups` keeps them apart.
    """
    current, path = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    mark = F.expr("struct(count(*) as n, bit_xor(xxhash64(a, b)) as x)")
    state = current.agg(mark.alias("s")).first()[0]
    for _ in range(most_rounds):
        following, next_path = written(_small_star(_large_star(current, state[0]), state[0]), "edges")
        now = following.agg(mark.alias("s")).first()[0]
        remove(edges.sparkSession, path)
        current, path = following, next_path
        if now == state:
            hubs = current.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
            return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(hubs)
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
