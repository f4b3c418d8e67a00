"""Connected components of a link table by alternating large and small stars, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.shared import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: each neighbour above a node is linked with the node's least neighbour; small star: those below it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    near = both.join(least, "a")
    if large:
        made = near.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        made = near.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return made.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, component), the component being its smallest node. Nodes without links have no row.

    Every round is written to the shared folder; the state at a round is checked by counts and sums, not collected."""
    links = cut(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        links = cut(_star(_star(links, True), False), "stars")
        at = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if at == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select("b", "b").toDF("node", "component").distinct())
        before = at
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
