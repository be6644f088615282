"""Connected components of a link table, as repeated joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import stored


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach; nodes without a link don't appear.

    Large-star and small-star steps in turn: every step hooks a node's neighbours to the smallest of
    them, so that the links become stars in a few rounds, with as many links as nodes at most. The
    smallest neighbour comes from a grouping with partial aggregation, and the join back is an equi
    join that adaptive execution splits where one node has very many neighbours. Each round is
    written to the shared folder. Null ends and self links are ignored.
    """
    links = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    links = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    seen = None
    while True:
        # Large star: the larger neighbours of u go to the smallest of u and its neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        # Small star: u and its smaller neighbours go to the smallest of those.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        links = stored(small, "links")
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if now == seen:
            break
        seen = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
