"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import stored

#: Rounds are logarithmic in the longest path; this only stops a fault from looping for ever.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b), where
    component is the smallest node reachable.

    Alternates two star operations until nothing changes: *large star* hangs a
    node's larger neighbours on its smallest neighbour, *small star* does so
    with its smaller ones.  Each round is an aggregate and a join on the node;
    a hub is folded on the map side in the aggregate and split by the adaptive
    skew join.  Every round is stored, so a lost executor repeats one round.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u > v holds in every large-star link: small star works on them as they are
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        # a table that repeats itself is a set of stars; order-free digest of at most 38 digits
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
