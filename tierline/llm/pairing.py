"""Shard-wise pairing: compare the members of a shard in bounded blocks.

Both similarity operators deal their rows into shards whose members must be
compared with each other.  A shard has no size limit, so it is cut into blocks
of a bounded number of rows and every pair of blocks is one group of a grouped
map: memory is bounded by two blocks whatever the data, and no row is dropped.
What leaves a group is at most one row per member (a spanning forest of the
links), never the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, shard: str, key: str, block_rows: int) -> DataFrame:
    """``members`` with (left, right, side) added: each member once per block
    pair its block takes part in.  ``side`` is 0 for rows of block ``left`` and
    1 for rows of block ``right``; the pair (b, b) has side 0 only.  The sizes
    come from one row per shard, joined by shuffle or as AQE sees fit."""
    sizes = members.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_blocks"))
    cut = members.join(sizes, shard).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return (
        cut.withColumn("other", other)
        .withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .withColumn("side", F.when(F.col("block") <= F.col("other"), 0).otherwise(1))
        .drop("block", "other", "n_blocks")
    )


def spanning_forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links
    (left[i], right[i]): repeated minimum over links, then pointer jumping."""
    root = np.arange(n)
    while left.size:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        # the links' smaller root goes to both ends and to both old roots
        for ends in (left, right, before[left], before[right]):
            np.minimum.at(root, ends, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
    return root
