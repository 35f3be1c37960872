"""Embedding near-duplicates through a pivot-permutation index.

A sample of the vectors serves as reference points (*pivots*), thinned so that no
two lie within twice the angle of a link: a dense group keeps a pivot or a few,
not its share of the sample, whose order would be noise to its members.  A vector
is described by its ``NEAREST`` closest pivots in order; the inverted list of a
pivot holds the vectors that name it.  Two vectors are candidates when they share
their closest pivot or at least ``MIN_SHARED`` pivots, counted within the list of
the first pivot they share; candidates are verified by their cosine in double
precision.

The number of pivots sampled follows the number of vectors, so that lists keep an
expected length, up to ``MAX_PIVOTS``; longer lists, such as those of a dense
group, are compared block by block.
Equal vectors are folded into classes first.  What leaves a block is one row per
member: its number of links and the root of its links' spanning forest.

Contract for unusual input: vectors that are null, zero, of another length than
most, or hold null or non-finite components link with nothing; an empty table
gives an empty result; repeated ids are separate vectors that count each other
when their vectors link; other columns, labels included, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import stored
from tierline.llm.components import components
from tierline.llm.pairing import block_pairs, spanning_forest

#: Smallest cosine of a link.
MIN_COSINE = 0.9
#: Pivots that describe a vector, and shared ones that make a candidate.
NEAREST = 8
MIN_SHARED = 2
#: Expected vectors per pivot before each is listed NEAREST times; most pivots.
VECTORS_PER_PIVOT = 64
MIN_PIVOTS = 32
MAX_PIVOTS = 4096
#: Rows compared with each other at once inside a list.
BLOCK_ROWS = 2048


def usable(vector: str, length: int) -> F.Column:
    """Whether a vector can have a cosine at all."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.coalesce((F.size(vector) == length) & finite & nonzero, F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    rows = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def thinned(pivots: np.ndarray, min_cosine: float) -> np.ndarray:
    """The pivots, in order, without those within twice the link angle of a
    kept one."""
    most = max(2 * min_cosine**2 - 1, 0.5)
    kept, n = np.empty_like(pivots), 0
    for pivot in pivots:
        if not n or (kept[:n] @ pivot).max() < most:
            kept[n] = pivot
            n += 1
    return kept[:n].copy()


def permutation(units: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of every row, closest first, ties by pivot number."""
    closeness = units @ pivots.T
    if nearest >= pivots.shape[0]:
        return np.argsort(-closeness, axis=1, kind="stable").astype(np.int16)
    some = np.argpartition(-closeness, nearest, axis=1)[:, :nearest]
    some.sort(axis=1)
    order = np.argsort(-np.take_along_axis(closeness, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype(np.int16)


def list_links(
    units: np.ndarray, perms: np.ndarray, sizes: np.ndarray, reps: np.ndarray, side: np.ndarray, pivot: int, min_cosine: float, min_shared: int
) -> tuple[np.ndarray, np.ndarray]:
    """(links, root row) per row of a block pair of one pivot's list.  ``links``
    counts the vectors of linked classes; a pair counts in the list of the
    smallest pivot it shares only."""
    n = reps.size
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = not right.size
    right = left if own else right
    shared = np.zeros((left.size, right.size), np.uint8)
    for i in range(perms.shape[1]):
        mine = perms[left, i][:, None]
        for j in range(perms.shape[1]):
            shared += mine == perms[right, j][None, :]
    candidate = (shared >= min_shared) | (perms[left, 0][:, None] == perms[right, 0][None, :])
    near = candidate & (units[left] @ units[right].T >= min_cosine)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    keep = a < b if own else np.ones(a.size, bool)
    a, b = a[keep], b[keep]
    first = np.empty(a.size, bool)
    for at in range(0, a.size, 1 << 16):
        here = slice(at, at + (1 << 16))
        same = perms[a[here]][:, :, None] == perms[b[here]][:, None, :]
        first[here] = ~(same.any(axis=2) & (perms[a[here]] < pivot)).any(axis=1)
    a, b = a[first], b[first]
    links = np.bincount(a, sizes[b], n).astype(np.int64) + np.bincount(b, sizes[a], n).astype(np.int64)
    return links, spanning_forest(n, a, b)


def embedding_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = MIN_COSINE,
    nearest: int = NEAREST,
    min_shared: int = MIN_SHARED,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    lengths = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), "length").first()  # one row
    length = most.length if most else 0
    rows = stored(rows.withColumn("usable", usable("vector", length)), "vectors")
    classes = rows.where("usable").groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.where("rep IS NOT NULL"), "vector-classes")

    n = classes.count()
    n_pivots = int(min(MAX_PIVOTS, max(MIN_PIVOTS, n // VECTORS_PER_PIVOT)))
    # a bounded sample, the same on every run: the first vectors in hash order
    picked = classes.select("vector", F.xxhash64(F.lit("pivot"), "rep").alias("at"), "rep").orderBy("at", "rep").limit(n_pivots)
    pivots = thinned(unit(np.array([r.vector for r in picked.collect()], np.float64)), min_cosine) if n else np.zeros((1, 1))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                units = unit(part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1))
                perms = permutation(units, pivots, nearest)
                row = np.repeat(np.arange(part.num_rows), perms.shape[1])
                offsets = np.arange(row.size + 1, dtype=np.int32)
                listed = pa.ListArray.from_arrays(offsets * perms.shape[1], pa.array(perms[row].ravel()))
                vector = pa.ListArray.from_arrays(offsets * units.shape[1], pa.array(units[row].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(perms.ravel()), part.column("rep").take(pa.array(row)), part.column("size").take(pa.array(row)), listed, vector],
                    ["pivot", "rep", "size", "perm", "unit"],
                )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        reps = pdf["rep"].to_numpy()
        links, root = list_links(
            np.stack(pdf["unit"].to_numpy()), np.stack(pdf["perm"].to_numpy()), pdf["size"].to_numpy(), reps, pdf["side"].to_numpy(),
            int(pdf["pivot"].iloc[0]), min_cosine, min_shared,
        )
        found = links > 0
        return pd.DataFrame({"a": reps[found], "b": reps[root[found]], "links": links[found]})

    schema = "pivot smallint, rep long, size long, perm array<smallint>, unit array<double>"
    lists = stored(classes.mapInArrow(describe, schema), "pivot-lists")
    dealt = block_pairs(lists, "pivot", "rep", BLOCK_ROWS)
    found = stored(dealt.groupBy("pivot", "left", "right").applyInPandas(compare, "a long, b long, links long"), "vector-links")

    degrees = found.groupBy("a").agg(F.sum("links").alias("links"))
    linked = components(found.select("a", "b"))
    per_class = (
        classes.join(degrees, F.col("rep") == F.col("a"), "left")
        .join(linked, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("vector").alias("_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    same = F.col("usable") & (F.col("vector") == F.col("_vector"))
    out = rows.join(per_class, same, "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", F.col("id").cast("long")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
