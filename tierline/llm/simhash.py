"""SimHash near-duplicates, found exactly through vantage-point trees.

Two 64-bit fingerprints link when they differ in at most ``max_bits`` bits.  Cut
the fingerprint in ``PARTS`` equal parts: two linked ones differ by at most
``max_bits // PARTS`` in at least one part, so each part gets a vantage-point
tree over its own Hamming distance with that radius.  A tree node has a vantage
point and a median distance; by the triangle inequality a query within the
radius of the border must look at both sides, any other at one side only.  The
tree is built on a bounded sample of fingerprints (only its balance depends on
the sample, never the result) and its leaves are shards: every different
fingerprint lives in one home shard per tree and visits the shards on its
borders.  Inside a shard the full distance decides.

Equal fingerprints are folded first; what leaves a shard is a spanning forest of
its links; components join the forests.

Fingerprints are the nodes of the links, so ids play no part in them; a
component's id is the smallest of its documents' ids.

Contract for unusual input: a null or empty text has fingerprint zero and links
with every other such document; documents with a null id link like any other, and
a component's id is null only where all its ids are; an empty table gives an
empty result; repeated rows are members of one class; texts are hashed whole
whatever their length; columns other than id and text are ignored.  ``survivors``
keeps exactly one row of each component whatever the ids: repeated ids keep one
row, and a component without ids keeps one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import stored
from tierline.llm.components import components
from tierline.llm.pairing import block_pairs, spanning_forest

#: Words per shingle and largest bit distance of a link.
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Seed of the shingle hash (fixed value).
SEED = 42
#: Parts of a fingerprint, each with a tree of its own.
PARTS = 2
#: Fingerprints of a tree's sample at most, and expected home rows of a shard.
TREE_SAMPLE = 8192
SHARD_ROWS = 1024
#: Rows compared with each other at once inside a shard.
BLOCK_ROWS = 16384
#: Links held at once inside a shard, about.
MOST_PAIRS = 1 << 20


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        shingles = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle_words].tolist()]
        stops = (ends[shingle_words - 1 :] - 1).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, stops)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > hashes.size, bitorder="little").view("<u8")[0])


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """(k1, k2): 128 bits that tell rows of different id or text apart."""
    text = F.col(text_col).cast("string")
    parts = (F.col(id_col).isNull(), text.isNull(), F.col(id_col), text)
    return [F.xxhash64(F.lit(k), *parts).alias(k) for k in ("k1", "k2")]


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, keys: bool = False
) -> DataFrame:
    """(id, fp): the fingerprint of every document as a signed 64-bit value;
    with ``keys`` also its ``row_keys``."""
    others = ["id", "k1", "k2"] if keys else ["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle_words) for t in batch.column("text").to_pylist()]
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), fps], [*others, "fp"])

    rows = docs.select(F.col(id_col).alias("id"), *(row_keys(id_col, text_col) if keys else []), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.drop("text").schema.add("fp", "long"))


def part_of(fps: np.ndarray, part: int, parts: int = PARTS) -> np.ndarray:
    """The bits of one part of unsigned fingerprints."""
    width = 64 // parts
    return (fps >> np.uint64(part * width)) & np.uint64((1 << width) - 1)


def build_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(vantage points, radii) of a complete tree in heap order: node k has
    children 2k + 1 (distance at most the radius) and 2k + 2.  Radii are
    medians over the sample rows that reach a node."""
    nodes = (1 << depth) - 1
    points, radii = np.zeros(nodes, np.uint64), np.full(nodes, 16)
    at = np.zeros(sample.size, np.int64)
    for level in range(depth):
        for node in range((1 << level) - 1, (1 << (level + 1)) - 1):
            here = sample[at == node]
            if here.size:
                # the row farthest from the first gives distances the widest spread
                points[node] = here[np.bitwise_count(here ^ here[0]).argmax()]
                radii[node] = int(np.median(np.bitwise_count(here ^ points[node])))
        at = 2 * at + 1 + (np.bitwise_count(sample ^ points[at]) > radii[at])
    return points, radii


def route(values: np.ndarray, points: np.ndarray, radii: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of every shard that may hold a value within
    ``radius``; home marks the one shard a row lives in."""
    row, node, home = np.arange(values.size), np.zeros(values.size, np.int64), np.ones(values.size, bool)
    for _ in range(depth):
        far = np.bitwise_count(values[row] ^ points[node]).astype(np.int64) - radii[node]
        outside = far > 0
        # |d(q, v) - d(x, v)| <= d(q, x): the other side matters within the radius of the border
        both = np.where(outside, far <= radius, far > -radius)
        row, node, home = (
            np.concatenate([row, row[both]]),
            np.concatenate([2 * node + 1 + outside, 2 * node[both] + 1 + ~outside[both]]),
            np.concatenate([home, np.zeros(int(both.sum()), bool)]),
        )
    return row, node - ((1 << depth) - 1), home


def shard_links(fps: np.ndarray, ids: np.ndarray, home: np.ndarray, side: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (id, root id) of the links between the rows of a block
    pair.  Two rows that only visit are compared in a home shard of theirs."""
    order = np.argsort(ids, kind="stable")
    fps, home, side, ids = fps[order], home[order], side[order], ids[order]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if right.size else left
    root, found_a, found_b, pairs = np.arange(ids.size), [], [], 0
    step = max(1, (1 << 22) // max(1, right.size))
    for at in range(0, left.size, step):
        rows = left[at : at + step]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[right][None, :]) <= max_bits
        a, b = np.nonzero(near)
        a, b = rows[a], right[b]
        keep = (a != b) & (home[a] | home[b])
        found_a.append(a[keep])
        found_b.append(b[keep])
        pairs += found_a[-1].size
        if pairs > MOST_PAIRS or at + step >= left.size:  # fold into the forest: bounded memory for dense shards
            root = spanning_forest(ids.size, np.concatenate([*found_a, np.arange(ids.size)]), np.concatenate([*found_b, root]))
            found_a, found_b, pairs = [], [], 0
    linked = root != np.arange(ids.size)
    return ids[linked], ids[root[linked]]


def near_links(classes: DataFrame, max_bits: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """Links (a, b) between the different fingerprints of ``classes`` (fp,
    rep), enough of them to connect all that are reachable."""
    radius = max_bits // parts
    n = classes.count()
    depth = max(0, min(11, int(np.ceil(np.log2(max(1, n) / SHARD_ROWS)))))
    # a bounded sample, the same on every run: the first fingerprints in hash order
    picked = classes.select("fp", F.xxhash64(F.lit("tree"), "fp").alias("at")).orderBy("at", "fp").limit(TREE_SAMPLE)
    sample = np.array([r.fp for r in picked.collect()], np.int64).view(np.uint64)
    trees = [build_tree(part_of(sample, p, parts), depth) for p in range(parts)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, reps = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("rep").to_numpy(zero_copy_only=False)
            for p, (points, radii) in enumerate(trees):
                row, leaf, home = route(part_of(fps.view(np.uint64), p, parts), points, radii, depth, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf * parts + p, pa.int32()), pa.array(fps[row]), pa.array(reps[row]), pa.array(home)],
                    ["shard", "fp", "rep", "home"],
                )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        a, b = shard_links(fps, pdf["rep"].to_numpy(), pdf["home"].to_numpy(), pdf["side"].to_numpy(), max_bits)
        return pd.DataFrame({"a": a, "b": b})

    members = stored(classes.select("fp", "rep").mapInArrow(deal, "shard int, fp long, rep long, home boolean"), "simhash-shards")
    dealt = block_pairs(members, "shard", "fp", BLOCK_ROWS)
    return dealt.groupBy("shard", "left", "right").applyInPandas(compare, "a long, b long")


def fingerprint_components(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component): every different fingerprint of ``rows`` with the
    smallest one reachable over links."""
    classes = stored(rows.select("fp").distinct(), "simhash-classes")
    linked = components(near_links(classes.select("fp", F.col("fp").alias("rep")), max_bits))
    return classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id
    (smallest id reachable over links)."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    found = stored(fingerprint_components(rows, max_bits), "simhash-components")
    first = rows.groupBy("fp").agg(F.min("id").alias("id")).join(found, "fp").groupBy("component").agg(F.min("id").alias("component_id"))
    ids = found.join(first, "component").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(ids, rows["fp"] == ids["_fp"]).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def survivors(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each
    component the one with the smallest id, null last; of several with that id,
    one."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words, keys=True), "simhash")
    found = fingerprint_components(rows, max_bits)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2").alias("rank")
    first = rows.select("fp", rank).groupBy("fp").agg(F.min("rank").alias("rank"))
    kept = first.join(found, "fp").groupBy("component").agg(F.min("rank").alias("rank")).select("rank.k1", "rank.k2")
    keyed = docs.select(*row_keys(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # rows of equal id and text have equal keys: one of them stays
    same = Window.partitionBy("k1", "k2").orderBy("k1")
    whole = keyed.join(kept, ["k1", "k2"], "left_semi").withColumn("n", F.row_number().over(same))
    return whole.where("n = 1").select("row.*")
