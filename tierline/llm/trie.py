"""Prefix trie of conversations by truncation peeling.

Every distinct sequence of the first d turns is a node.  The trie is found from the
deepest level upwards: the conversations that end at a depth merge with the nodes
left there by the level below, equal sequences are grouped into one node, the node is
written, its last turn is stripped, and what is left is grouped again one level up.
A node's figures are sums over the rows that were grouped into it, so one descent finds
the nodes and fills in their members, children, leaves and saved tokens; no node is
looked at again.

*Rows are small.*  A turn is a 128-bit digest and its length in code points; a prefix is
a chain of digests, and a conversation carries one 16-byte key per depth.  Texts are
read once, to be digested, and never shuffled.

*Private tails.*  Below the deepest sequence that a conversation shares with a
different one there is nothing to merge with, so stripping those turns needs no
grouping: one counting pass over (prefix, ending) finds where each ending turns
private, its tail is peeled inside its row, and the levels that are grouped start at
the deepest shared prefix.  Every level is one Spark job on a stored table; only the
number of levels depends on the data, not the way a row is treated.

*Hot groups.*  A prefix that a third of all conversations share is folded on the map
side.  The ids that end at a node are hashed as one text in ascending order: they are
sorted by range, so that several tasks share the ids of one node, joined in pieces
of ``PIECE`` ids, and only the pieces meet at the node, one after the other.  The few
parents that hold more than a thousandth of all nodes as children, fewer than a
thousand by that definition, are broadcast; the others are joined by shuffle.

Contract for unusual input: null role or text is empty; null turns come first; rows with
equal turns follow each other by their digests, and repeated rows are turns of their
own; rows without conversation id belong to no conversation and are left out; a
conversation without turns ends at the root; no conversations, no nodes.  Other columns
are not read.  A conversation's digests meet in one row: 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import stored, text_or_empty
from tierline.session import scratch_path

#: Bytes of a key, ids joined at a time, share of all nodes from which a parent is hot.
KEY, PIECE, HOT = 16, 256, 1000

_TURNS = "array<struct<turn:bigint,digest:binary,chars:bigint>>"
_LEVEL = "path binary, chars array<bigint>, low long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string"


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests of role
    and text with the text's length."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.length(text).cast("bigint").alias("chars"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def share_heads(convs: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Conversations that open like the one at the start of their stretch of
    ``every`` ids: its first h turns, then the own turns after the first h, h
    being the CRC-32 of the id's decimal text modulo ``most`` + 1."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    first = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, most).alias("_head"))
    joined = convs.join(first, F.col("conv_id") - F.col("conv_id") % every == F.col("_first"), "left")
    head = F.slice(F.coalesce("_head", F.array().cast(_TURNS)), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def chained(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, key, path, chars, rest): the key of every prefix, one
    after the other in ``path``; code points per turn and from a turn to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, path = b"", []
                for digest in turns.values.field("digest"):
                    key = hashlib.blake2b(key + digest.as_py(), digest_size=KEY).digest()
                    path.append(key)
                chars = turns.values.field("chars").to_numpy(zero_copy_only=False)
                out.append((conv, len(path), key, b"".join(path), chars, np.cumsum(chars[::-1])[::-1].copy()))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["conv_id", "depth", "key", "path", "chars", "rest"]
            )

    schema = "conv_id long, depth int, key binary, path binary, chars array<bigint>, rest array<bigint>"
    return convs.select("conv_id", "turns").mapInArrow(run, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows to (key, first id, number, joined ids)."""

    def rows() -> Iterator[tuple[bytes, int, int, str]]:
        at, ids = None, []
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (key != at or len(ids) == PIECE):
                    yield at, ids[0], len(ids), ",".join(map(str, ids))
                    ids = []
                at = key
                ids.append(conv)
        if ids:
            yield at, ids[0], len(ids), ",".join(map(str, ids))

    yield from _batched(rows(), ["key", "low", "n", "ids"], [pa.binary(), pa.int64(), pa.int64(), pa.string()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and first id to (key, smallest id, number, digest)."""

    def rows() -> Iterator[tuple[bytes, int, int, str]]:
        at, low, total, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            for key, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if total and key == at:
                    digest.update(b",")
                else:
                    if total:
                        yield at, low, total, digest.hexdigest()
                    at, low, total, digest = key, first, 0, hashlib.sha256()
                digest.update(ids.encode())
                total += n
        if total:
            yield at, low, total, digest.hexdigest()

    yield from _batched(rows(), ["key", "low", "n", "ends_sha256"], [pa.binary(), pa.int64(), pa.int64(), pa.string()])


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)


def endings(paths: DataFrame) -> DataFrame:
    """(key, low, n, ends_sha256): the conversations that end at each node."""
    ids = paths.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ids.mapInArrow(_pieces, "key binary, low long, n long, ids string")
    together = pieces.repartition("key").sortWithinPartitions("key", "low")
    return together.mapInArrow(_hashed, "key binary, low long, n long, ends_sha256 string")


def shared_depths(ends: DataFrame) -> DataFrame:
    """(low, shared) of the endings with a private tail: the depth of the
    deepest prefix that another ending has too."""
    depth = F.explode(F.sequence(F.lit(1), F.col("depth")))
    prefixes = ends.where("depth > 0").select("low", "path", depth.alias("d")).select("low", "d", _key("path", F.col("d")).alias("key"))
    met = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.min("d").alias("d"))
    return met.where("n = 1").groupBy("low").agg((F.min("d") - 1).alias("shared"))


def _key(path: str, depth: Column) -> Column:
    """The key at a depth >= 1 of a path."""
    return F.substring(F.col(path), (depth - 1) * KEY + 1, F.lit(KEY))


def _peel(ends: DataFrame, base: str) -> DataFrame:
    """The shared nodes of all depths, written under ``base`` level by level,
    deepest first."""
    spark = ends.sparkSession
    deepest = ends.agg(F.max("shared")).first()[0]
    alive = None
    if deepest is None:
        return spark.createDataFrame([], f"{_LEVEL}, depth int")  # no conversations
    for depth in range(deepest, -1, -1):
        here = ends.where(F.col("shared") == depth)
        tail = F.col("depth") > depth
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        rows = here.select(
            F.substring("path", 1, depth * KEY).alias("path"),
            F.slice("chars", 1, depth).alias("chars"),
            "low",
            F.col("n").alias("n_convs"),
            F.when(tail, one).otherwise(none).alias("n_children"),
            F.when(tail, one).otherwise(none).alias("n_leaves"),
            F.when(tail, (F.col("n") - 1) * F.get("rest", F.lit(depth))).otherwise(none).alias("saved"),
            F.when(~tail, F.col("ends_sha256")).alias("ends_sha256"),
        )
        if alive is not None:
            rows = rows.unionByName(alive)
        grouped = rows.groupBy("path", "chars").agg(
            F.min("low").alias("low"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("below"),
            F.sum("saved").alias("saved"),
            F.max("ends_sha256").alias("ends_sha256"),
        )
        last = F.get("chars", F.lit(depth - 1)) if depth else none
        nodes = grouped.select(
            "path",
            "chars",
            "low",
            "n_convs",
            "n_children",
            F.greatest("below", one).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved"),
            "ends_sha256",
        )
        nodes.write.option("compression", "zstd").parquet(f"{base}/depth={depth}")
        # strip the last turn: what is left groups one level up
        alive = spark.read.schema(_LEVEL).parquet(f"{base}/depth={depth}").select(
            F.substring("path", 1, max(0, depth - 1) * KEY).alias("path"),
            F.slice("chars", 1, max(0, depth - 1)).alias("chars"),
            "low",
            "n_convs",
            one.alias("n_children"),
            "n_leaves",
            "saved",
            F.lit(None).cast("string").alias("ends_sha256"),
        )
    return spark.read.schema(f"{_LEVEL}, depth int").parquet(base)


def _with_parents(children: DataFrame, nodes: DataFrame) -> DataFrame:
    """``children`` (column ``parent_key``) with ``parent_conv_id``."""
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("low").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") * HOT > children.count()  # fewer than HOT rows: the children add up to all
    few, many = F.broadcast(parents.where(hot).drop("n_children")), parents.where(~hot).drop("n_children")
    return children.join(few, "parent_key").unionByName(children.join(few, "parent_key", "left_anti").join(many, "parent_key"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, turns) rows: key, conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  A node goes by its smallest member ``conv_id`` and its depth."""
    spark = convs.sparkSession
    paths = stored(chained(convs), "trie-paths")
    ends = endings(paths).join(paths.drop("key").withColumnRenamed("conv_id", "low"), "low")
    ends = stored(ends, "trie-ends")
    private = shared_depths(ends)
    by_depth = scratch_path(spark, "trie-by-depth")
    placed = ends.join(private, "low", "left").withColumn("shared", F.coalesce("shared", "depth"))
    # by the depth at which an ending joins the descent, so that each level reads its own
    placed.repartitionByRange("shared", "low").write.option("compression", "zstd").partitionBy("shared").parquet(by_depth)
    ends = spark.read.schema(placed.schema).parquet(by_depth)

    nodes = _peel(ends, scratch_path(spark, "trie-nodes"))
    key_of = F.when(F.col("depth") > 0, _key("path", F.greatest("depth", F.lit(1)))).otherwise(F.lit(b""))
    parent_of = F.when(F.col("depth") > 1, _key("path", F.greatest(F.col("depth") - 1, F.lit(1)))).otherwise(F.lit(b""))
    none = hashlib.sha256().hexdigest()
    columns = ["key", "low", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    shared = nodes.withColumn("key", key_of).withColumn("parent_key", parent_of).select(*columns, "parent_key")

    depth = F.explode(F.sequence(F.col("shared") + 1, F.col("depth")))
    tails = ends.where("depth > shared").select("*", depth.alias("d")).select(
        _key("path", F.col("d")).alias("key"),
        "low",
        F.col("d").alias("depth"),
        F.col("n").alias("n_convs"),
        F.when(F.col("d") < F.col("depth"), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n") - 1) * F.get("rest", F.col("d") - 1)).alias("saved"),
        F.when(F.col("d") == F.col("depth"), F.col("ends_sha256")).alias("ends_sha256"),
        F.when(F.col("d") > 1, _key("path", F.greatest(F.col("d") - 1, F.lit(1)))).otherwise(F.lit(b"")).alias("parent_key"),
        (F.col("d") > F.col("shared") + 1).alias("inside"),
    )
    inside = tails.where("inside").drop("inside", "parent_key").withColumn("parent_conv_id", F.col("low"))
    children = shared.where("depth > 0").unionByName(tails.where("NOT inside").drop("inside"))
    root = shared.where("depth = 0").drop("parent_key").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    found = _with_parents(children, shared).drop("parent_key").unionByName(inside).unionByName(root)
    return found.select(
        F.hex("key").alias("key"),
        F.col("low").alias("conv_id"),
        F.col("depth").cast("bigint").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
