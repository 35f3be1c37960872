"""Exact deduplication over an extendible-hash index on shared files.

The index is built with DataFrame operations only:

1. every row gets a 64-bit key, the hash of its normalised text;
2. the *directory* starts as one bucket and doubles while a bucket holds more
   than ``capacity`` distinct keys: a bucket of local depth d is the set of
   keys that share their d top bits, and an overfull one splits into the two
   of depth d + 1.  The depth it may reach follows the number of keys;
3. the texts of a key are chained: equal ones, compared byte by byte, fold into
   one link, on the map side already, so a hot text reaches its owner as one row
   per map task; different texts with one hash are further links;
4. owner tasks take contiguous bucket ranges and write their part of the index,
   a row per link: bucket, key, place in the chain, SHA-256;
5. every row finds its link as a reader of the index does: the directory names
   the bucket of its key, the key's chain there is compared with its digest.  Rows
   at one link are copies of each other.

Contract for unusual input: a null text counts as the empty text, an empty
table gives an empty result, rows that repeat a doc_id are copies of each other
when their texts are equal, and columns other than id and text are ignored.
A null id loses against any other id as the row that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import WHITE_SPACE, stored, text_or_empty

#: Distinct keys a bucket may hold before it splits.
CAPACITY = 1024
#: Bits by which the directory may outgrow an even spread of the keys, and the most rows
#: of it that are broadcast.
SPARE_BITS, BROADCAST_ROWS = 3, 1 << 14


def normalised(text: str | Column = "text") -> Column:
    """The text with every run of ASCII white space as one space."""
    return F.regexp_replace(text_or_empty(text), WHITE_SPACE, " ")


def text_key(text: Column, key_bits: int = 64) -> Column:
    """The key of a normalised text: its 64-bit hash, or its top bits only
    (fewer bits make different texts collide, which tests use)."""
    key = F.xxhash64(text)
    return F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits) if key_bits < 64 else key


def depth_for(keys: DataFrame, capacity: int = CAPACITY) -> int:
    """The depth the directory of so many keys may reach."""
    n = keys.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    return min(40, max(1, (n // capacity).bit_length() + SPARE_BITS))


def directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """The buckets of the column ``key``: one row (bucket, depth, n_keys) per
    leaf.  ``bucket`` is the first ``max_depth``-bit prefix it covers, so
    bucket order is key order."""
    fine = (
        keys.select("key").distinct()
        .groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n_keys"))
    )
    # every doubling at once: the key count of each prefix at each depth
    depth = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    levels = (
        fine.select(depth, "prefix", "n_keys")
        .groupBy("depth", F.expr(f"shiftright(prefix, {max_depth} - depth)").alias("node"))
        .agg(F.sum("n_keys").alias("n_keys"))
    )
    parents = levels.where(F.col("n_keys") > capacity).select(
        (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")
    )
    is_leaf = (F.col("n_keys") <= capacity) | (F.col("depth") == max_depth)
    leaves = levels.where(is_leaf).withColumn("parent", F.expr("if(depth = 0, -1, shiftright(node, 1))"))
    roots = leaves.where("depth = 0")
    split = leaves.where("depth > 0").join(parents, ["depth", "parent"], "left_semi")
    return roots.unionByName(split).select(
        F.expr(f"shiftleft(node, {max_depth} - depth)").alias("bucket"), "depth", "n_keys"
    )


def pointers(buckets: DataFrame, max_depth: int) -> DataFrame:
    """The directory proper: one row per ``max_depth``-bit prefix that a leaf
    covers, pointing at its bucket (2^max_depth rows at most)."""
    last = F.expr(f"bucket + shiftleft(1L, {max_depth} - depth) - 1")
    return buckets.select(F.explode(F.sequence("bucket", last)).alias("prefix"), "bucket")


def in_buckets(rows: DataFrame, buckets: DataFrame, max_depth: int) -> DataFrame:
    """``rows`` with the bucket that the directory names for their key."""
    named = pointers(buckets, max_depth)
    if 1 << max_depth <= BROADCAST_ROWS:
        named = F.broadcast(named)  # 2^max_depth rows at most
    return rows.withColumn("prefix", F.shiftrightunsigned("key", 64 - max_depth)).join(named, "prefix").drop("prefix")


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_depth: int | None = None,
    key_bits: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """(keys, index), both stored.  ``keys`` has a row per document: id, key,
    text_sha256, bucket.  ``index`` has a row per different text: bucket, key,
    chain (0 for the first text of a key), text_sha256."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("key", text_key(F.col("norm"), key_bits))
    keys = stored(rows.select("id", "key", F.sha2("norm", 256).alias("text_sha256")), "exact-keys")
    depth = max_depth or depth_for(keys, capacity)
    buckets = stored(directory(keys, capacity, depth), "exact-directory")

    # a set of texts per key compares the bytes and folds copies before and after the shuffle
    chains = rows.groupBy("key").agg(F.array_sort(F.collect_set("norm")).alias("texts"))
    digests = F.transform("texts", lambda t: F.sha2(t.cast("binary"), 256))
    # readers find their link by digest; two texts with one digest would make it ambiguous
    told_apart = F.expr("if(size(array_distinct(digests)) = size(digests), digests, raise_error('two texts share a SHA-256 digest'))")
    owned = in_buckets(chains.select("key", digests.alias("digests")), buckets, depth).repartitionByRange("bucket")
    links = owned.select("bucket", "key", F.posexplode(told_apart).alias("chain", "text_sha256"))
    return in_buckets(keys, buckets, depth), stored(links, "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per document: id, keep_id (smallest id of its text),
    group_size, kept, text_sha256.  When the kept id itself repeats, all its
    rows are marked kept; ``survivors`` keeps one."""
    keys, links = build_index(docs, id_col, text_col, **index)
    link = ["bucket", "key", "text_sha256"]
    groups = keys.groupBy(*link).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = keys.join(links.join(groups, link), link)
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts
    the row with the smallest id and, where that id repeats with its text, the
    least of those rows by its columns in order (columns that hold a map have no
    order and do not count)."""
    digest = F.sha2(normalised(text_col), 256)
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_keep"), F.col("text_sha256").alias("_kept_digest"))
    named = {f.name: F.col(f"`{f.name}`") for f in docs.schema.fields}
    order = F.struct(*[named[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    rows = docs.groupBy(F.col(id_col).alias("_id"), digest.alias("_digest")).agg(
        F.min_by(F.struct(*named.values()), order).alias("row")
    )
    same = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("_kept_digest"))
    return rows.join(kept, same, "left_semi").select("row.*")
