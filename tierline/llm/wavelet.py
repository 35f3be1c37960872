"""Token ids in a wavelet matrix per shard.

Documents are range-partitioned and sorted by id; every task encodes its range
and writes one compressed Parquet file, the shard.  A shard is a run of segments
of about ``SEGMENT_TOKENS`` ids, whole documents each (one of any length at
least), and a segment is one row: its document ids and lengths, and its ids as a
wavelet matrix.  The matrix has one bit-plane per bit of the largest id, from
the highest bit down; each plane is a stable partition of the one before by its
bit.  With the running counts kept per 512 bits it answers, without decoding,
which token stands at a place (``access``), how often a token occurs before a
place (``rank``) and where its k-th occurrence is (``select``).

Contract for unusual input: a null or empty text is the end token alone, an
empty table writes no rows, repeated rows are written as often as they occur, a
null id sorts first, and columns other than id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierline.llm.common import slices
from tierline.llm.tokens import encoder, vocabulary

#: Vocabulary file and the id after every document.
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Ids of a segment, but for a longer document.
SEGMENT_TOKENS = 1 << 20
#: Words whose ids a worker keeps.
KEPT_WORDS = 1_000_000
#: Ids partitioned at a time, so that their places stay in the cache.
PART_IDS = 1 << 13
#: Bits between two kept counts.
BLOCK_BITS = 512

_HEADER = "<4sIQ"
_MAGIC = b"WVM1"


class WaveletMatrix:
    """Bit-planes of a sequence of unsigned ids, highest bit first."""

    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], counts: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.counts = n, zeros, planes, counts

    @property
    def bits(self) -> int:
        return len(self.planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, counts = [], [], []
        for bit in reversed(range(bits)):
            ones = (row & row.dtype.type(1 << bit)).astype(bool)
            plane = np.packbits(ones)
            plane = np.pad(plane, (0, -plane.size % (BLOCK_BITS // 8)))
            blocks = np.bitwise_count(plane).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
            planes.append(plane)
            counts.append(np.concatenate([[0], np.cumsum(blocks)]).astype("<u4"))
            zeros.append(row.size - int(counts[-1][-1]))
            parted, low, high = np.empty_like(row), 0, zeros[-1]
            for at in range(0, row.size, PART_IDS):
                part, up = row[at : at + PART_IDS], ones[at : at + PART_IDS]
                down, up = np.flatnonzero(~up), np.flatnonzero(up)
                parted[low : low + down.size], parted[high : high + up.size] = part[down], part[up]
                low, high = low + down.size, high + up.size
            row = parted
        return cls(ids.size, np.array(zeros, "<u4"), planes, counts)

    def to_bytes(self) -> bytes:
        parts = [struct.pack(_HEADER, _MAGIC, self.bits, self.n), self.zeros.tobytes()]
        for plane, count in zip(self.planes, self.counts):
            parts += [plane.tobytes(), count.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n = struct.unpack_from(_HEADER, data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        at = struct.calcsize(_HEADER)
        zeros = np.frombuffer(data, "<u4", bits, at)
        at += zeros.nbytes
        n_blocks = -(-n // BLOCK_BITS)
        planes, counts = [], []
        for _ in range(bits):
            planes.append(np.frombuffer(data, np.uint8, n_blocks * BLOCK_BITS // 8, at))
            at += planes[-1].nbytes
            counts.append(np.frombuffer(data, "<u4", n_blocks + 1, at))
            at += counts[-1].nbytes
        return cls(n, zeros, planes, counts)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        block = at // BLOCK_BITS
        first = block * (BLOCK_BITS // 8)
        ones = int(self.counts[level][block]) + int(np.bitwise_count(self.planes[level][first : at >> 3]).sum(dtype=np.int64))
        if at & 7:
            ones += (int(self.planes[level][at >> 3]) >> (8 - (at & 7))).bit_count()
        return ones

    def _step(self, level: int, at: int, bit: int) -> int:
        """Where a place of one plane comes to stand in the next."""
        ones = self._ones(level, at)
        return int(self.zeros[level]) + ones if bit else at - ones

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for level in range(self.bits):
            bit = self._bit(level, at)
            token = token << 1 | bit
            at = self._step(level, at, bit)
        return token

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        low, high = 0, upto
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            low, high = self._step(level, low, bit), self._step(level, high, bit)
        return low, high

    def rank(self, token: int, upto: int) -> int:
        """Occurrences of a token before a place."""
        if token >> self.bits:
            return 0
        low, high = self._range(token, upto)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of a token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0)[0] + k
        for level in reversed(range(self.bits)):
            if token >> (self.bits - 1 - level) & 1:
                at = self._find(level, at - int(self.zeros[level]), 1)
            else:
                at = self._find(level, at, 0)
        return at

    def _find(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th bit of a kind in a plane."""
        ones = self.counts[level].astype(np.int64)
        seen = ones if bit else np.arange(ones.size) * BLOCK_BITS - ones
        block = int(np.searchsorted(seen, k, side="right")) - 1
        first = block * (BLOCK_BITS // 8)
        bits = np.unpackbits(self.planes[level][first : first + BLOCK_BITS // 8])
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(seen[block])])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the lowest bit up."""
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            before = np.empty_like(row)
            zeros = int(self.zeros[level])
            before[np.flatnonzero(~ones)] = row[:zeros]
            before[np.flatnonzero(ones)] = row[zeros:] | row.dtype.type(1 << (self.bits - 1 - level))
            row = before
        return row


def segments(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The rows of the shards, one per segment, in ascending id order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, shard = encoder(vocabulary_path, KEPT_WORDS), array("I", [end_id]).tobytes(), TaskContext.get().partitionId()
        bits = max(words.tokenizer.get_vocab_size(), end_id + 1).bit_length()
        number, start, held, ids, docs_held = 0, 0, 0, [], []

        def segment() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(ids), "<u4")
            matrix = WaveletMatrix.build(data, bits).to_bytes()
            lengths = pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64()))
            values = pa.array([docs_held], pa.list_(id_type))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([data.size], pa.int64()), values, lengths, pa.array([matrix], pa.binary())],
                ["shard", "segment", "shard_start", "n_tokens", "doc_ids", "lengths", "matrix"],
            )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            low = 0
            for texts in slices(batch.column(1)):
                part, low = batch.slice(low, len(texts)), low + len(texts)
                for doc, data in zip(part.column(0).to_pylist(), words.encode([t or "" for t in texts.to_pylist()])):
                    ids.append(data + end)
                    docs_held.append(doc)
                    held += len(ids[-1]) // 4
                    if held >= segment_tokens:
                        yield segment()
                        number, start, held, ids, docs_held = number + 1, start + held, 0, [], []
        if ids:
            yield segment()

    return ordered.mapInArrow(
        run,
        f"shard int, segment int, shard_start long, n_tokens long, doc_ids array<{kind}>, lengths array<long>, matrix binary",
    )


def write_shards(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = END_ID, **options) -> None:
    """Write the shards under ``path``, one compressed file per task."""
    rows = segments(docs, vocabulary_path or vocabulary(VOCABULARY), end_id, **options)
    rows.write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, decoded from the shards: id, start (ids of all
    documents before it), n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)  # an empty write leaves a file with the schema
    # one row per shard, that is per task of the write
    totals = shards.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    placed = shards.join(F.broadcast(offsets), "shard").select(
        "doc_ids", "lengths", "matrix", (F.col("offset") + F.col("shard_start")).alias("at")
    )
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = WaveletMatrix.from_bytes(batch.column("matrix")[row].as_py()).decode()
                lengths = batch.column("lengths")[row].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(starts + batch.column("at")[row].as_py()), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, segment, n_found, places): occurrences of a token, counted and
    located by rank and select on the matrices; places are shard offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrices = [WaveletMatrix.from_bytes(m.as_py()) for m in batch.column("matrix")]
            found = [m.count(token) for m in matrices]
            starts = batch.column("shard_start").to_pylist()
            places = [[s + m.select(token, k) for k in range(n)] for m, n, s in zip(matrices, found, starts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("segment"), pa.array(found, pa.int64()), pa.array(places, pa.list_(pa.int64()))],
                ["shard", "segment", "n_found", "places"],
            )

    rows = spark.read.parquet(path).select("shard", "segment", "shard_start", "matrix")
    return rows.mapInArrow(run, "shard int, segment int, n_found long, places array<long>")
