"""Packing: concatenate all documents' tokens and cut fixed windows.

1. Every task encodes its documents, gives each its offset inside the task and
   stores the ids: one row per document, no shuffle.
2. Totals per task (one row each) become global offsets by a prefix sum.
3. Every document, knowing its global offset, is cut at multiples of the
   sequence length into boundary records: where a piece starts in its document,
   which sequence it goes to and at which place.

Sequences are full but for the last.  A short last sequence is padded to the
sequence length when it is consumed, unless its length is a power of two;
``padded_length`` tells.

Contract for unusual input: a null or empty text is the end token alone, an
empty table gives no pieces, repeated rows are packed as often as they occur,
texts of any length are cut into as many pieces as they need, and columns other
than id and text are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import slices, stored
from tierline.llm.tokens import encoder, vocabulary

#: Tokens of a sequence, id after every document, vocabulary file.
SEQUENCE_TOKENS = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


def encoded(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, task, task_start): the ids of every document as
    little-endian unsigned 32-bit values, end id included, and the number of ids
    before it in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, at, task = encoder(vocabulary_path), array("I", [end_id]).tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            low = 0
            for texts in slices(batch.column(1)):  # some texts and ids at a time
                part, low = batch.slice(low, len(texts)), low + len(texts)
                ids = [x + end for x in words.encode([t or "" for t in texts.to_pylist()])]
                sizes = [len(x) // 4 for x in ids]
                starts = []
                for size in sizes:
                    starts.append(at)
                    at += size
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64())],
                    ["id", "ids", "n_tokens", "task", "task_start"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, n_tokens long, task int, task_start long")


def task_offsets(rows: DataFrame) -> DataFrame:
    """(task, offset): tokens before each task, from one row per task."""
    totals = rows.groupBy("task").agg(F.sum("n_tokens").alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))


def pieces(
    docs: DataFrame,
    vocabulary_path: str | None = None,
    end_id: int = END_ID,
    sequence_tokens: int = SEQUENCE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start (tokens of its document before it),
    length, ids, doc_tokens, sequence_id, offset (place in the sequence)."""
    rows = stored(encoded(docs, vocabulary_path or vocabulary(VOCABULARY), end_id, id_col, text_col), "pack-ids")
    # one row per task of the first pass
    placed = rows.join(F.broadcast(task_offsets(rows)), "task")
    placed = placed.select("id", "ids", "n_tokens", (F.col("offset") + F.col("task_start")).alias("at"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):  # few documents' ids at a time
                batch = whole.slice(low, 512)
                source, start, length, ids, total, sequence, offset = [], [], [], [], [], [], []
                for row, (doc, n, at) in enumerate(zip(batch.column("ids"), batch.column("n_tokens").to_pylist(), batch.column("at").to_pylist())):
                    data, done = doc.as_py(), 0
                    while done < n:
                        place = (at + done) % sequence_tokens
                        size = min(n - done, sequence_tokens - place)
                        source.append(row)
                        start.append(done)
                        length.append(size)
                        ids.append(data[4 * done : 4 * (done + size)])
                        total.append(n)
                        sequence.append((at + done) // sequence_tokens)
                        offset.append(place)
                        done += size
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(source, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, sequence, offset))],
                    ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    cut_rows = placed.mapInArrow(
        cut, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return cut_rows.withColumnRenamed("id", id_col)


def padded_length(length: int, sequence_tokens: int = SEQUENCE_TOKENS) -> int:
    """Length of a sequence of ``length`` tokens once padded."""
    return length if length & (length - 1) == 0 else sequence_tokens


def sequences(packed: DataFrame, pad_id: int = 0, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """(sequence_id, n_tokens, ids): the padded sequences of ``pieces``.  A
    sequence has at most ``sequence_tokens`` pieces, so groups are bounded."""
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.expr("aggregate(parts, cast('' as binary), (done, p) -> concat(done, p.ids))")
    power = F.expr("n_tokens & (n_tokens - 1)") == 0
    missing = F.when(power, 0).otherwise(sequence_tokens - F.col("n_tokens")).cast("int")
    pad = F.lit(array("I", [pad_id]).tobytes())
    padding = F.when(missing > 0, F.unhex(F.repeat(F.hex(pad), missing))).otherwise(F.lit(b""))
    return parts.select("sequence_id", "n_tokens", F.concat(joined, padding).alias("ids"))


