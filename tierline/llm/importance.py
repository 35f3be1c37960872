"""Importance resampling of documents towards a target distribution.

A document's features are its runs of one to three consecutive words, hashed to
buckets.  The log ratio of a bucket's rates in the target texts and in the corpus is
its gain; a document's weight is the sum of the gains of its features.  Adding Gumbel
noise to the weights and taking the highest is a draw without replacement in
proportion to the importance weights.

*Words* come from an untrained ``Split`` pre-tokenizer of the ``tokenizers`` library
over the text with A-Z lowered, which returns each word with its offsets.  The words,
one space between them, make one buffer; the runs are windows over its offset pairs,
the start of one word and the end of the same or a later one, so no run is ever joined
as a string.

*Spark's part.*  One pass over the texts stores each document's buckets, two bytes a
feature.  Every task adds up one histogram of its rows' buckets, and the histograms
are summed by bucket: 10,000 rows reach the driver for the corpus and as many for the
target, whatever their size.  The gains travel to the tasks that sum them over each
document's stored buckets.  The draw is a distributed ranking of (score, id); no row is
collected and none goes through a single task.

Contract for unusual input: a null, empty or wordless text has no features and weight
0; texts are read whole; a null id counts as the text ``null`` in the noise and comes
last among equal scores; rows that repeat an id have equal noise, are drawn one by one
and take consecutive ranks in any order; without target texts every gain follows from
the corpus alone; an empty corpus gives an empty result.  Other columns are not read
unless asked for, and come back inside one struct, so their names cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from tierline.llm.common import stored
from tierline.operators.ranking import CNT, POS, add_positions

#: A word of lowered text: ASCII letters and digits and all beyond ASCII (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 with those of A-Z lowered; no other character has such bytes.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Settings:
    """What the draw depends on."""

    longest: int = 3
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 5
    seed: str = "42"


class Features:
    """Buckets of a text's features."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.cut = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)

    def buckets(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every feature)."""
        words = [word.encode() for word, _ in self.cut.pre_tokenize_str((text or "").encode().translate(_LOWER).decode())]
        buffer = b" ".join(words)
        ends = np.cumsum([len(word) + 1 for word in words], dtype=np.int64) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words)].tolist()
        ends = ends.tolist()
        runs = []
        for length in range(self.settings.longest):
            windows = map(slice, starts, ends[length:])
            runs.append(np.fromiter(map(zlib.crc32, map(buffer.__getitem__, windows)), np.uint32, max(0, len(words) - length)))
        return len(words), np.concatenate(runs) % self.settings.buckets


def bucketed(texts: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``texts`` with ``n_words`` and, in the text's place, its ``features``:
    the buckets as little-endian unsigned numbers of ``_width`` bytes."""
    place = texts.columns.index(text_col)
    others = [i for i in range(len(texts.columns)) if i != place]
    names = [*(texts.columns[i] for i in others), "n_words", "features"]
    kind = _width(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # the features of a few texts at a time
                part = batch.slice(low, 256)
                found = [features.buckets(text.as_py()) for text in part.column(place)]
                stats = [pa.array([n for n, _ in found], pa.int64()), pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *stats], names)

    schema = texts.drop(text_col).schema.add("n_words", "long").add("features", "binary")
    return texts.mapInArrow(run, schema)


def _width(settings: Settings) -> str:
    return "<u2" if settings.buckets <= 1 << 16 else "<u4"


def histogram(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(bucket, n): features of all texts by bucket, at most ``buckets`` rows."""
    kind = _width(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for buckets in batch.column(0):
                total += np.bincount(np.frombuffer(buckets.as_buffer(), kind), minlength=settings.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return found.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(hist: DataFrame, settings: Settings) -> list[int]:
    found = {r.bucket: r.n for r in hist.collect()}  # at most ``buckets`` rows
    return [found.get(b, 0) for b in range(settings.buckets)]


def gains(corpus: Sequence[int], target: Sequence[int]) -> np.ndarray:
    """Gain of every bucket in thousandths, from the two histograms."""
    size = len(corpus)
    up, down = float(sum(corpus) + size), float(sum(target) + size)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * up) / ((s + 1.0) * down))) for s, t in zip(corpus, target)], np.int64)


def noise(id_text: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(found: DataFrame, gain: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """``found`` with (n_features, weight) in the place of its features."""
    place = found.columns.index("features")
    others = [i for i in range(len(found.columns)) if i != place]
    names = [*(found.columns[i] for i in others), "n_features", "weight"]
    kind = _width(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(buckets.as_buffer(), kind) for buckets in batch.column(place)]
            sums = [pa.array([row.size for row in rows], pa.int64()), pa.array([int(gain[row].sum()) for row in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), *sums], names)

    schema = found.drop("features").schema.add("n_features", "long").add("weight", "long")
    return found.mapInArrow(run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    carry: Sequence[str] = (),
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score and rank
    (1, 2, 3 ... for drawn documents, else null), and the columns ``carry`` of
    ``docs`` as the struct ``row``.

    The ``percent`` of the documents with at least ``min_words`` words that
    score highest are drawn, ties to the smaller id."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried)
    goal = target.select(F.col(f"`{target_col}`").cast("string").alias("text"))
    # one pass over the texts; the sums and the ranking below read numbers only
    found = stored(bucketed(rows, settings=settings), "importance-features")
    corpus = _counts(histogram(found, settings), settings)
    gain = gains(corpus, _counts(histogram(bucketed(goal, settings=settings), settings), settings))
    id_text = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    scored = weigh(found, gain, settings).withColumn("score", F.col("weight") + noise(id_text, settings.seed))
    scored = stored(scored, "importance-scored")

    enough = scored.where(F.col("n_words") >= settings.min_words)
    ordered = enough.withColumn("_down", -F.col("score")).withColumn("_unnamed", F.col("id").isNull())
    placed = add_positions(ordered, ["_down", "_unnamed", "id"])
    drawn = F.when(F.col(POS) <= F.floor(F.col(CNT) * settings.percent / 100), F.col(POS)).alias("rank")
    others = scored.where(F.col("n_words") < settings.min_words).select("*", F.lit(None).cast("long").alias("rank"))
    return placed.select(*scored.columns, drawn).unionByName(others).withColumnRenamed("id", id_col)
