"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.  A
window of a few words that compresses better with the toxic dictionary than with
the ordinary one points to toxic text; the difference in bytes is the window's
*gain*.  A document's score comes from how many of its windows reach each of a
few gain thresholds, calibrated by logistic regression on labelled documents that
took no part in training the dictionaries.

Two things keep ordinary words from producing gains.  Toxic training text is made
of the words that are over-represented in toxic documents, counted by the number
of different neighbourhoods they occur in, so that a passage copied into many
documents counts once.  And the trained toxic dictionary is laid over the
ordinary one, so both know ordinary text equally well.

The model is fitted on a bounded sample of labelled documents (``Bounds``), the
first in hash order of their id; scoring reads every word of every document.

Contract for unusual input: a null, empty or wordless text scores as one empty
window; a text of any length is scored whole; repeated rows score alike; without
labelled documents of both classes every score is the share of toxic labels (0
without labels); empty tables give empty results; columns other than id and text
are ignored, and labels other than 0 and 1 too.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import text_or_empty

#: Words per window and words between window starts, per scale.
SCALES = ((6, 3), (10, 5))
#: Gains a window is counted at.
THRESHOLDS = (1, 2, 3, 4, 5)
#: A word is toxic training text from this natural-log ratio of its rates on.
MIN_LOG_RATIO = 3.0
#: Different neighbourhoods such a word occurs in at least.
MIN_CONTEXTS = 3
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 65536, 4096, 5
#: Every k-th sampled document calibrates, the others train the dictionaries.
CALIBRATE_EVERY = 4

_NOT_WORD = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Bounds:
    """Labelled documents the model is fitted on, at most, per class."""

    toxic: int = 2000
    ordinary: int = 6000


@dataclass(frozen=True)
class Model:
    """What scoring needs; a few dozen kilobytes whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: The score where no model could be fitted.
    constant: float | None = None


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document's label is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def words(text: str) -> list[str]:
    return [w for w in _NOT_WORD.split(text.lower()) if w]


def windows(doc: list[str], size: int, step: int) -> list[bytes]:
    """All windows of a document; a short document is one window."""
    return [f" {' '.join(doc[i : i + size])} ".encode("utf-8", "replace") for i in range(0, max(1, len(doc) - size + step), step)]


def toxic_words(toxic: list[list[str]], ordinary: list[list[str]]) -> dict[str, int]:
    """Over-represented words of toxic documents with the number of different
    neighbourhoods each occurs in there."""
    often = Counter(w for doc in toxic for w in doc)
    near: dict[str, set[int]] = {w: set() for w, n in often.items() if n >= MIN_CONTEXTS}
    for doc in toxic:
        for before, word, after in zip(["", *doc], doc, [*doc[1:], ""]):
            if word in near:
                near[word].add(hash((before, after)))
    contexts = {w: len(n) for w, n in near.items() if len(n) >= MIN_CONTEXTS}
    total = max(1, sum(often.values()))
    elsewhere = Counter(w for doc in ordinary for w in doc if w in contexts)
    all_elsewhere = max(1, sum(map(len, ordinary)))
    rate = np.exp(MIN_LOG_RATIO)
    return {w: n for w, n in contexts.items() if n / total > rate * (elsewhere[w] + 1) / all_elsewhere}


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on samples; where there is too little text to
    train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, d=6, k=segment, f=20, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def in_packs(pieces: list[str], rng: random.Random, size: int = 16) -> list[bytes]:
    """Shuffled words in training samples: dictionaries learn words, not passages."""
    rng.shuffle(pieces)
    return ["".join(f" {w} " for w in pieces[i : i + size]).encode("utf-8", "replace") for i in range(0, len(pieces), size)]


def train_dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, bytes]:
    """(ordinary dictionary, toxic dictionary)."""
    rng = random.Random(1)
    common = [w for doc in ordinary for w in rng.sample(sorted(set(doc)), min(64, len(set(doc))))]
    base = trained(in_packs(common, rng), ORDINARY_BYTES, 40)
    marked = [w for w, n in sorted(toxic_words(toxic, ordinary).items()) for _ in range(min(n, 50))]
    layer = trained(in_packs(marked, rng), TOXIC_BYTES, 16) if marked else b""
    return base, base + layer[-TOXIC_BYTES + 512 :]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    # as plain content: windows are too short for the dictionary's entropy tables to pay, and literals then cost alike
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    """Features and scores of documents under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.ordinary, self.toxic = compressor(model.ordinary), compressor(model.toxic)

    def features(self, doc: list[str]) -> list[float]:
        out = []
        for size, step in SCALES:
            shares = windows(doc, size, step)
            gains = np.fromiter((len(self.ordinary.compress(w)) - len(self.toxic.compress(w)) for w in shares), np.int64, len(shares))
            reached = [int((gains >= t).sum()) for t in THRESHOLDS]
            out.append(float(min(gains.max(), 8)))
            out += [float(np.log1p(n)) for n in reached]
            out += [20 * n / gains.size for n in reached[:3]]
        return [*out, float(np.log1p(len(doc)))]

    def score(self, text: str | None) -> float:
        if self.model.constant is not None:
            return self.model.constant
        row = (np.array(self.features(words(text or ""))) - self.model.mean) / self.model.scale
        return float(1 / (1 + np.exp(-np.clip(np.append(row, 1.0) @ self.model.weights, -50, 50))))


def fit_logistic(rows: np.ndarray, labels: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a ridge logistic regression, rows weighted so
    that class 1 has its ``share`` of all labels."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    z = np.column_stack([(rows - mean) / scale, np.ones(len(rows))])
    here = labels.mean()
    weight = np.where(labels == 1, share / here, (1 - share) / (1 - here))
    ridge = 1e-3 * len(rows) * np.eye(z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        slope = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        step = np.linalg.solve(slope, z.T @ (weight * (p - labels)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents outside the held-out fold."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    shares = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    empty = Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), share)
    if not (shares.get(0) and shares.get(1)):
        return empty
    order = F.xxhash64(F.lit("toxicity"), "_id")
    picked = [usable.where(F.col("toxic") == y).orderBy(order, "_id").limit(n) for y, n in ((1, bounds.toxic), (0, bounds.ordinary))]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # bounded by ``bounds``
    texts = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("_text"))
    sample = texts.join(chosen, F.col("_doc") == F.col("_id")).select("_id", "toxic", F.col("_text").alias("text"), order.alias("at"))
    rows = sorted(sample.collect(), key=lambda r: (r.at, r["_id"], r.text))
    train: dict[int, list[list[str]]] = {0: [], 1: []}
    rest: list[tuple[int, list[str]]] = []
    seen, same = Counter(), {}
    for r in rows:
        seen[r.toxic] += 1
        doc = [same.setdefault(w, w) for w in words(r.text)]  # one string per different word
        if seen[r.toxic] % CALIBRATE_EVERY:
            train[r.toxic].append(doc)
        else:
            rest.append((r.toxic, doc))
    known = np.array([y for y, _ in rest])
    if not (train[0] and train[1] and known.size and 0 < known.mean() < 1):
        return empty
    ordinary, toxic = train_dictionaries(train[1], train[0])
    model = Model(ordinary, toxic, np.zeros(0), np.zeros(0), np.zeros(0))
    scorer = Scorer(model)
    features = np.array([scorer.features(doc) for _, doc in rest])
    return Model(ordinary, toxic, *fit_logistic(features, known, share))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept."""
    model = fit(labelled_docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            keep = [scorer.score(t) < threshold for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
