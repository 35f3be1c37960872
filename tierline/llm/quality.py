"""Quality classifier: naive Bayes features under a linear support vector machine.

*Indicators.*  A document is the set of its n-grams.  Word n-grams (one and two
consecutive words, without signs at their ends, lower case) say what it is about;
class n-grams (one to three) say how it is written.  A word's class is its shape (runs
of capitals, small letters and digits as one sign each, all other signs as they stand)
with whether it repeats the word before it or the one before that.  A class n-gram
gives one indicator for every share of the document that it reaches, 1/2^k for k up to
``LEVELS``, so that a set of indicators still tells a stray sign from a page of them.
Indicators are hashed to ``WORD_DIMS`` + ``CLASS_DIMS`` columns.

*Model.*  Each indicator is scaled by its log-count ratio, the logarithm of its share
of the indicators of good documents over its share of those of bad ones, and rows are
scaled to length one.  A linear model with hinge loss is fitted to them by dual
coordinate descent.  Documents that neither the ratios nor the descent have seen
calibrate its margins to probabilities by logistic regression.

*Spark's part.*  The model is fitted on a bounded sample of labelled documents
(``Bounds``: rows per class and indicators in all), the first in hash order of their
id, whose indicators are computed in tasks.  Scoring reads every word of every
document, Arrow batch by Arrow batch, a few megabytes of text at a time.

Contract for unusual input: a null, empty or blank text has no n-grams and scores as the
intercept says; texts are read whole; repeated rows score alike; a null id is held out;
without labelled documents of both classes every score is the share of label 1 (0
without labels); labels other than 0 and 1 are ignored, of several for one id the
largest counts; an empty table gives an empty result; columns other than id and text
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import slices, text_or_empty

WORD_DIMS, CLASS_DIMS = 1 << 18, 1 << 16
#: Class n-grams are told apart by reaching 1, 1/2, ... 1/2^LEVELS of a document.
LEVELS = 6
#: Longest word and class n-grams.
WORD_RUN, CLASS_RUN = 2, 3
#: Documents a column must occur in, smoothing of its counts, weight of the hinge loss.
MIN_DOCS, SMOOTHING, PENALTY = 5, 1.0, 1.0
#: One in this many sampled documents calibrates.
CALIBRATE_EVERY = 5

_SIGNS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_CAPITALS, _SMALL, _DIGITS = regex.compile(r"[\p{Lu}\p{Lt}]+"), regex.compile(r"[\p{L}\p{M}--[\p{Lu}\p{Lt}]]+", regex.V1), regex.compile(r"\p{N}+")


@dataclass(frozen=True)
class Bounds:
    """What the model is fitted on, at most: documents of label 0 and 1, and
    indicators in all (four bytes each on the driver)."""

    bad: int = 5000
    good: int = 7000
    indicators: int = 1 << 24


@dataclass(frozen=True)
class Model:
    """Column weights, a few megabytes whatever the corpus."""

    #: Squared ratio and weight times ratio, per column.
    squared: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    #: The score where no model could be fitted.
    constant: float | None = None


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a document's label is never learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(True))


def shape(word: str) -> str:
    """The word with runs of capitals, small letters and digits as A, a, 0."""
    if word.isascii() and word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
    return _DIGITS.sub("0", _SMALL.sub("a", _CAPITALS.sub("A", word)))


def _mix(left: np.ndarray, right: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two 64-bit codes, element by element."""
    code = left * np.uint64(0x9E3779B97F4A7C15) + np.asarray(right, np.uint64)
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def _runs(codes: np.ndarray, doc: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, codes) of the runs of each length up to ``longest``."""
    run = _mix(codes, 1)
    for length in range(1, longest + 1):
        last = doc.size - length + 1
        if last <= 0:
            return
        inside = doc[:last] == doc[length - 1 :]
        yield doc[:last][inside], run[:last][inside]
        if last > 1:
            run = _mix(run[: last - 1], codes[length:])


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) of every indicator, ascending and without repeats."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    solid = pc.not_equal(flat, "")
    doc = parent.filter(solid).to_numpy().astype(np.int64)
    encoded = flat.filter(solid).dictionary_encode()
    at = encoded.indices.to_numpy()
    vocabulary = encoded.dictionary.to_pylist()
    n = len(vocabulary)
    core = np.fromiter((zlib.crc32(w.strip(_SIGNS).lower().encode()) for w in vocabulary), np.uint64, n)
    shapes = np.fromiter((zlib.crc32(shape(w).encode()) for w in vocabulary), np.uint64, n)
    word, kind = core[at], shapes[at]
    repeat = np.zeros(doc.size, np.uint64)
    for back in (2, 1):
        same = (word[back:] == word[:-back]) & (doc[back:] == doc[:-back])
        repeat[back:][same] = back
    size = np.bincount(doc, minlength=len(texts))

    found = [(np.arange(len(texts)), _mix(np.log2(size + 1).astype(np.uint64), 7) % np.uint64(CLASS_DIMS) + np.uint64(WORD_DIMS))]
    for docs, codes in _runs(word, doc, WORD_RUN):
        found.append((docs, codes % np.uint64(WORD_DIMS)))
    for length, (docs, codes) in enumerate(_runs(_mix(kind, repeat), doc, CLASS_RUN)):
        order = np.lexsort((codes, docs))
        docs, codes = docs[order], codes[order]
        first = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (codes[1:] != codes[:-1])))
        count = np.diff(np.append(first, docs.size))
        docs, codes = docs[first], codes[first]
        level = np.floor(np.log2((size[docs] - length) / count)).astype(np.int64)
        for k in range(LEVELS + 2):  # the last one says that it occurs at all
            reached = level <= k if k <= LEVELS else slice(None)
            found.append((docs[reached], _mix(codes[reached], k + 16) % np.uint64(CLASS_DIMS) + np.uint64(WORD_DIMS)))
    dims = WORD_DIMS + CLASS_DIMS
    pairs = np.unique(np.concatenate([d * dims + c.astype(np.int64) for d, c in found]))
    return pairs // dims, pairs % dims


def _string(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string())


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, dims: int) -> np.ndarray:
    """Per column: log of its share of label 1's indicators over its share of
    label 0's, smoothed; 0 for columns of fewer than ``MIN_DOCS`` documents."""
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == c]), minlength=dims) + SMOOTHING for c in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return np.where(counts[0] + counts[1] - 2 * SMOOTHING >= MIN_DOCS, ratio, 0.0)


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, dims: int, rounds: int = 60, close: float = 1e-3
) -> np.ndarray:
    """Weights (the intercept last) of the linear model that minimises half its
    squared length plus ``cost`` times the hinge losses.  One dual variable per
    row, between 0 and the row's cost, is moved to its optimum at a time."""
    sign = np.where(labels == 1, 1.0, -1.0)
    weights, dual = np.zeros(dims + 1), np.zeros(len(rows))
    curve = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        low, high = np.inf, -np.inf
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1.0
            free = min(slope, 0.0) if dual[i] == 0 else max(slope, 0.0) if dual[i] == cost[i] else slope
            low, high = min(low, free), max(high, free)
            if free:
                now = min(max(dual[i] - slope / curve[i], 0.0), cost[i])
                step = (now - dual[i]) * sign[i]
                weights[rows[i]] += step * values[i]
                weights[-1] += step
                dual[i] = now
        if high - low < close:
            break
    return weights


def calibrate(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from margins to the probability of
    label 1, rows weighted so that label 1 has its ``share``."""
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels == 1, share / n1, (1 - share) / n0) * labels.size
    z = np.column_stack([margins, np.ones(labels.size)])
    line = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ line, -50, 50)))
        bend = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, z.T @ (weight * (p - goal)))
        line -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(line[0]), float(line[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """The model of sampled documents, given as their columns."""
    dims = WORD_DIMS + CLASS_DIMS
    kept = np.arange(len(rows)) % CALIBRATE_EVERY == 0
    train = [r for r, k in zip(rows, kept) if not k]
    known = labels[~kept]
    if not (0 < known.sum() < known.size and 0 < labels[kept].sum() < kept.sum()):
        return Model(constant=share)
    ratio = log_count_ratio(train, known, dims)
    values = [ratio[r] for r in train]
    values = [v / max(float(np.sqrt(v @ v)), 1e-12) for v in values]
    cost = PENALTY * np.where(known == 1, share / known.mean(), (1 - share) / (1 - known.mean()))
    weights = dual_coordinate_descent(train, values, known, cost, dims)
    model = Model(ratio**2, weights[:-1] * ratio, float(weights[-1]))
    margins = np.array([margin(model, np.zeros(r.size, np.int64), r, 1)[0] for r, k in zip(rows, kept) if k])
    slope, offset = calibrate(margins, labels[kept], share)
    return Model(model.squared, model.weight, model.intercept, slope, offset)


def margin(model: Model, doc: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """Margins of n documents from their (document, column) indicators."""
    length = np.sqrt(np.bincount(doc, weights=model.squared[column], minlength=n))
    return np.bincount(doc, weights=model.weight[column], minlength=n) / np.maximum(length, 1e-12) + model.intercept


def fit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max("quality").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if not (counts.get(0) and counts.get(1)):
        return Model(constant=share)
    order = F.xxhash64(F.lit("quality"), "_id")
    picked = [known.where(F.col("quality") == y).orderBy(order, "_id").limit(n) for y, n in ((0, bounds.bad), (1, bounds.good))]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # bounded by ``bounds``
    texts = docs.select(F.col(f"`{id_col}`").alias("_doc"), text_or_empty(F.col(f"`{text_col}`")).alias("_text"))
    sample = texts.join(chosen, F.col("_doc") == F.col("_id")).select(order.alias("at"), "quality", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for part in slices(_string(batch.column(2))):
                doc, column = indicators(part)
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                rows = [column[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:])]
                own = batch.slice(low, len(part))
                low += len(part)
                columns = [own.column(0), own.column(1), pa.array(np.diff(ends)), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["at", "quality", "n", "columns"])

    found = sample.mapInArrow(run, "at long, quality int, n long, columns binary")
    # ids may repeat among the documents: at most so many rows, and so many indicators, come to the driver
    ordered = ["at", "n", "columns"]
    found = found.orderBy(*ordered).limit(bounds.bad + bounds.good)
    upto = Window.partitionBy(F.lit(0)).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("total", F.sum("n").over(upto)).where(F.col("total") <= bounds.indicators).orderBy(*ordered).select("quality", "columns").toArrow()
    columns = [np.frombuffer(b.as_buffer(), "<u4").astype(np.int64) for b in rows["columns"].combine_chunks()] if rows.num_rows else []
    return fit_rows(columns, rows["quality"].to_numpy().astype(np.int64), share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [margin(model, *indicators(part), len(part)) for part in slices(_string(batch.column(1)))] if model.constant is None else []
            if model.constant is not None:
                found = np.full(batch.num_rows, model.constant)
            else:
                found = 1 / (1 + np.exp(-np.clip(model.slope * np.concatenate([*margins, np.zeros(0)]) + model.offset, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
