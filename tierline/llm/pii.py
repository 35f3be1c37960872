"""Personal data: base patterns, and bootstrapped contextual extraction.

Base entities (e-mail and IP addresses, card and phone numbers) are the seeds.
The one and the two words before an entity are lexical *patterns*.  A pattern is
reliable when most of its occurrences in the whole corpus are followed by an
entity of its kind, and a reliable pattern makes identifiers of other shapes
behind it likely: obfuscated addresses, numbers without the country code or with
a wrong check digit, IPv6 addresses.  Patterns and instances form a graph that is
scored in rounds:

* a pattern's confidence is the sum of the scores of its mentions divided by all
  occurrences of its words in the corpus;
* an instance's score is 1 for seeds, else the noisy-or of its patterns'
  confidences over all its mentions.

Instances that reach ``ACCEPT`` through patterns with at least ``MIN_SUPPORT``
different seeds are added; base entities always stay.

Contract for unusual input: a null or empty text has no entities, texts are read
whole whatever their length, repeated rows have the same entities (a pattern's
support counts different seeds, so copies do not add to it), rows keep their own spans
when ids are null or repeat with different texts (rows are told apart by a number of
their own), an empty table gives an empty result, and columns other than id and text
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import stored, text_or_empty

# The base patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails at the first digit of a run fails at the others, hence the look-behind
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Different seeds a pattern needs, score an instance needs, scoring rounds.
MIN_SUPPORT = 5
ACCEPT = 0.8
ROUNDS = 3
#: Characters before an entity in which its context words must lie.
CONTEXT_CHARS = 80
#: Bits of the filter that tells tasks which contexts are worth counting.
FILTER_BITS = 1 << 20

_DIGIT = re.compile(r"[0-9]")
_CONTEXT_WORD = re.compile(r"[^\W\d_]+|[:=#]")
# shapes that only context makes personal data
_VEILED = re.compile(r"[\w.%+-]+\s?(?:\(at\)|\[at\]|\{at\})\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[\w-]+)*", re.I)
_LOCAL_HOST = re.compile(r"(?<![^\s<>()\"'])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?![A-Za-z0-9.@-])")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![\w:])")
_NUMBER = re.compile(r"(?<![\w+.])[0-9(](?:[\x20()./-]?[0-9]){6,18}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their signs: the
    characters of a local part run up to the sign, so only the run's start can
    begin a match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_entities(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base entities, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of identifier-shaped spans clear of base ones;
    a number may stand for two kinds."""
    found = []
    if "@" in text:
        found += [(0, *m.span()) for m in _LOCAL_HOST.finditer(text)]
    if "(at)" in text.lower() or "[at]" in text.lower() or "{at}" in text.lower():
        found += [(0, *m.span()) for m in _VEILED.finditer(text)]
    if _DIGIT.search(text):
        if ":" in text:
            found += [(1, *m.span()) for m in _IPV6.finditer(text)]
        for m in _NUMBER.finditer(text):
            n = sum(c in "0123456789" for c in m.group())
            found += [(3, *m.span())] * (7 <= n <= 15) + [(2, *m.span())] * (13 <= n <= 19)
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    out = []
    for kind, a, b in found:
        before = int(np.searchsorted(starts, b))  # base spans that start before this one ends
        if before == 0 or ends[before - 1] <= a:
            out.append((kind, a, b))
    return out


def contexts(text: str, start: int) -> list[str]:
    """The patterns before a place: its last word, and its last two."""
    low = max(0, start - CONTEXT_CHARS)
    found = [m for m in _CONTEXT_WORD.finditer(text, low, start) if m.start() > low or low == 0]
    words = [m.group().lower() for m in found[-2:]]
    return [" ".join(words[i:]) for i in range(len(words))]


def instance(kind: int, text: str) -> str:
    """An identifier without its way of writing."""
    return text.lower() if kind < 2 else re.sub(r"[^0-9]", "", text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans (base entities) and mentions (base
    entities and candidates with their patterns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            spans, mentions = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_entities(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                both = [(True, *s) for s in base] + [(False, *s) for s in candidates(text, base)]
                mentions.append(
                    [{"seed": s, "kind": k, "start": a, "end": b, "instance": instance(k, text[a:b]), "patterns": contexts(text, a)} for s, k, a, b in both]
                )
            rows = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(spans, span_type), pa.array(mentions, mention_type)], ["row", "id", "spans", "mentions"])

    span = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
    span_type = pa.list_(pa.struct(span))
    mention_type = pa.list_(pa.struct([("seed", pa.bool_()), *span, ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"row long, id {kind}, spans array<struct<kind:int,start:bigint,end:bigint>>, "
        "mentions array<struct<seed:boolean,kind:int,start:bigint,end:bigint,instance:string,patterns:array<string>>>",
    )


def bit_of(pattern: str) -> int:
    """What ``_bit`` gives in Spark."""
    return xxhash.xxh64_intdigest(pattern.encode("utf-8", "replace"), 42) % FILTER_BITS


def _bit(pattern: str) -> F.Column:
    return F.xxhash64(pattern).bitwiseAND(F.lit(FILTER_BITS - 1))


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, total): how often each pattern's words occur in the corpus.

    Tasks get a bitmap of fixed size that says which patterns can matter and
    count those (one row per pattern and few texts); the join drops the few that
    only share a bit."""
    at = (_bit("pattern") + 1).alias("at")  # positions count from 1
    blocks = patterns.select(at).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in blocks.collect():  # FILTER_BITS / 8 bytes in all
        bitmap[(r.block - 1) * len(r.bits) :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)[: bitmap.size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bitmap, bitorder="little").astype(bool)
        for batch in batches:
            for low in range(0, batch.num_rows, 128):  # counters of few texts at a time
                single, double = Counter(), Counter()
                for text in batch.column(0).slice(low, 128).to_pylist():
                    words = [w.lower() for w in _CONTEXT_WORD.findall(text or "")]
                    single.update(words)
                    double.update(zip(words, words[1:]))
                counts = [(w, n) for w, n in single.items() if wanted[bit_of(w)]]
                counts += [(p, n) for w, n in double.items() if wanted[bit_of(p := " ".join(w))]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in counts], pa.string()), pa.array([n for _, n in counts], pa.int64())], ["pattern", "n"])

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "pattern string, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns.select("pattern").distinct(), "pattern", "left_semi")


def discovered(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, kind, start, end, score) of the identifiers that reliable patterns
    discover.  ``found`` is the stored result of ``scan``."""
    mentions = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = stored(mentions.select("seed", "kind", "instance", F.explode("patterns").alias("pattern")), "pii-edges")
    # what a pattern precedes: copies of a mention count once per instance in the support, each time in the confidence
    support = (
        edges.where("seed").select("kind", "pattern", "instance").distinct()
        .groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= MIN_SUPPORT)
    )
    useful = edges.where("NOT seed").select("kind", "pattern").distinct()  # others can discover nothing
    patterns = stored(support.join(useful, ["kind", "pattern"], "left_semi"), "pii-patterns")
    totals = stored(occurrences(docs, patterns, text_col), "pii-totals")
    graph = (
        edges.groupBy("seed", "kind", "pattern", "instance").agg(F.count(F.lit(1)).alias("n"))
        .join(patterns, ["kind", "pattern"]).join(totals, "pattern")
        .select("seed", "kind", "pattern", "instance", "n", F.greatest("total", "n").alias("total"))
    )
    graph = stored(graph, "pii-graph")
    scores = graph.where("NOT seed").select("kind", "instance").distinct().withColumn("score", F.lit(0.0))
    for _ in range(ROUNDS):
        known = graph.join(scores, ["kind", "instance"], "left").withColumn(
            "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        )
        confidence = known.groupBy("kind", "pattern").agg(
            F.least(F.sum(F.col("n") * F.col("score")) / F.max("total"), F.lit(1.0)).alias("confidence")
        )
        doubt = F.sum(F.col("n") * F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        scores = stored(
            graph.where("NOT seed").join(confidence, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("score")),
            "pii-scores",
        )
    accepted = scores.where(F.col("score") >= ACCEPT)
    # a span that could be two kinds is the likelier one
    spans = mentions.where("NOT seed").join(accepted, ["kind", "instance"]).groupBy("row", "start", "end").agg(
        F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best")
    )
    return spans.select("row", (-F.col("best.kind")).alias("kind"), "start", "end", F.col("best.score").alias("score"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base (array of kind, start, end) and spans
    (base and discovered ones), both by kind as in ``KINDS``, then start."""
    found = stored(scan(docs, id_col, text_col), "pii-scan")
    more = discovered(docs, found, text_col).select("row", F.struct("kind", "start", "end").alias("span")).distinct()
    more = more.groupBy("row").agg(F.collect_list("span").alias("more"))
    nothing = F.lit(None).cast("array<struct<kind:int,start:bigint,end:bigint>>")
    joined = found.join(more, "row", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("spans").alias("base"),
        F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", F.coalesce("more", nothing)))).alias("spans"),
    )


def spans_text(spans: str) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
