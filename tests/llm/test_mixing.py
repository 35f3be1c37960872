import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tierline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string, turn int, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 3, "t", 1, "r") for i, t, s in rows], SCHEMA)


def brute(rows, weights=(1, 2, 3), epochs=3):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, q, n in sized if q == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, open_, target = sum(total.values()), set(names), {}
    left = float(budget)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share >= epochs * total[s]]
        if not full:
            target.update({s: weight[s] * share for s in open_})
            break
        for s in full:
            target[s] = float(epochs * total[s])
            left -= target[s]
            open_.discard(s)
    items = []
    for s in names:
        queue = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, n) for i, q, n in sized if q == s)
        for e in range(epochs):
            at = e * total[s]
            for pos, i, n in queue:
                at += n
                if n:
                    items.append((at / target[s], names.index(s), e, pos, i, n))
    taken, run = {}, 0
    for time, _, _, _, i, n in sorted(items):
        run += n
        if run > budget:
            break
        taken[i] = taken.get(i, 0) + n
    return {i: (n, total[s], pytest.approx(target[s]), taken.get(i, 0)) for i, s, n in sized}


def test_against_brute_force(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 4}" if i % 3 else "hot") for i in range(400)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "one", None), (1003, " \t", "blank"), (1004, "z " * 5000, "s2")]
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_targets_are_met_and_capped(spark):
    rows = [(i, "w " * 20, "big" if i % 10 else "small") for i in range(1000)]
    out = mixing.mix(docs(spark, rows), weights=(1, 9))
    by = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("s"), F.max(F.col("taken") / F.col("size")).alias("m")).collect()}
    assert by["small"].target == 3 * by["small"].s and by["small"].m == 3
    for r in by.values():
        assert abs(r.taken - r.target) <= 0.02 * r.target


def test_mixed_rows_repeat_what_is_taken(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i % 7 else "b") for i in range(100)]
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs(spark, rows)).collect()}
    got = mixing.mixed(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    seen = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert seen == {i: n for i, n in taken.items() if n}


def test_repeated_rows_and_reruns(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, "c", None), (2, "c", None)]
    runs = [sorted(tuple(r) for r in mixing.mix(docs(spark, rows)).drop("source").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 4
    assert mixing.mixed(docs(spark, rows)).count() >= 3


@pytest.mark.parametrize(
    "rows",
    [
        [(None, "a b c d e", "s")] * 100 + [(i, "w " * 7, "t") for i in range(40)],
        [(1, "w " * 9, "big")] * 7 + [(i, "w " * 20, "huge") for i in range(2, 90)],
        [(5, f"w{i} v", "a") for i in range(30)] + [(5, "one two three", "b")] * 4,
    ],
)
def test_mixed_words_add_up_to_what_is_taken(spark, rows):
    table = docs(spark, rows)
    taken = mixing.mix(table).agg(F.sum("taken")).first()[0]
    words = sum(len(r.text.split()) for r in mixing.mixed(table).select("text").collect())
    assert words == taken


def test_mixed_keeps_odd_columns(spark):
    table = docs(spark, [(1, "a b", "s"), (2, "c", "t")]).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = mixing.mixed(table)
    assert got.columns == table.columns
    assert got.select("`a.b`", "m").collect()


def test_empty_table_and_no_words(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, "", "s"), (2, None, None)])).collect()] == [0, 0]
    assert mixing.mixed(docs(spark, [(1, "", "s")])).count() == 0
