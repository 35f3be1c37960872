import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tierline.llm import quality

SCHEMA = "doc_id long, text string, score string, id string, quality string, at long, `a.b` int"


def corpus(n, seed=0):
    """Prose of random words; bad documents are tables, shouting, signs or one word over and over."""
    rng = random.Random(seed)
    syllables = ["tion", "er", "the", "on", "ünd", "in", "ét", "ou", "st", "re", "ing", "ly"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(15, 150))]
        good = i % 6 != 0
        if good:
            text = " ".join(w.capitalize() if j % 9 == 0 else w + "," * (j % 5 == 0) for j, w in enumerate(words))
        else:
            one = word()
            kind = rng.randrange(4)
            text = [" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + "%%%" for w in words), " ".join([one] * len(words))][kind]
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "s", "i", "q", 0, 1) for i, t in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(1200)
    odd = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "Then on and the, " * 40_000), (None, "and on"), (9005, rows[0][1])]
    docs, truth = frames(spark, rows + odd + [rows[1]], labels + [(9002, None), (9003, 7)])
    model = quality.fit(docs, truth)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) + 1
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    test = [(by_id[i] >= 0.7, bool(y)) for i, y in labels if held(i)]
    assert sum(p == y for p, y in test) / len(test) >= 0.97
    assert by_id[9005] == by_id[0] and by_id[9001] == by_id[9002] == by_id[9003]


def test_labels_of_the_held_out_fold_are_never_learnt(spark):
    rows, labels = corpus(400)
    docs, truth = frames(spark, rows, labels)
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    scores = [sorted((r.doc_id, r.score) for r in quality.score(docs, quality.fit(docs, frames(spark, rows, lab)[1])).collect()) for lab in (labels, flipped)]
    assert scores[0] == scores[1]


def test_bounds_hold_for_repeated_ids(spark):
    rows, labels = corpus(200)
    docs, truth = frames(spark, [(i % 10, t) for i, t in rows] * 3, labels[:10])
    few = quality.Bounds(bad=20, good=30, indicators=5000)
    assert quality.fit(docs, truth, few).constant is None or quality.fit(docs, truth, few).constant <= 1


def test_without_labels_or_rows(spark):
    docs, none = frames(spark, [(1, "a"), (2, None)], [])
    assert [r.score for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.0, 0.0]
    ones = frames(spark, [], [(i, 1) for i in range(20)])[1]
    assert quality.fit(docs, ones).constant == 1.0
    empty, _ = frames(spark, [], [])
    assert quality.score(empty, quality.fit(docs, ones)).count() == 0
    rows, labels = corpus(300)
    full, truth = frames(spark, rows, labels)
    assert quality.score(empty, quality.fit(full, truth)).count() == 0
    assert quality.fit(empty, truth).constant is not None


def slow_indicators(text):
    """The indicators one by one, with the same hash."""
    words = [w for w in text.split() if w]
    core = [zlib.crc32(w.strip(quality._SIGNS).lower().encode()) for w in words]

    def mix(a, b):
        c = (a * 0x9E3779B97F4A7C15 + b) % 2**64
        c ^= c >> 29
        c = c * 0xBF58476D1CE4E5B9 % 2**64
        return c ^ (c >> 32)

    def run(codes, i, n):
        c = mix(codes[i], 1)
        for j in range(1, n):
            c = mix(c, codes[i + j])
        return c

    repeat = [1 if i >= 1 and core[i] == core[i - 1] else 2 if i >= 2 and core[i] == core[i - 2] else 0 for i in range(len(words))]
    kind = [mix(zlib.crc32(quality.shape(w).encode()), r) for w, r in zip(words, repeat)]
    out = {mix(int(np.log2(len(words) + 1)), 7) % quality.CLASS_DIMS + quality.WORD_DIMS}
    out |= {run(core, i, n) % quality.WORD_DIMS for n in (1, 2) for i in range(len(words) - n + 1)}
    for n in (1, 2, 3):
        total = len(words) - n + 1
        for code, count in Counter(run(kind, i, n) for i in range(total)).items():
            level = int(np.floor(np.log2(total / count)))
            for k in range(quality.LEVELS + 2):
                if level <= k or k > quality.LEVELS:
                    out.add(mix(code, k + 16) % quality.CLASS_DIMS + quality.WORD_DIMS)
    return sorted(out)


def test_indicators_as_one_by_one():
    texts = ["", "one", "The the THE the, a b a b", "x1 | 2,5 | Straße İI 你好!! Ǆx", "  lead and trail  ", *(t for _, t in corpus(30, 5)[0])]
    for chars in (1, 100, 1 << 21):
        got, low = [], 0
        for part in quality.slices(pa.array(texts, pa.large_string()), chars):
            doc, column = quality.indicators(part)
            got += [column[doc == i].tolist() for i in range(len(part))]
        assert got == [slow_indicators(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_descent_reaches_the_optimum(seed):
    """Hinge loss and dual value meet at the optimum only."""
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(12, 5, replace=False)) for _ in range(80)]
    values = [rng.normal(size=5) for _ in rows]
    labels = (rng.random(80) < 0.4).astype(int)
    cost = np.where(labels == 1, 0.7, 1.3)
    weights = quality.dual_coordinate_descent(rows, values, labels, cost, 12, rounds=3000, close=1e-9)
    dense = np.zeros((80, 13))
    for i, (r, v) in enumerate(zip(rows, values)):
        dense[i, r] = v
    dense[:, -1] = 1
    sign = np.where(labels == 1, 1, -1)

    def primal(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - sign * (dense @ w))).sum()

    best = primal(weights)
    for _ in range(300):
        assert primal(weights + rng.normal(size=13) * 10 ** rng.uniform(-4, 0)) >= best - 1e-9
