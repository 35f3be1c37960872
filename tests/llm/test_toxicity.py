import random
import zlib

from tierline.llm import toxicity

SCHEMA = "doc_id long, text string, score string, id string, toxic string, at long"


def corpus(n, seed=0):
    rng = random.Random(seed)
    syllables = ["tion", "er", "the", "on", "and", "in", "at", "ou", "st", "re", "ing", "ly"]
    bad = ["slurword", "insultish", "grumblefool", "nastyname"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "s", "i", "x", 0) for i, t in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(1500)
    odd = [(9001, None), (9002, ""), (9003, "*** 123"), (9004, "then on and the " * 30_000), (None, "and on"), (9005, rows[0][1])]
    docs, truth = frames(spark, rows + odd + [rows[1]], labels + [(9002, None), (9003, 7)])
    model = toxicity.fit(docs, truth, toxicity.Bounds(toxic=200, ordinary=600))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) + 1
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    test = [(by_id[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in test) / len(test) >= 0.95
    assert all(by_id[i] < 0.5 for i in (9001, 9002, 9003, 9004, None))
    kept = toxicity.clean(docs, docs, truth)
    assert kept.columns == docs.columns
    assert 9004 in {r.doc_id for r in kept.collect()}


def test_labels_of_the_held_out_fold_are_never_learnt(spark):
    rows, labels = corpus(300)
    docs, truth = frames(spark, rows, labels)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.fit(docs, frames(spark, rows, lab)[1])).collect()) for lab in (labels, flipped)]
    assert scores[0] == scores[1]


def test_without_labels_or_rows(spark):
    docs, none = frames(spark, [(1, "a"), (2, None)], [])
    model = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.clean(docs, docs, none).count() == 2
    empty, _ = frames(spark, [], [])
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, frames(spark, [], [(1, 1), (2, 1)])[1]).constant == 1.0


def test_windows_cover_every_word():
    for n in range(0, 40):
        doc = [f"w{i}" for i in range(n)]
        seen = " ".join(w.decode() for w in toxicity.windows(doc, 6, 3)).split()
        assert set(seen) == set(doc)
