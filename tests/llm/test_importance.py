import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tierline.llm import importance
from tierline.llm.importance import Settings

SCHEMA = "doc_id long, text string, rank string, row string, weight string, `a.b` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", "x", "w", 1) for i, t in rows], SCHEMA)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, min_words=20, percent=5):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    s = Counter(bucket(f) for _, t in rows for f in features_of(t))
    t_ = Counter(bucket(f) for t in target for f in features_of(t))
    total, goal = sum(s.values()), sum(t_.values())
    out = []
    for i, text in rows:
        feats = features_of(text)
        weight = sum(math.floor(1000 * math.log((t_[b] + 1) * (total + 10000) / ((s[b] + 1) * (goal + 10000)))) for b in map(bucket, feats))
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(feats), weight, score, None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted(map(tuple, (r[:5] for r in out)), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["Straße", "the", "of", "İI", "x1", "été", "rain", "Ω", "b\x85c", "plain", "ABC", "你好"]
    return [(i, " ,\n".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_draw_as_brute_force(spark):
    rows = corpus(400) + [(1000, None), (1001, ""), (1002, "!? -"), (1003, "a " * 19), (1004, "a " * 20), (1005, "Rain\x00rain_RAIN " * 40_000)]
    target = ["rain of the plain", "x1 rain rain", None, ""]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs(spark, rows), goal)
    assert result(got) == brute(rows, target)


def test_null_and_repeated_ids_and_ties(spark):
    rows = corpus(60) + [(None, "rain " * 30), (None, "rain " * 30), (7, "rain " * 30), (7, "rain " * 30)]
    goal = spark.createDataFrame([(1, "rain rain rain")], "item_id long, text string")
    got = importance.resample(docs(spark, rows), goal, settings=Settings(percent=100))
    found = got.collect()
    able = [r for r in found if r.n_words >= 20]
    assert sorted(r["rank"] for r in able) == list(range(1, len(able) + 1))
    by_rank = sorted(able, key=lambda r: r["rank"])
    assert all(a.score >= b.score for a, b in zip(by_rank, by_rank[1:]))
    assert [r[:4] for r in result(got)] == [r[:4] for r in brute(rows, ["rain rain rain"], percent=100)]


def test_carried_columns_come_back_whole(spark):
    table = docs(spark, corpus(50))
    goal = spark.createDataFrame([], "item_id long, text string")
    got = importance.resample(table, goal, carry=table.columns)
    assert sorted(map(repr, got.select("row.*").collect())) == sorted(map(repr, table.collect()))


def test_empty_tables(spark):
    goal = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs(spark, []), goal).count() == 0
    rows = corpus(30)
    assert result(importance.resample(docs(spark, rows), goal)) == brute(rows, [])


@pytest.mark.parametrize("text", ["", "a", "é ß", "A\x7fb", "퟿", "x" * 100_000])
def test_features_of_a_text(text):
    n_words, found = importance.Features(Settings()).buckets(text)
    assert n_words == len(words_of(text))
    assert sorted(found.tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in features_of(text))
