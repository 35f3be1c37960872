import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tierline.llm import simhash
from tierline.llm.components import components

SCHEMA = "doc_id long, text string, fp string, rep long, id long, row string, keep int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, 2, "r", 3) for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    low = min(root[i], root[j], key=lambda k: rows[k][0])
                    changed |= root[i] != low or root[j] != low
                    root[i] = root[j] = low
    return {rows[i][0]: (f"{fps[i]:016x}", rows[root[i]][0]) for i in range(len(rows))}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAéÉ \t\n\x0b\x1c b", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def some_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(30)]
    rows = [(1000 - i, t) for i, t in enumerate(base)]
    for k in range(60):  # near copies, copies of copies
        text = rng.choice(rows)[1].split()
        if text:
            text[rng.randrange(len(text))] = "CHANGED"
        rows.append((k, " ".join(text)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "one"), (2005, "x " * 70_000), (2006, base[0])]


def test_components_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 4)  # several tree levels
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)  # several blocks per shard
    rows = some_rows()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_trees_route_every_near_pair_to_a_common_home():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.zeros(a.size, np.uint64)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, a.size, dtype=np.uint64)
    b = a ^ flips
    for part in range(simhash.PARTS):
        va, vb = simhash.part_of(a, part), simhash.part_of(b, part)
        points, radii = simhash.build_tree(va[:500], 5)
        ra, la, ha = simhash.route(va, points, radii, 5, 1)
        rb, lb, hb = simhash.route(vb, points, radii, 5, 1)
        home = dict(zip(ra[ha].tolist(), la[ha].tolist()))
        visits = set(zip(rb.tolist(), lb.tolist()))
        near = np.flatnonzero(np.bitwise_count(va ^ vb) <= 1)
        assert near.size and all((i, home[i]) in visits for i in near.tolist())


def test_dense_shards_fold_their_links(monkeypatch):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 5, 400, dtype=np.uint64) | rng.integers(0, 4, 400, dtype=np.uint64) << np.uint64(40)
    ids, some, side = rng.permutation(400), rng.integers(0, 2, 400) == 1, (np.arange(400) % 2).astype(int)
    want = [simhash.shard_links(fps, ids, some, s, 1) for s in (side, np.zeros(400, int))]
    monkeypatch.setattr(simhash, "MOST_PAIRS", 10)
    monkeypatch.setattr(simhash, "max", lambda *x: 7 if x[0] == 1 and x[1] > 1000 else max(x), raising=False)  # few rows at a time
    for s, (a, b) in zip((side, np.zeros(400, int)), want):
        got = simhash.shard_links(fps, ids, some, s, 1)
        assert a.size > 100 and np.array_equal(got[0], a) and np.array_equal(got[1], b)


def test_survivors_keep_columns(spark):
    rows = some_rows()
    got = simhash.survivors(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c in brute(rows).values()})


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    got = simhash.simhash_components(docs(spark, [(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "q")]))
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == [(7, 7), (7, 7), (None, 7), (None, None)]


def one_bit_apart(monkeypatch):
    """Texts are their fingerprints in binary."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle_words: int(text or "0", 2))


def test_fingerprints_without_ids_link_and_survive(spark, monkeypatch):
    one_bit_apart(monkeypatch)
    rows = [(9, "0" * 10), (None, "0" * 7 + "111"), (4, "0" * 4 + "1" * 6), (None, "1" * 30), (None, "1" * 30 + "0" * 30)]
    got = {(r.fingerprint, r.doc_id, r.component_id) for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert {(i, c) for _, i, c in got} == {(9, 4), (None, 4), (4, 4), (None, None)}  # the one without id is a bridge
    assert len(got) == 5
    kept = [(r.doc_id, r.text) for r in simhash.survivors(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([rows[2], rows[3], rows[4]], key=str)


def test_survivors_are_one_row_of_each_component(spark, monkeypatch):
    one_bit_apart(monkeypatch)
    near, far = ["0" * 60 + "0001", "0" * 60 + "0011", "0" * 60 + "0111"], "1" * 40
    rows = [(5, near[0]), (5, near[1]), (5, near[1]), (8, near[2]), (5, far), (3, far), (None, far), (None, "1" * 20), (None, "1" * 20), (None, "1" * 19 + "0")]
    kept = [(r.doc_id, r.text) for r in simhash.survivors(docs(spark, rows)).collect()]
    assert len(kept) == 3 and set(kept) <= set(rows)
    assert sorted((i, len(t)) for i, t in kept if i) == [(3, 40), (5, 64)]
    assert [len(t) for i, t in kept if i is None] == [20]


@pytest.mark.parametrize("shape", ["path", "star", "cycle"])
def test_components(spark, shape):
    n = 40
    links = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "cycle": [(i, (i + 1) % n) for i in range(n)]}[shape]
    random.Random(1).shuffle(links)
    frame = spark.createDataFrame([(a, b) for a, b in links] + [(100, 101), (100, 100)], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {**{i: 0 for i in {x for link in links for x in link}}, 100: 100, 101: 100}


def test_survivors_keep_odd_columns(spark):
    table = spark.range(5).selectExpr("id AS doc_id", "concat('one two three four ', id % 2) AS text", "1 AS `a.b`", "map('k', id) AS m")
    got = simhash.survivors(table)
    assert got.columns == table.columns and 1 <= got.count() <= 2
