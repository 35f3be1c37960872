import numpy as np
import pytest

from tierline.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, size long, id string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "i", "v") for i, v in rows], SCHEMA)


def brute(rows, length):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v is not None and len(v) == length and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    units = np.array([v / np.linalg.norm(v) for _, v in good])
    near = units @ units.T >= 0.9
    root = {i: i for i, _ in good}
    for _ in good:
        for a, (i, _) in enumerate(good):
            low = min(root[good[b][0]] for b in np.flatnonzero(near[a]))
            root[i] = min(root[i], low)
    out = {i: (0, i) for i, _ in rows}
    out.update({i: (int(near[a].sum()) - 1, root[i]) for a, (i, _) in enumerate(good)})
    return out


def test_links_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)  # several blocks per list
    monkeypatch.setattr(embeddings, "VECTORS_PER_PIVOT", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    for k in range(150):  # near copies and copies
        v = np.array(rows[int(rng.integers(0, len(rows)))][1])
        rows.append((1000 - k, (v + rng.normal(size=16) * (0.25 if k % 3 else 0)).tolist()))
    one = rng.normal(size=16)
    rows += [(2000 + k, (one + rng.normal(size=16) * 0.1).tolist()) for k in range(60)]  # a large group
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, [1.0] * 15), (3005, [float("inf")] + [0.0] * 15), (3006, [])]
    rows += [(3007, [1e30] * 16), (3008, [1e-30] * 16), (3009, [1.0] * 16)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(frame(spark, rows)).collect()}
    want = brute(rows, 16)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the bound
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.9 * there
    assert got[3007] == (2, 3007) and got[3009] == (2, 3007)
    assert [got[i] for i in range(3000, 3007)] == [(0, i) for i in range(3000, 3007)]


def test_recall_on_the_given_vectors_scale():
    """Pairs at the bound itself, the hardest ones."""
    rng = np.random.default_rng(0)
    x = embeddings.unit(rng.normal(size=(2000, 64)))
    z = rng.normal(size=(2000, 64))
    z = embeddings.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    pivots = embeddings.unit(rng.normal(size=(1024, 64)))
    a, b = (embeddings.permutation(v, pivots, embeddings.NEAREST) for v in (x, y))
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
    assert (shared >= embeddings.MIN_SHARED).mean() >= 0.95


def with_dense_group(n, cosine, seed=0, length=64):
    """Unit vectors, the first third of them a group with about that cosine between its members."""
    rng = np.random.default_rng(seed)
    rows = embeddings.unit(rng.normal(size=(n, length)))
    rows[: n // 3] = embeddings.unit(np.sqrt(cosine) * embeddings.unit(rng.normal(size=(1, length))) + np.sqrt(1 - cosine) * rows[: n // 3])
    return rows


@pytest.mark.parametrize("cosine", [0.86, 0.92, 0.9996])
def test_dense_group_keeps_its_links(spark, monkeypatch, cosine):
    monkeypatch.setattr(embeddings, "VECTORS_PER_PIVOT", 3)  # as many pivots in the group as in a far larger table
    rows = with_dense_group(1500, cosine).astype(np.float32).astype(np.float64)
    got = embeddings.embedding_links(frame(spark, list(enumerate(rows.tolist())))).collect()
    units = embeddings.unit(rows)
    want = (units @ units.T >= embeddings.MIN_COSINE).sum() - len(rows)
    assert want > 1000
    assert 0.99 * want <= sum(r.n_links for r in got) <= want


def test_thinned_pivots_lie_apart():
    pivots = with_dense_group(900, 0.92)
    kept = embeddings.thinned(pivots, 0.9)
    near = kept @ kept.T - np.eye(len(kept))
    assert near.max() < 0.62 and len(kept) >= 500  # the group shrinks, the others stay
    assert len(embeddings.thinned(pivots[:1].repeat(5, axis=0), 0.9)) == 1


def test_one_pivot_for_all(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(5)]
    got = embeddings.embedding_links(frame(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(4, 0)}


def test_copies_repeated_ids_and_empty(spark):
    rows = [(5, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (9, [-1.0, 0.5])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.embedding_links(frame(spark, rows)).collect())
    assert got == [(4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (9, 0, 9, True)]
    assert embeddings.embedding_links(frame(spark, [])).count() == 0
