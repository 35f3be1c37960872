import hashlib
import random
import zlib

from tierline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, `a.b` int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def own_turns(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}


def rebuilt(rows):
    own = own_turns(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        leaves = sum(not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below) for n in below)
        ends = sorted(c for c in members if len(convs[c]) == len(node))
        rows.append(
            (
                min(members),
                len(node),
                min(nodes[node[:-1]]) if node else None,
                len(members),
                sum(len(m) == len(node) + 1 for m in below),
                leaves,
                sum((len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(rows, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def some(n, seed=1, most=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = rng.randrange(3 * n)
        for t in range(rng.randint(0, most)):
            rows.append((conv * 1000 + t, t, conv))
    return [(k // 1000, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "\U0001f600x"])) for k, t, _ in rows]


def unique_turns(rows):
    """Turns of a conversation that do not tie, so that their order is defined."""
    return list({(r[0], r[1]): r for r in rows}.values())


def test_rebuilt_trie_as_brute_force(spark):
    rows = unique_turns(some(150)) + [(None, 0, "user", "x"), (100, None, "user", "first"), (12345, None, None, None)]
    rows += [(i, 0, "system", "same") for i in range(20_000, 20_040)]
    got = trie.prefix_trie(trie.share_heads(trie.ordered(conversations(spark, rows))))
    assert result(got) == brute(rebuilt(rows))


def test_ends_and_turnless_conversations(spark):
    # ids whose CRC takes away every own turn of a conversation without an opener
    bare = next(c for c in range(70_001, 70_099) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(bare, 0, "user", "a"), (bare, 1, "assistant", "b")]
    got = trie.prefix_trie(trie.share_heads(trie.ordered(conversations(spark, rows))))
    assert result(got) == brute(rebuilt(rows)) == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]


def test_many_ids_end_at_one_node(spark):
    """More ids than a piece holds, negative ones too, in several partitions."""
    ids = list(range(-700, 2500, 2))
    rows = [(c, t, "user", f"turn {t}") for c in ids for t in range(2)] + [(9999, 0, "user", "turn 0")]
    got = trie.prefix_trie(trie.ordered(conversations(spark, rows).repartition(7)))
    want = brute({c: [("user", "turn 0"), ("user", "turn 1")] for c in ids} | {9999: [("user", "turn 0")]})
    assert result(got) == want


def test_long_shared_and_private_turns(spark):
    """A trunk of 25 shared turns, a conversation that ends on it, private tails of 60."""
    rows = [(c, t, "user", f"t{t}" * (t % 4) if t < 25 else f"{c}-{t}") for c in (1, 2, 3) for t in range(60)]
    rows += [(4, t, "user", f"t{t}" * (t % 4)) for t in range(10)] + [(5, 0, "user", "other"), (6, 0, "user", "x" * 200_000)]
    own = own_turns(rows)
    got = trie.prefix_trie(trie.ordered(conversations(spark, rows)))
    assert result(got) == brute(own)


def test_parents_with_many_children_are_joined_either_way(spark, monkeypatch):
    rows = unique_turns(some(80, seed=4))
    want = brute(own_turns(rows))
    for hot in (0, 1, 10**9):
        monkeypatch.setattr(trie, "HOT", hot)
        assert result(trie.prefix_trie(trie.ordered(conversations(spark, rows)))) == want


def test_repeated_rows_and_ties_are_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "a")]
    turns = trie.ordered(conversations(spark, rows))
    got = trie.prefix_trie(turns)
    assert got.where("conv_id = 1").agg({"depth": "max"}).first()[0] == 3
    again = trie.prefix_trie(trie.ordered(conversations(spark, rows[::-1]).repartition(3)))
    assert result(got) == result(again)


def test_no_conversations(spark):
    got = trie.prefix_trie(trie.share_heads(trie.ordered(conversations(spark, []))))
    assert got.count() == 0
    assert [c for c in got.columns if c != "key"] == COLUMNS
