import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tierline.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, id string, formatted string, roles string"
PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]", "\\", "[", "<", "a", " ", "\n", "é"])
TEXT = st.lists(PIECES, max_size=8).map("".join)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "f", "r") for r in rows], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=5))
def test_read_back_any_turns(turns):
    f = chat.Formatter()
    parts = f.segments(turns)
    assert f.read("".join(t for t, _ in parts)) == turns
    assert [f.unquote(t) for t, loss in parts if loss] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_no_control_string_is_left_in_a_text(text):
    f = chat.Formatter()
    assert not f.marks.search(f.quote(text))
    assert f.unquote(f.quote(text)) == text


def test_state_machine():
    check = chat.Formatter().check
    assert check(["system", "user", "assistant"]) == (None, True)
    assert check(["user", "assistant", "user"]) == (None, False)
    assert check(["user", "user"]) == (1, False)
    assert check(["assistant"]) == (0, False)
    assert check(["user", "system"]) == (1, False)
    assert check([]) == (None, False)


ROWS = [
    (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 1, "assistant", "x" * 100_000),
    (3, 0, None, "no role"), (3, 0, "tool", "</s>"), (4, 0, "assistant", "first"), (4, 0, "assistant", "first"),
    (None, None, "user", "null id"), (5, 1, "user", ""), (5, None, "system", "null turn"),
]


def test_query_shape_on_odd_rows(spark):
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame(spark, ROWS))).collect()}
    want = {}
    for conv, turn, role, text in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(back) == set(want)
    for conv, turns in want.items():
        r = back[conv]
        assert r.n_turns == len(turns)
        assert r.turns_text == "".join(f"{a}\n{b}\n" for a, b in turns)
        assert r.loss_text == "".join(b for a, b in turns if a == "assistant")
    assert back[4].bad_turn == 0 and back[1].bad_turn is None


def test_registered_query(spark, tmp_path):
    frame(spark, ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op2_chat_formatting(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(said)
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(frame(spark, []))).count() == 0
