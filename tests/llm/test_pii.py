import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tierline.llm import pii

SCHEMA = "doc_id long, text string, id string, spans string, pattern string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "i", "s", "p") for i, t in rows], SCHEMA)


def plain(text):
    """The four base patterns as they are written in the contract."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "@x.y", "%d", "1", "255", "256", "0", ".", "-", " ", "+", "(", ")", "4111111111111111", "１", "é", "+1 (456) 555-2186"]), max_size=16).map("".join))
def test_base_entities(text):
    assert pii.base_entities(text) == plain(text)


def rows():
    out = [(i, f"text here call me at +1 (4{i:02d}) 555-21{i:02d} and mail to bob{i}@x{i}.com, then the end {i}.") for i in range(40)]
    out += [(100, "please call me at 555-0199123 soon, mail to bob(at)example(dot)org now")]
    out += [(101, None), (102, ""), (103, "the 12345678 and 99999999 at the end"), (104, "mail to joe@localhost thanks"), (105, "the " * 50_000 + "+1 (456) 555-2186")]
    return out + [(0, out[0][1])]


def test_patterns_discover_what_base_patterns_miss(spark):
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows())).select("doc_id", "base", "spans", pii.spans_text("spans").alias("said")).collect()}
    assert got[100].base == [] and got[100].said == "email:44:66,phone:18:29"
    assert got[104].said == "email:8:21"
    assert got[103].said == got[101].said == got[102].said == ""
    assert got[105].said == "phone:200000:200017"
    for i in range(40):
        assert got[i].base == got[i].spans and [tuple(s) for s in got[i].base] == plain(dict(rows())[i])


def test_copies_of_one_seed_prove_nothing(spark):
    copies = [(i, "my number is +1 (456) 555-2186 ok") for i in range(50)] + [(99, "my number is 555-0199123 ok")]
    got = {r.doc_id: r.said for r in pii.personal_data(frame(spark, copies)).select("doc_id", pii.spans_text("spans").alias("said")).collect()}
    assert got[99] == "" and got[0] == "phone:13:30"


def test_empty_table_and_null_ids(spark):
    assert pii.personal_data(frame(spark, [])).count() == 0
    got = pii.personal_data(frame(spark, [(None, "x a@b.c"), (None, "y")])).collect()
    assert sorted(len(r.spans) for r in got) == [0, 1]


def test_rows_of_one_id_keep_their_own_spans(spark):
    call = "please call me at 555-0199123 soon"
    seeds = [(i, f"call me at +1 (4{i:02d}) 555-21{i:02d} and so on") for i in range(40)]
    for i in (None, 777):
        got = pii.personal_data(frame(spark, seeds + [(i, call), (i, "nothing"), (i, call + " or later"), (i, None)]))
        said = sorted(r.said for r in got.where("doc_id IS NULL" if i is None else f"doc_id = {i}").select(pii.spans_text("spans").alias("said")).collect())
        assert said == ["", "", "phone:18:29", "phone:18:29"]


def test_filter_bits_are_the_same_in_spark(spark):
    words = ["at", "call me", "é :", "你好", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "pattern string").select(pii._bit("pattern").alias("b")).collect()
    assert [r.b for r in got] == [pii.bit_of(w) for w in words]
