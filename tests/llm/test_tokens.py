import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tierline.llm import packing, tokens, wavelet

SCHEMA = "doc_id long, text string, id string, ids binary, task int, at long, start long"
ROWS = [(5, "Hello there,  world.\nNew line"), (3, None), (9, ""), (2, "long " * 30_000), (2, "long " * 30_000), (7, "<|endoftext|> é ́ x\n\n y"), (None, "null id")]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", b"1", 1, 2, 3) for i, t in rows], SCHEMA)


def library(name):
    t = Tokenizer.from_file(tokens.vocabulary(name))  # as the file has it
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return tokens.WordEncoder(tokens.vocabulary(request.param)), library(request.param)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAB éßİ'.,*1 \n\n\t|́一\x1c​ ", max_size=40))
def test_word_encoder_is_the_library(both, text):
    words, whole = both
    assert words.by_word
    assert words.encode([text, text + " x"]) == [struct.pack(f"<{len(i)}I", *i) for i in (whole(text), whole(text + " x"))]


@pytest.mark.parametrize("name", FILES)
def test_letters_that_normalise_to_marks_before_signs(name):
    plain = Tokenizer.from_file(tokens.vocabulary(name))  # as the file has it
    letters = "\u0130\u0131\u0149\u01c5\u0345\u0958\u09dc\u0a33\u0b5c\u0f43\u1e9e\u1fbc\u2126\ufb1d\ufb2a\U0001d400\U000323af\u4f60\uac00\u00e9"
    texts = [f"a b{x}{y} {x}{y} c{x}d{y} {x}{x}{y}{y} e" for x in letters for y in (",", "'", "...", "1", "(a", "!\u0130?", "")]
    texts.append("A\u0130, B\u0130.")
    words = tokens.WordEncoder(tokens.vocabulary(name))
    assert words.by_word
    want = [struct.pack(f"<{len(i)}I", *i) for i in (plain.encode(t, add_special_tokens=False).ids for t in texts)]
    assert words.encode(texts) == want


@pytest.mark.parametrize("name", FILES)
def test_strings_of_special_tokens_are_what_the_library_makes_of_them(name):
    whole, words = library(name), tokens.WordEncoder(tokens.vocabulary(name), kept_words=40)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y\n z ", "<|ENDOFTEXT|> a", "<|endoftext", "plain text", "", " lead", "two  spaces\nand lines"]
    for _ in range(3):  # the third time after forgetting
        assert words.encode(texts) == [struct.pack(f"<{len(i)}I", *i) for i in map(whole, texts)]
        words.encode([" ".join(f"w{i}" for i in range(50))])


@pytest.mark.parametrize("name", FILES)
def test_common_letters_are_not_normalised_word_by_word(name):
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.normalizer, self.calls = tokenizer, self if tokenizer.normalizer else None, 0

        def normalize_str(self, text):
            self.calls += 1
            return self.tokenizer.normalizer.normalize_str(text)

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

    whole, words = library(name), tokens.WordEncoder(tokens.vocabulary(name))
    words.tokenizer = counting = Counting(words.tokenizer)
    texts = ["a " + " ".join(f"{x}{y}q{x}n" for x in "abcdeéжA" for y in "fghiößЯ"), "b fjord Émile, (ağ) \u0110a\u030a 漢字 Ωm\u03c3\u03c2"]
    assert words.encode(texts) == [struct.pack(f"<{len(i)}I", *i) for i in map(whole, texts)]
    assert counting.calls <= 10  # of more than 60 words


@pytest.mark.parametrize("n", [0, 1, wavelet.PART_IDS, 3 * wavelet.PART_IDS + 17])
def test_wavelet_matrix_partitions_part_by_part(n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype("<u4")
    matrix = wavelet.WaveletMatrix.build(ids, 16)
    row = ids
    for plane, bit in zip(matrix.planes, reversed(range(16))):
        ones = row >> bit & 1 == 1
        assert np.array_equal(np.unpackbits(plane, count=n).view(bool), ones)
        row = np.concatenate([row[~ones], row[ones]])
    assert np.array_equal(matrix.decode(), ids)


@pytest.mark.parametrize("name", FILES)
def test_every_letter_in_words(name):
    whole, words = library(name), tokens.WordEncoder(tokens.vocabulary(name))
    letters = [chr(c) for c in (*range(0x600), *range(0x1100, 0x1180), *range(0x1E00, 0x2000), *range(0xAC00, 0xAC20)) if chr(c).isalpha()]
    texts = ["x " + " ".join([f"a{a}", f"{a}b", f"{a}{b}", f"{a}{b}{a}", f"{a}{b},"]) for a, b in zip(letters, letters[1:] + letters[:1])]
    assert words.mark is not None and words.by_word
    for got, text in zip(words.encode(texts), texts):
        ids = whole(text)
        assert got == struct.pack(f"<{len(ids)}I", *ids), text


@pytest.mark.parametrize("length", [1, 7, 2048])
def test_packing_round_trip(spark, length):
    rows = ROWS + [(100 + i, f"word{i} " * (i % 9)) for i in range(50)]
    got = packing.pieces(docs(spark, rows), sequence_tokens=length).collect() if length > 1 else []
    if length == 1:
        got = packing.pieces(docs(spark, rows[:2] + rows[5:]), sequence_tokens=1).collect()
        rows = rows[:2] + rows[5:]
    ids = library("word_bpe_49k.json")
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*ids(t), packing.END_ID])
    places = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length <= length
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, struct.unpack(f"<{r.length}I", r.ids), r.doc_tokens))
    for parts in places.values():  # gapless from 0
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    full = sorted(places)
    assert full == list(range(len(full)))
    assert all(sum(n for _, n in places[s]) == length for s in full[:-1])
    for i, docs_ids in want.items():
        total = sorted(sum((list(p) for _, p, _ in pieces[i]), []))
        assert total == sorted(sum(docs_ids, []))
        if len(docs_ids) == 1:
            assert sum((list(p) for _, p, _ in sorted(pieces[i])), []) == docs_ids[0]


def test_sequences_are_padded_but_for_powers_of_two(spark):
    packed = packing.pieces(docs(spark, [(i, "a b c d") for i in range(10)]), sequence_tokens=16)
    got = {r.sequence_id: (r.n_tokens, len(r.ids) // 4) for r in packing.sequences(packed, sequence_tokens=16).collect()}
    assert got == {0: (16, 16), 1: (16, 16), 2: (16, 16), 3: (2, 2)}
    assert [packing.padded_length(n) for n in (1, 3, 1024, 2048)] == [1, 2048, 1024, 2048]


def test_empty_tables(spark, tmp_path):
    assert packing.pieces(docs(spark, [])).count() == 0
    wavelet.write_shards(docs(spark, []), str(tmp_path / "w"))
    assert wavelet.read_documents(spark, str(tmp_path / "w")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=1200), st.integers(7, 17))
def test_wavelet_matrix(ids, bits):
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.array(ids, np.uint32), bits).to_bytes())
    assert m.decode().tolist() == ids
    for at in range(0, len(ids), 97):
        assert m.access(at) == ids[at]
        assert m.rank(ids[at], at) == ids[:at].count(ids[at])
    for token in set(ids[:5]) | {71}:
        places = [i for i, x in enumerate(ids) if x == token]
        assert m.count(token) == len(places)
        assert [m.select(token, k) for k in range(len(places))] == places
    with pytest.raises(IndexError):
        m.access(len(ids))


def test_shards_read_back(spark, tmp_path):
    rows = ROWS + [(100 + i, f"word{i} " * (i % 9)) for i in range(50)]
    path = str(tmp_path / "w")
    wavelet.write_shards(docs(spark, rows), path, segment_tokens=64)
    ids, at, want = library("byte_bpe_50k.json"), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        doc = [*ids(t), wavelet.END_ID]
        want.append((i, at, len(doc), zlib.crc32(struct.pack(f"<{len(doc)}I", *doc))))
        at += len(doc)
    got = wavelet.read_documents(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    found = wavelet.find_token(spark, path, wavelet.END_ID).collect()
    assert sum(r.n_found for r in found) >= len(rows)
    assert all(len(r.places) == r.n_found for r in found)
