"""Token ids of texts with the ``tokenizers`` library, inside tasks.

The two BPE vocabularies used here cut a text at every single space or line break
between two other characters before they look anything up, so the ids of a text are the ids
of its words one after the other.  A worker therefore keeps the ids of words it
has met (bounded) and asks the library only for new ones.  Texts are cut and their words
numbered a batch at a time in Arrow, so Python looks at each different word of a batch
once, and the ids are put together by one gather.  Texts that need more care (double
white space, a space at either end) are cut one by one.  Each loaded file is
probed: where word by word and whole text differ, whole texts are encoded; so are texts
that hold the string of a special token, which the library turns into that token.
"""

from __future__ import annotations

import os
import re
import string
import sys
import types
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

#: Words whose ids a worker keeps unless told otherwise; beyond that it starts afresh.
KEPT_WORDS = 800_000
#: A cut is safe before a single space that has other characters on both sides.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE_SPACE = re.compile(r"\s\s")
#: Ends of a word that are pieces of their own.
_SIGNS = string.punctuation + string.digits
#: The sign that byte-level vocabularies write for each byte: itself where it is visible, else the next from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_LETTER_PROBE = "The ABC McD Straße été ÉTÉ İI ı 你好 ΑΣ ΣΑΣ ﬁn ǆ Å가 कख़ ﬞבּ ŉa ẞ Ω 𝐀b"
_PROBE = (
    "It's we'll  two\n\nlines \n x\ty 12,345 éa ́b Straße İI 你好, (a) b!\n c  "
    "<|end|> x y  z d'accord...\r\n end"
)


def _strings(words: pa.Array) -> list[str]:
    """``to_pylist`` of strings without nulls, by way of numpy, which is faster."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words one after the other, and how many each has."""
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _byte_signs(text: str) -> str:
    """A text as byte-level vocabularies write it."""
    return text.encode().decode("latin-1").translate(_BYTE_SIGNS)


class WordEncoder:
    """``encode(texts)`` gives the little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        self.kept_words = kept_words
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # normalised ones are found in the normalised text, so in whatever case they stand
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        # what all of them start with, as far as it has one case: a text without it holds none
        self.special_start = re.match("[\\x00-@\\[-`{-\\x7f]*", os.path.commonprefix(special)).group()
        self._forget()
        self.model = self.tokenizer.model  # alone, for words that are normalised and cut already
        self._find_letters()
        self.cuts: dict[str, bool] = {}  # last letters: whether signs after them are pieces of their own
        self.mark = self._find_mark()
        whole = self._encode([_PROBE])[0]
        self.by_word = True
        self.by_word = self.encode([_PROBE])[0] == whole
        self._forget()

    def _forget(self) -> None:
        self.heads: dict[str, int] = {"": 0}  # numbers of first words and ends of words, as they stand
        self.words: dict[str, int] = {}  # numbers of words after a space, cut from their signs
        # the ids by number: all in one array, where each starts and its length
        self.pool, self.first, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _keep(self, ids: np.ndarray, size: np.ndarray) -> range:
        """Numbers for new words: their ids, one after the other, and how many each has."""
        numbers = range(self.size.size, self.size.size + size.size)
        self.first = np.concatenate([self.first, self.pool.size + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])
        return numbers

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find_letters(self) -> None:
        """Learn how the vocabulary writes each letter below U+0500, none of
        which melts with the next: normalised, in byte signs.  Letters that
        become more than letters are left out."""
        normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer is not None else str
        letters = [chr(c) for c in range(0x500) if chr(c).isalpha()]
        written = {c: normalize(c) for c in letters}
        self.letters = str.maketrans({c: _byte_signs(n) for c, n in written.items() if n.isalpha()})
        self.of_letters = re.compile(f"[{''.join(map(chr, self.letters))}]+").fullmatch

    def _written(self, words: list[str]) -> tuple[list[str], list[str], list[str]]:
        """Words of letters in another order, how the vocabulary writes them
        (without its mark), and words whose normal form has other signs."""
        plain, others, far, out, rest = [], [], [], [], []
        for word in words:
            (plain if word.isascii() else others if self.of_letters(word) else far).append(word)
        for some in (plain, others):  # many at a time
            if some:
                out += "\n".join(some).translate(self.letters).split("\n")
        normalizer, done = self.tokenizer.normalizer, plain + others
        for word in far:
            normal = normalizer.normalize_str(word) if normalizer is not None else word
            if normal.isalpha():
                done.append(word)
                out.append(_byte_signs(normal))
            else:
                rest.append(word)
        return done, out, rest

    def _encode_written(self, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of written words by the model alone, one after the other, and
        how many each has."""
        tokenize = self.model.tokenize
        ids = [[t.id for t in tokenize(mark + word)] for word in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum())), size

    def _learn_letters(self, words: list[str]) -> None:
        """Keep words of letters after a space, by the model alone where that
        is the same.  Words whose normal form has other signs go through the
        library."""
        if self.mark is not None:
            done, written, words = self._written(words)
            self.words.update(zip(done, self._keep(*self._encode_written(written, self.mark))))
        self.words.update(zip(words, self._keep(*_flat(self._encode([" " + w for w in words])))))

    def _find_mark(self) -> str | None:
        """How the vocabulary writes a word after a space: behind this mark.
        None where the model alone does not give the library's ids."""
        done, written, _ = self._written(["the", "thonti", "onwhed", "zebra", "q", "internationalisation", *_LETTER_PROBE.split()])
        ids, size = _flat(self._encode([" " + w for w in done]))
        for mark in ("\u0120", "", "\u2581"):
            got, sizes = self._encode_written(written, mark)
            if np.array_equal(got, ids) and np.array_equal(sizes, size):
                return mark
        return None

    def _cuts_after(self, letter: str) -> bool:
        """Whether the library cuts between this letter and a sign: not where
        it normalises the letter to one with a mark behind, and the mark and
        the sign become one piece."""
        if letter not in self.cuts:
            known, normalizer, cutter = letter.isascii(), self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            if not known and cutter is not None:
                text = f" a{letter},"
                pieces = cutter.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text)
                known = len(pieces) > 1 and pieces[-1][0] == ","
            self.cuts[letter] = known
        return self.cuts[letter]

    def _heads(self, words: pa.Array) -> np.ndarray:
        """Numbers of different first words or ends of words."""
        names = _strings(words)
        new = [w for w in names if w not in self.heads]
        self.heads.update(zip(new, self._keep(*_flat(self._encode(new)))))
        return np.fromiter(map(self.heads.__getitem__, names), np.int64, len(names))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each of different words after a space.  Letters and
        the ASCII signs and digits after them are cut apart by both vocabularies,
        unless the last letter is normalised to more than a letter, so such a
        word is the ids of the two; any other is one piece."""
        core = pc.utf8_rtrim(words, characters=_SIGNS)
        last = pc.utf8_slice_codeunits(core, -1).dictionary_encode()
        cuts = np.array([self._cuts_after(c) if c else False for c in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        whole = pc.equal(core, words).to_numpy(zero_copy_only=False)
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & (cuts | whole)
        key = pc.if_else(pa.array(plain), core, words).dictionary_encode()
        names = _strings(key.dictionary)
        numbers = np.array(list(map(self.words.get, names, repeat(0))), np.int64)
        missing = np.flatnonzero(numbers == 0)
        if missing.size:
            new = [names[i] for i in missing.tolist()]
            other = [" " + w for w in new if not w.isalpha()]
            self._learn_letters([w for w in new if w.isalpha()] if other else new)
            self.words.update(zip((w[1:] for w in other), self._keep(*_flat(self._encode(other)))))
            numbers[missing] = list(map(self.words.__getitem__, new))
        ends = np.zeros(len(words), np.int64)
        signed = np.flatnonzero(plain & ~whole)
        if signed.size:
            at = pa.array(signed)
            tails = pa.array([w[n:] for w, n in zip(_strings(words.take(at)), pc.utf8_length(core.take(at)).to_numpy().tolist())], pa.large_string())
            tails = tails.dictionary_encode()
            ends[signed] = self._heads(tails.dictionary)[tails.indices.to_numpy()]
        return numbers[key.indices.to_numpy()], ends

    def _join(self, pieces: pa.Array, head: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The ids of texts from their pieces, the first words marked."""
        encoded = pieces.dictionary_encode()
        vocabulary, at = encoded.dictionary, encoded.indices.to_numpy()
        number = np.zeros((at.size, 2), np.int64)  # of a word and of its end; 0 for none
        for where, learn in ((head, lambda words: (self._heads(words), 0)), (~head, self._words)):
            own = at[where]
            if own.size:
                present = np.flatnonzero(np.bincount(own))
                numbers = np.zeros((len(vocabulary), 2), np.int64)
                numbers[present, 0], numbers[present, 1] = learn(vocabulary.take(pa.array(present)))
                number[where] = numbers[own]
        number = number.ravel()
        sizes = self.size[number]
        ends = np.append(0, np.cumsum(sizes))
        data = self.pool[np.repeat(self.first[number] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        edges = (4 * ends[2 * starts]).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encode(texts)
        if self.size.size > self.kept_words:
            self._forget()
        whole, plain, careful = [], [], []
        for i, text in enumerate(texts):
            if self.special is not None and self.special_start in text and self.special.search(text):
                whole.append(i)
            elif text[:1] == " " or text[-1:] == " " or _DOUBLE_SPACE.search(text):
                careful.append(i)
            else:
                plain.append(i)
        out: list[bytes] = [b""] * len(texts)
        for places, way in ((whole, self._encode), (plain, self._encode_batch), (careful, self._encode_each)):
            for i, ids in zip(places, way([texts[i] for i in places]) if places else []):
                out[i] = ids
        return out

    def _encode_batch(self, texts: list[str]) -> list[bytes]:
        """Texts whose spaces and line breaks all stand alone: a line break is
        a piece of its own, and the word after it a first word."""
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n ") for t in texts], pa.large_string()), " ")
        pieces, starts = cut.values, cut.offsets.to_numpy()
        head = np.zeros(len(pieces), bool)
        head[starts[:-1]] = True
        breaks = np.flatnonzero(pc.equal(pieces, "\n").to_numpy(zero_copy_only=False))
        head[breaks] = True
        head[breaks + 1] = True
        return self._join(pieces, head, starts)

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        pieces, head, starts = [], [], [0]
        for text in texts:
            # a line break between other characters is a piece of its own, so lines are encoded one by one
            lines = [_SAFE_CUT.split(text)] if _DOUBLE_SPACE.search(text) else [x.split(" ") for x in text.split("\n")]
            for number, words in enumerate(lines):
                if not words[-1] and len(words) > 1:  # a last space has no word after it
                    words[-2:] = [words[-2] + " "]
                if not words[0] and len(words) > 1:
                    words[:2] = [" " + words[1]]
                if number:
                    pieces.append("\n")
                    head.append(True)
                pieces += words
                head += [True] + [False] * (len(words) - 1)
            starts.append(len(pieces))
        return self._join(pa.array(pieces, pa.large_string()), np.array(head, bool), np.array(starts))


def encoder(path: str, kept_words: int = KEPT_WORDS) -> WordEncoder:
    """This worker's encoder of a vocabulary file, kept from task to task."""
    kept = sys.modules.setdefault("_tierline_encoders", types.ModuleType("_tierline_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordEncoder(path, kept_words)
    return kept.__dict__[path]


def vocabulary(name: str) -> str:
    """Path of one of the public vocabulary files installed on every node."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
