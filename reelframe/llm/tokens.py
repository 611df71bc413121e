"""Token ids of whole texts from the ``tokenizers`` library, with the ids of seen words kept per worker.

The two public vocabularies used here split a text at white space before any merge, so the ids of a text are
the ids of its words in order. Arrow splits a block of texts into words and gathers the different ones; each
worker keeps the ids that the library gave for a word, so a block costs one lookup a different word. Only
boundaries that no rule of the vocabulary reaches across are used: every run of ASCII white space where white
space is dropped, else a single space or newline between two other characters. Texts that hold the string of a
special token go to the library whole.
"""

from __future__ import annotations

import json
import re
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker; when reached, the table starts anew. Bounds memory only, never the result.
MAX_WORDS = 1_000_000
#: Bytes of texts that are taken apart at once; bounds the words in memory.
BYTES_AT_ONCE = 4_000_000
#: Unseen words given to the library in one call.
WORDS_PER_CALL = 4_000

#: Marks that close a word, and letters beyond ASCII: a word of letters with closing marks is known to be a piece
#: of letters and a piece of marks in both vocabularies. The apostrophe isn't among them (it opens endings).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+\\z"
#: What any of the engines involved may take for white space, but space and newline.
_OTHER_SPACE = "\t\x0b-\r\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text of which some white space isn't a single space or newline between two other characters.
_UNEVEN = f"[{_OTHER_SPACE}]|[ \n][ \n]|^[ \n]|[ \n]\\z"
_SAFE_SPACE = re.compile(f"(?<=[^ \n{_OTHER_SPACE}]) (?=[^ \n{_OTHER_SPACE}])")
_LETTER_OR_DIGIT = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_PACKERS = [Struct("<%dI" % n) for n in range(64)]


def _byte_letters() -> dict[int, int]:
    """The byte-level vocabularies' letter for each byte: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class WordEncoder:
    """``encode(texts)`` gives, per text, its ids as little-endian unsigned 32-bit integers (null: none).

    The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, in which the string
    of a special token inside a text becomes that token. With ``specials_as_text`` it is ordinary text instead.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS, specials_as_text: bool = False):
        from tokenizers import Tokenizer

        self.max_words = max_words
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = specials_as_text
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        #: Word-end vocabularies drop white space; byte-level ones keep a newline as one id of its own.
        self.drops_space = "Removed" in str(described["pre_tokenizer"])
        self.specials = [] if specials_as_text else [t["content"] for t in described["added_tokens"]]
        self.tokenize = self.library.model.tokenize
        self.newline = b"" if self.drops_space else self._ids(["\n"])[0]
        self.seen: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _piece(self, letters: str) -> bytes:
        """Ids that the library's model gives for one piece of a text, a space before it being its letter."""
        ids = [t.id for t in self.tokenize(letters)]
        return _PACKERS[len(ids)].pack(*ids) if len(ids) < 64 else np.array(ids, dtype="<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, words: list[str]) -> None:
        """A word of letters is one piece for the library's model; any other is encoded as a text of its own with
        what stands before it."""
        seen, piece, space = self.seen, self._piece, "" if self.drops_space else "\u0120"
        opening, other = "" if self.drops_space else "\n", []
        for word, plain in zip(words, pc.match_substring_regex(pa.array(words, pa.large_string()), _LATIN).to_pylist()):
            if not plain:
                other.append(word)
                continue
            body = word.lower() if self.drops_space else word
            letters = space + (body if body.isascii() else body.encode().decode("latin-1").translate(_LETTERS))
            seen[word] = piece(letters)
        for i in range(0, len(other), WORDS_PER_CALL):
            some = other[i : i + WORDS_PER_CALL]
            seen.update(zip(some, self._ids([w if self.drops_space or w[0] == opening else " " + w for w in some])))

    def _closing(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self._piece(marks)
        return self.marks[marks]

    def encode(self, texts) -> list[bytes]:
        """``texts`` is an Arrow array or a list of strings."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        out: list[bytes] = []
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES_AT_ONCE, side="right")))
            out += self._encode(pc.fill_null(texts.slice(a, b - a), ""))
            a = b
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        if not 0 < len(self.seen) <= self.max_words:
            self.seen = {"": b"", "\n": self.newline}
        whole = np.zeros(len(texts), bool)
        for s in self.specials:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        apart = np.zeros(len(texts), bool) if self.drops_space else pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False) & ~whole
        out: list[bytes] = [b""] * len(texts)
        even = np.flatnonzero(~whole & ~apart)
        if len(even):
            some = texts if len(even) == len(texts) else texts.take(pa.array(even))
            for i, ids in zip(even.tolist(), self._even(some)):
                out[i] = ids
        at = np.flatnonzero(apart).tolist()
        pieces = [_SAFE_SPACE.split(texts[i].as_py()) for i in at]
        for i, head, tail in zip(at, self._ids([p[0] for p in pieces]), pieces):
            out[i] = head + b"".join(self._words(tail[1:]))
        at = np.flatnonzero(whole).tolist()
        for i, ids in zip(at, self._ids([texts[i].as_py() for i in at])):
            out[i] = ids
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.seen.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            self._learn([words[i] for i in new])
            for i in new:
                found[i] = self.seen[words[i]]
        return found

    def _even(self, texts: pa.Array) -> list[bytes]:
        if self.drops_space:
            lists = pc.ascii_split_whitespace(texts)
        else:  # a word that opens a line, or the text, has the newline as its first letter
            opened = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar("\n", pa.large_string()))
            lists = pc.split_pattern(pc.replace_substring(opened, "\n", " \n"), " ")
        words = lists.flatten().dictionary_encode()
        bodies, marks = (part.dictionary_encode() for part in _closing_marks(words.dictionary))
        n_bodies, pieces = len(bodies.dictionary), np.empty(2 * len(words.dictionary), np.int64)
        pieces[0::2], pieces[1::2] = bodies.indices.to_numpy(), marks.indices.to_numpy() + n_bodies
        known = self._words(bodies.dictionary.to_numpy(zero_copy_only=False).tolist()) + list(map(self._closing, marks.dictionary.to_pylist()))
        by_word, ends = _gather(known, pieces)
        ids, ends = _gather_runs(by_word, ends[::2], words.indices.to_numpy())
        raw = ids.tobytes()
        cuts = 4 * ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        opening = len(self.newline)  # the newline that stood for the text's start
        return [raw[a + opening : b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _closing_marks(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word's body and closing marks; a body that isn't known to end in a letter or digit keeps its marks."""
    if not pc.sum(pc.binary_length(words)).as_py():
        return words, words
    starts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    ends = starts[:-1] + pc.binary_length(pc.ascii_rtrim(words, _MARKS)).to_numpy()
    last, before = data[np.maximum(ends - 1, 0)], data[np.maximum(ends - 2, 0)]
    known = _LETTER_OR_DIGIT[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    ends = np.where((ends > starts[:-1]) & known, ends, starts[1:])
    edges = np.empty(2 * len(words) + 1, np.int64)
    edges[0::2], edges[1::2] = starts, ends
    both = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(edges), words.buffers()[2])
    return both.take(pa.array(np.arange(0, 2 * len(words), 2))), both.take(pa.array(np.arange(1, 2 * len(words), 2)))


def _gather(parts: list[bytes], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the parts one after another as used, and where each use begins and the last one ends."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return _gather_runs(np.frombuffer(b"".join(parts), "<u4"), np.concatenate([[0], np.cumsum(sizes)]), used)


def _gather_runs(held: np.ndarray, edges: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = (edges[1:] - edges[:-1])[used]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return held[np.repeat(edges[:-1][used] - ends[:-1], lengths) + np.arange(ends[-1])], ends


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, max_words: int = MAX_WORDS, specials_as_text: bool = False) -> WordEncoder:
    """This worker's encoder for the vocabulary file."""
    key = (path, max_words, specials_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def public_vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
