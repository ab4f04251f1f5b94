"""Tokens of many texts at once, as the libraries of public tokenizers give them.

Byte-level BPE never joins tokens across a space that stands between two other signs, so a text's tokens are those of its words, each with the
space before it. Neither does it join them between a letter or digit and the signs that end a word, so these signs are a piece of their own and a word
is the same one whatever stands behind it. A batch is cut into such pieces by Arrow, every distinct piece of the batch is looked up once, and numpy lays
the ids out: no Python step per word of the text. Ids come from the library; a worker remembers those of pieces that it has met.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable, Iterator
from hashlib import sha256
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 200_000  # words whose ids a worker remembers, twice at most
CHUNK_BYTES = 1 << 20  # of text that is worked on at once; a longer text is a chunk of its own
SLICE_WORDS = 1 << 15  # of a chunk, whose ids are laid at once

SIGNS = string.punctuation
# Byte-level vocabularies spell bytes as letters: printable ones as themselves, the others as the letters from 256 on.
_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_printable))}
SPACE = chr(BYTE_LETTERS[0x20])
# White space other than single spaces and line ends between words.
_ODD_SPACE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| [ \n]|\n[ \n]|^ | $"
# Signs that end a word behind a digit or a letter that all versions of Unicode know as one. Texts with tabs are odd, so a tab can mark the signs.
_END_SIGNS, _MARKED_SIGNS = rf"([0-9A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{24f}}])([{re.escape(SIGNS)}]+)([ \n]|$)", r"\1 " + "\t" + r"\2\3"
_between = re.compile(r"(?<=\S) (?=\S)")


class Remembered(dict):
    """Words met so far with their ids. When it is full it forgets the words that were not met since it was last full."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        self[word] = ids = self.make(word) if ids is None else ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Words:
    """Token ids by a `.json` tokenizer. `specials` tells whether strings of special tokens inside a text become those tokens."""

    def __init__(self, path: str, specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        split = rules.get("pre_tokenizer") or {}
        # Whether the words' tokens are the text's: bytes as they are, the usual splitting, no space put before a text.
        self.by_word = rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if specials or not t.special]
        self.added = "|".join(re.escape(a) for a in added if a)
        self.signs = Remembered(self.encode, 10_000)
        self.known = Remembered(self.piece, MOST_WORDS)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, by the library's own splitting."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def word(self, space: str, word: str) -> bytes:
        """Ids of a word. The splitting leaves letters whole and parts them from the signs behind them, so letters go to the library's model directly."""
        letters = word if word.isalpha() else word.rstrip(SIGNS)
        if not letters.isalpha():
            return self.encode(space + word)
        spelt = (SPACE if space else "") + letters if letters.isascii() else (space + letters).encode().decode("latin-1").translate(BYTE_LETTERS)
        tokens = self.model.tokenize(spelt)
        ids = pack(f"<{len(tokens)}I", *[token.id for token in tokens])
        return ids + self.signs[word[len(letters) :]] if len(letters) < len(word) else ids

    def piece(self, piece: str) -> bytes:
        """Ids of a word that stands behind a space, or, marked by a line end, behind a line end, or, marked by a tab, of the signs that end a word."""
        if piece[:1] == "\t":
            return self.signs[piece[1:]]
        if piece[:1] != "\n":
            return self.word(" ", piece)
        return self.signs["\n"] + (self.word("", piece[1:]) if len(piece) > 1 else b"")

    def whole(self, text: str) -> bytes:
        """Ids of a text with odd white space: cut at single spaces between words only."""
        first, *rest = _between.split(text)
        return b"".join([self.encode(first), *[self.known[p] if p.isalpha() else self.encode(" " + p) for p in rest]])

    def laid(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and where each text's begin (one more entry at the end)."""
        texts = texts.fill_null("")
        if not self.by_word:
            return _joined([self.encode(t) for t in texts.to_pylist()])
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        special = pc.match_substring_regex(texts, self.added) if self.added else pa.array(np.zeros(len(texts), dtype=bool))
        apart = np.flatnonzero(pc.or_(odd, special).to_numpy(zero_copy_only=False))
        if len(apart):
            own = {int(i): self.encode(texts[i].as_py()) if special[i].as_py() else self.whole(texts[i].as_py()) for i in apart}
            usual = np.ones(len(texts), dtype=bool)
            usual[apart] = False
            ids, bounds = self.laid_usual(texts.filter(pa.array(usual)))
            place = np.cumsum(usual) - 1
            return _joined([own[i] if i in own else ids[bounds[place[i]] : bounds[place[i] + 1]].tobytes() for i in range(len(texts))])
        return self.laid_usual(texts)

    def laid_usual(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Every word behind a line end gets a mark, and so does the first one; the mark's id is taken away again below.
        parted = pc.replace_substring_regex(texts, _END_SIGNS, _MARKED_SIGNS)
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(parted, "\n", " \n"), "")
        del parted
        pieces = pc.split_pattern(marked.cast(pa.large_string()), " ")
        del marked
        begin = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        words = pieces.flatten().dictionary_encode()
        del pieces
        code = words.indices.to_numpy()
        ids, at = _joined([self.known[w] for w in _strings(words.dictionary)])
        n = np.diff(at).astype(np.int32)[code]
        start = at[:-1].astype(np.int32)[code]
        del words, code
        start[begin[:-1]] += 1
        n[begin[:-1]] -= 1
        upto = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        out = np.empty(upto[-1], dtype="<u4")
        for low in range(0, len(n), SLICE_WORDS):  # so that the places of a chunk's ids are never all in memory
            own, end = slice(low, low + SLICE_WORDS), min(low + SLICE_WORDS, len(n))
            place = np.repeat((start[own] - (upto[low:end] - upto[low])).astype(np.int32), n[own])
            place += np.arange(len(place), dtype=np.int32)
            np.take(ids, place, out=out[upto[low] : upto[end]])
        return out, upto[begin]

    def ids(self, text: str) -> bytes:
        """Ids of one text as little-endian 32-bit bytes."""
        return self.laid(pa.array([text], pa.string()))[0].tobytes()

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.laid(texts)[1])

    def forget(self) -> None:
        self.known.forget()


class Pieces:
    """Token counts by a `.model` of sentencepiece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(ids) for ids in self.model.encode(texts.fill_null("").to_pylist(), num_threads=1)], dtype=np.int64)

    def forget(self) -> None:
        pass


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4)))
    return np.frombuffer(b"".join(parts), dtype="<u4"), bounds


def _strings(words: pa.LargeStringArray) -> list[str]:
    """`words`, which hold no spaces, as Python strings: read as one string and cut, which costs a fraction of a scalar for each."""
    listed = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    return pc.binary_join(listed, pa.scalar(" ", words.type))[0].as_py().split(" ") if len(words) else []


def chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string column of about CHUNK_BYTES each, with the number of their first text."""
    upto = np.concatenate(([0], np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False), dtype=np.int64)))
    low = 0
    while low < len(texts):
        high = min(max(int(np.searchsorted(upto, upto[low] + CHUNK_BYTES, side="right")) - 1, low + 1), len(texts))
        yield low, texts.slice(low, high - low)
        pa.default_memory_pool().release_unused()  # or Arrow's allocator keeps what the largest chunk took
        low = high


_encoders: dict[tuple, Words | Pieces] = {}


def encoder(path: str, specials: bool = False) -> Words | Pieces:
    """The worker's own encoder, kept from task to task: `.model` files go to sentencepiece, all others to tokenizers."""
    key = (path, specials)
    if key not in _encoders:
        _encoders[key] = Pieces(path) if path.endswith(".model") else Words(path, specials)
    return _encoders[key]


def version(path: str) -> str:
    """A digest of the tokenizer: its file, and the library that reads it with the library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return sha256(f"{library.__name__} {library.__version__}\n".encode() + Path(path).read_bytes()).hexdigest()
