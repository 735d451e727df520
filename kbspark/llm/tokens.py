"""Byte-level BPE ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces of text in each of the two generations that a task remembers.
REMEMBERED = 250_000

# Fixed value: how byte-level BPE divides a text before merging, for the
# characters of _PLAIN alone, with their classes written out.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_DIVIDE_PLAIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
#: White space before a space: there a text is not cut at the space.
_RUN = re.compile(r"\s |^ ")
_RUNS = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
#: Characters whose classes are the same in every Unicode version and library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ſ]*")


class Memo(dict):
    """Piece to the ids as bytes; unknown pieces are encoded when asked for.

    When this generation is full it becomes the older one, whose pieces are
    taken over as they recur, so memory is bounded and frequent pieces stay."""

    def __init__(self, encode, remembered: int = REMEMBERED):
        super().__init__()
        self.encode, self.remembered = encode, remembered
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """Ids of a text as ``tokenizers`` gives them, with no special tokens added.

    A space after a character that is not white space always opens a new piece, so a text is cut
    there and the ids of each distinct piece are asked of the library once.
    A text that holds a special token's string, or white space before a space, goes to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), 1)
        self.dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
        self.code = "H" if size <= 65_536 else "I"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        table = [None] * 256
        for byte, char in _byte_letters().items():
            table[byte] = char
        self.letters = dict(enumerate(table))
        self.word = Memo(self._merge)
        self.after_space = Memo(lambda piece: self._divide(" " + piece))

    def first_free_id(self) -> int:
        """The first id above all that the tokenizer can give, added tokens included."""
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merge(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            shown = word.replace(" ", self.letters[32])
        else:
            shown = word.encode("utf-8").decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _divide(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self._library(piece)
        known = self.word
        return b"".join([known[w] for w in _DIVIDE_PLAIN.findall(piece)])

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, little-endian, ``dtype`` wide."""
        if not text:
            return b""
        if self.special is not None and self.special.search(text):
            return self._library(text)
        if _RUN.search(text):
            return self._divide(text)  # rare: not cut at spaces
        pieces = text.split(" ")
        known = self.after_space
        first = self._divide(pieces[0])
        return first + b"".join([known[p] for p in pieces[1:]])


    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all whole texts one after the other, where each begins and the last ends).

        Texts are cut as in ``encode``; each distinct cut of the batch is encoded once, and ids are gathered by number."""
        texts = texts.cast(pa.large_string()).fill_null("")
        strings = texts.to_pylist()
        whole = [self.special is not None and self.special.search(t) is not None for t in strings]
        uncut = [w or t[:1] == " " or any(r in t for r in _RUNS) for t, w in zip(strings, whole)]
        cuts = pc.split_pattern(pc.if_else(pa.array(uncut, pa.bool_()), pa.scalar("", pa.large_string()), texts), " ")
        named = cuts.flatten().dictionary_encode()
        words, which = named.dictionary.to_pylist(), named.indices.to_numpy().astype(np.int64)
        begins = cuts.offsets.to_numpy().astype(np.int64)
        openings: dict[tuple[str, bool], int] = {}  # of texts: without a space before
        for i, (at, text) in enumerate(zip(begins[:-1].tolist(), strings)):
            cut = text if uncut[i] else words[which[at]]
            which[at] = len(words) + openings.setdefault((cut, whole[i]), len(openings))
        plain, known = _PLAIN.fullmatch("".join(words)), self.word
        if plain:
            data = [b"".join([known[w] for w in _DIVIDE_PLAIN.findall(" " + c)]) for c in words]
        else:
            data = [self._divide(" " + c) for c in words]
        data += [self._library(c) if w else self._divide(c) for c, w in openings]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // self.dtype.itemsize
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])),
                                              pa.array(np.frombuffer(b"".join(data), self.dtype)))
        ids = lists.take(pa.array(which)).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids, upto[begins]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the
    others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(shown))
    return letters


_LOADED: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    """One per worker process, so that what it remembers serves all its tasks."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]

