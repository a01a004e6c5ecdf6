"""Token ids by the ``tokenizers`` library, with its work shared between equal words.

A byte-level BPE splits a text by a fixed pattern and encodes each piece on its
own, so equal pieces have equal ids. Pieces are found and looked up by array
operations, by their bytes; the library encodes each piece that is not held.
Texts with characters outside the ranges that the array split covers, texts that
hold a special string of the tokenizer, and all texts of tokenizers of another build go
to the library whole.
"""

from __future__ import annotations

import os
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa

from . import textnum as tn

TABLE_BITS = 20
#: bytes of text that are split at a time
SLICE = 400_000
#: ids that are held at a time, and longer pieces
MAX_HELD, MAX_LONG = 4_000_000, 50_000
#: a piece of so many bytes fits the two numbers of a table entry, with its length
SHORT = 15

# Byte classes of the split pattern of byte-level BPE
# ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[32, *range(9, 14)]] = _SPACE
_SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
# U+00C0 to U+024F are letters, but for two signs; other characters than these and ASCII are left to the library
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xCA] = True
_ODD_ASCII = np.zeros(256, bool)
_ODD_ASCII[[*range(0, 9), 11, 12, *range(14, 32), 127]] = True


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has only characters that ``pieces`` splits exactly."""
    bad = _ODD_ASCII[data] | ((data >= 0xC0) & ~_LEADS[data])
    sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    bad[:-1] |= sign
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[offsets[1:]] == total[offsets[:-1]]


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The starts of the pieces of all rows (empty rows have none)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start |= edge[:n]
    # the last white space before a word is a piece of its own, or a space goes with the word
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n])
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    for suffix in _SUFFIXES:
        at = quote
        for j, b in enumerate(suffix, 1):
            at = at[at + j < n]
            at = at[(data[at + j] == b) & ~edge[at + j]]
        start[at + 1] = False
        end = at + 1 + len(suffix)
        start[end[end < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes the rows of string columns, as the library does without its special tokens' template."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        split = self.tok.pre_tokenizer
        self.by_piece = type(split).__name__ == "ByteLevel" and not split.add_prefix_space and split.use_regex and self.tok.normalizer is None
        # the library takes these strings out of a text before it splits it
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        # a table of the short pieces by their bytes (two numbers, the length on top), and the longer ones by their bytes
        size = 1 << TABLE_BITS
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.at, self.n = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.held = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, raw: list[bytes]) -> dict[bytes, tuple[int, int]]:
        """Hold the ids of pieces, from the library's model, which takes bytes as printable characters: {piece: (place, count)}."""
        tokenize = self.tok.model.tokenize
        text = _PRINTABLE[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        ends = list(accumulate(map(len, raw), initial=0))
        ids = [[t.id for t in tokenize(text[a:b])] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n = list(map(len, ids))
        at = list(accumulate(n, initial=self.used))
        if at[-1] > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(at[-1], 2 * len(self.held)) - len(self.held), np.uint32)])
        self.held[self.used : at[-1]] = list(chain.from_iterable(ids))
        self.used = at[-1]
        return dict(zip(raw, zip(at[:-1], n, strict=True), strict=True))

    def _by_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, count of each row)."""
        start = pieces(data, offsets)
        rows = np.searchsorted(start, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(data))
        if self.used > MAX_HELD or len(self.long) > MAX_LONG:
            self._clear()
        size, eight = end - start, tn.loads(data)
        low = eight[start] & tn.LOW[np.minimum(size, 8)]
        high = (eight[np.minimum(start + 8, len(data))] & tn.LOW[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
        slot = (tn.mix(low ^ tn.mix(high)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        short = size <= SHORT
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        miss = np.flatnonzero(~(short & (self.low[slot] == low) & (self.high[slot] == high)))
        if len(miss):
            raw = data.tobytes()
            own = [raw[a:b] for a, b in zip(start[miss].tolist(), end[miss].tolist(), strict=True)]
            known = self._learn([x for x in dict.fromkeys(own) if x not in self.long])
            self.long.update((x, v) for x, v in known.items() if len(x) > SHORT)
            at[miss], n[miss] = np.array([known.get(x) or self.long[x] for x in own]).T
            put = miss[short[miss]]
            to = slot[put]
            # of two pieces in a slot the last one written holds in all four arrays
            self.low[to], self.high[to], self.at[to], self.n[to] = low[put], high[put], at[put], n[put]
        before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = self.held[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
        return ids, np.diff(before[rows])

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows that ``_by_piece`` encodes as the library does."""
        if not self.by_piece or not len(data):
            return np.full(len(offsets) - 1, self.by_piece)
        out, raw = plain_rows(data, offsets), data.tobytes()
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = False
                at = raw.find(x, at + 1)
        return out

    def encode(self, col: pa.Array):
        """For slices of the rows: (first row, ids, count of each row); null is empty."""
        data, offsets = tn.text_bytes(col)
        for i, j in tn.slices(offsets, SLICE):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            plain = self._plain(part, own)
            if plain.all():
                ids, n = self._by_piece(part, own)
                yield i, ids, n
                continue
            for r in range(j - i):  # row by row, so that each goes its way
                text = part[own[r] : own[r + 1]]
                if plain[r]:
                    ids, n = self._by_piece(text, np.array([0, len(text)]))
                else:
                    ids = np.array(self._library([text.tobytes().decode()])[0], np.uint32)
                    n = np.array([len(ids)])
                yield i + r, ids, n


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process; it stays from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _printable() -> np.ndarray:
    """Byte-level BPE shows a byte as itself if Latin-1 prints it, and the others as the characters from 256 on, in their order."""
    shown = np.zeros(256, bool)
    shown[[*range(33, 127), *range(161, 173), *range(174, 256)]] = True
    return np.where(shown, np.arange(256), 255 + np.cumsum(~shown)).astype("<u4")


_PRINTABLE = _printable()
