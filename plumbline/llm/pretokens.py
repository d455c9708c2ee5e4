"""Byte-level BPE encoding that meets each distinct piece of text once per worker.

A byte-level BPE first cuts a text into pieces (words with their leading space,
runs of digits, of signs, of blanks) and merges inside each piece only.  Most
pieces repeat, so the pieces of a batch are found with numpy passes, and only
those not seen before go to the tokenizer; their ids are kept in the worker.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from plumbline.llm import textbytes as tb

_OTHER, _LETTER, _NUMBER, _BLANK = range(4)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L" or kind == "N":
            table[code] = _LETTER if kind == "L" else _NUMBER
    table[_WHITE] = _BLANK
    return table


def _alphabet() -> dict[int, int]:
    """Byte-level BPE writes a byte as itself if it is a visible Latin-1 sign, else as 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def piece_starts(codes: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of several texts, whose ends are in ``rows``.

    The rule is the byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[codes]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    begins = rows[:-1][rows[:-1] < n]
    start[begins] = True
    run = np.flatnonzero(start)
    stop = np.append(run[1:], n)
    of = kind[run]
    follows = np.zeros(len(run), bool)  # the next run is of the same text
    follows[:-1] = ~np.isin(run[1:], begins)
    blank = np.flatnonzero((of == _BLANK) & follows)
    start[stop[blank] - 1] = True
    spaced = blank[codes[stop[blank] - 1] == 0x20]
    start[run[spaced + 1]] = False
    quote = np.flatnonzero((of[:-1] == _OTHER) & follows[:-1] & (of[1:] == _LETTER)) if len(run) > 1 else np.zeros(0, np.int64)
    quote = quote[(stop[quote] - run[quote] == 1) & (codes[run[quote]] == 0x27) & start[run[quote]]]
    for q in quote:
        a, b = run[q + 1], stop[q + 1]
        text = "".join(map(chr, codes[a : min(a + 2, b)]))
        size = next((len(s) for s in _SUFFIXES if text.startswith(s)), 0)
        if size:
            start[a] = False
            if a + size < b:
                start[a + size] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Encodes columns of texts with a tokenizers file; equal to encoding each text by itself."""

    def __init__(self, path: str, most_pieces: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.plain = made["model"]["type"] == "BPE" and not made.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.added = [t["content"].encode() for t in made.get("added_tokens", [])]
        self.classes = _classes() if self.plain else None
        self.alphabet = _alphabet()
        self.most_pieces = most_pieces
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of the pieces met, and their slots
        self.slots = np.zeros(0, np.int32)
        self.count = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.pieces = self.used = 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Have the tokenizer's model merge new pieces, in its alphabet of one character per byte."""
        tokenize = self.tokenizer.model.tokenize
        found, count = array("I"), array("i")
        for x in pieces:
            ids = [t.id for t in tokenize(x.decode("latin-1").translate(self.alphabet))]
            found.extend(ids)
            count.append(len(ids))
        found, count = np.frombuffer(found, np.uint32), np.frombuffer(count, np.int32)
        p, u = self.pieces + len(count), self.used + len(found)
        while p > len(self.count):
            self.count, self.at = np.resize(self.count, 2 * len(self.count)), np.resize(self.at, 2 * len(self.at))
        while u > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.count[self.pieces : p] = count
        self.at[self.pieces : p] = self.used + np.cumsum(count) - count
        self.pool[self.used : u] = found
        keys = np.concatenate((self.keys, hashes))
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], np.concatenate((self.slots, np.arange(self.pieces, p, dtype=np.int32)))[order]
        self.pieces, self.used = p, u

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of pieces by hash, -1 for those not met."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.slots[at], -1).astype(np.int64)

    def _direct(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start and end of each piece of a block, its hash, and the first piece of each row."""
        lead = (data & 0xC0) != 0x80
        where = np.append(np.flatnonzero(lead), len(data))
        rows = np.searchsorted(where, offsets)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begin = piece_starts(codes, rows, self.classes)
        starts = where[begin]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        return starts, ends, tb.span_hashes(data, starts, ends), np.searchsorted(begin, rows)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, and how many each has."""
        parts = [(offsets[a], *self._pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in tb.row_blocks(offsets)]
        index, distinct = tb.factorize(np.concatenate([x[3] for x in parts]))
        if self.pieces + len(distinct) > self.most_pieces:
            self._clear()
        slots = self._find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            example = np.zeros(len(distinct), np.int64)
            example[index[::-1]] = np.arange(len(index))[::-1]
            starts, ends = (np.concatenate([x[0] + x[k] for x in parts])[example[new]] for k in (1, 2))
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
            slots[new] = np.arange(self.pieces - len(new), self.pieces)
        ids, sizes, done = [], [], 0
        for _, starts, _, _, first in parts:
            slot = slots[index[done : done + len(starts)]]
            done += len(starts)
            count = self.count[slot]
            total = np.cumsum(count, dtype=np.int64)
            from_pool = np.arange(total[-1] if len(total) else 0) + np.repeat(self.at[slot] - total + count, count)
            ids.append(self.pool[from_pool])
            sizes.append(np.diff(np.concatenate(([0], total))[first]))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts one after the other, and the number of ids of each."""
        data, offsets = tb.text_buffer(column)
        if len(offsets) == 1:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = data.tobytes()
        if self.plain and not any(t in raw for t in self.added):
            return self._whole(data, offsets)
        each = [self._direct(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
