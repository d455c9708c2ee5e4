"""Vectorised helpers over the UTF-8 bytes of an Arrow text column.

The Python operators of this subpackage work inside ``mapInArrow`` tasks.  They
look at a whole Arrow batch of texts as one byte buffer plus offsets, so that
splitting into words and hashing words cost a few numpy passes instead of a
Python object per word.  Every helper sees whole texts and treats null as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Whitespace of the word definition ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


#: Byte table that lower-cases A-Z and nothing else.
LOWER = _lower_table()


def nonspace_table() -> np.ndarray:
    """Byte table of ``[^\\x20\\x09-\\x0D]``; multi-byte characters are never space."""
    table = np.ones(256, dtype=bool)
    table[list(SPACE_BYTES)] = False
    return table


def alnum_table() -> np.ndarray:
    """Byte table of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its offsets (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(offsets: np.ndarray, size: int = 1 << 19):
    """Ranges of rows of about ``size`` bytes each (a longer row is a block of its own).

    Blocks keep the numpy passes inside the processor's cache and bound memory.
    """
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, rows)
        at = end


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``mask`` that don't cross a row's end.

    Returns the runs' starts and ends, and for each row the number of its first
    run (one more entry than rows).
    """
    n = len(mask)
    before = np.zeros(n, dtype=bool)
    before[1:] = mask[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = mask[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LONG = 4096


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = _powers(0x9E3779B97F4A7C15 | 1, _LONG)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all its bits (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span's bytes; memory is bounded by ``block`` bytes of text.

    A span longer than 4096 bytes is hashed piece by piece, with the same result
    wherever it stands.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    total = np.concatenate(([0], np.cumsum(np.minimum(lengths, _LONG))))
    cuts = np.unique(np.append(np.searchsorted(total[:-1], np.arange(0, total[-1], block)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        size = np.minimum(lengths[a:b], _LONG)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        value = (data[np.repeat(starts[a:b], size) + within].astype(np.uint64) + np.uint64(1)) * _TABLE[within]
        out[a:b] = np.add.reduceat(value, first)
    for i in np.flatnonzero(lengths > _LONG):
        for at in range(int(starts[i]) + _LONG, int(ends[i]), _LONG):
            piece = data[at : min(at + _LONG, int(ends[i]))].astype(np.uint64) + np.uint64(1)
            out[i] = mix(out[i : i + 1])[0] + np.add.reduce(piece * _TABLE[: len(piece)])
    return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def factorize(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place among the distinct ones, which stand in order of first appearance, and these."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed LONG."""
    return values.view(np.int64)
