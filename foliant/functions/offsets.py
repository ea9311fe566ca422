"""Where text in its comparison form stands in the raw text, as a compact map.

The comparison form mostly follows the raw text byte by byte; it departs from it where white space collapses, a hyphen
joins two lines, or a character becomes another of a different width. A map therefore holds runs: in a linear run an
output byte stands for the raw byte at a constant distance, in a block all output bytes stand for the same raw bytes (a
ligature that became two letters, a dash of three bytes that became one). Runs are written as differences in variable-length
integers; of every ``EVERY``-th run a directory holds the absolute places, so a place is found by a binary search there
(rank) and a few steps from it (select), whatever the text's length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

from foliant.functions.text import DASHES, DOUBLE_QUOTES, SIMPLE, SINGLE_QUOTES, SOFT_HYPHEN, SPACES, normalize

EVERY = 32
HEAD = struct.Struct("<III")  # runs, output bytes, entries of the directory
ENTRY = struct.Struct("<III")  # output byte, raw byte, place in the runs


def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def _read(raw: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = raw[at]
        x, shift, at = x | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return x, at


Run = tuple[int, int, int, int, bool]  # output start and length, raw start and length, whether it is a block


def packed(runs: Iterable[Run]) -> bytes:
    """Runs as a map."""
    body, entries, n, out_end, raw_end = bytearray(), [], 0, 0, 0
    for start, size, raw, width, block in runs:
        if n % EVERY == 0:
            entries.append(ENTRY.pack(start, raw, len(body)))
            raw_end = raw
        # A block says so in the lowest bit of its length, and has its raw length after the gap before it.
        body += _varint(size << 1 | block)
        gap = raw - raw_end
        body += _varint(gap << 1 if gap >= 0 else -gap << 1 | 1)
        if block:
            body += _varint(width)
        n, out_end, raw_end = n + 1, start + size, raw + width
    return HEAD.pack(n, out_end, len(entries)) + b"".join(entries) + bytes(body)


class OffsetMap:
    """A packed map, read where it is asked."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.n, self.size, self.entries = HEAD.unpack_from(raw)
        self.body = HEAD.size + self.entries * ENTRY.size

    def _entry(self, k: int) -> tuple[int, int, int]:
        return ENTRY.unpack_from(self.raw, HEAD.size + k * ENTRY.size)

    def runs(self, entry: int = 0) -> Iterator[Run]:
        """Runs from a directory entry on."""
        at, k, start, raw_end = 0, entry * EVERY, 0, 0
        while k < self.n:
            if k % EVERY == 0:
                start, raw_end, at = self._entry(k // EVERY)
            x, at = _read(self.raw, self.body + at)
            y, at = _read(self.raw, at)
            size, raw = x >> 1, raw_end + (-(y >> 1) if y & 1 else y >> 1)
            width = size
            if x & 1:
                width, at = _read(self.raw, at)
            at -= self.body
            yield start, size, raw, width, bool(x & 1)
            start, raw_end, k = start + size, raw + width, k + 1

    def run_at(self, byte: int) -> Run:
        """The run that holds an output byte."""
        low, high = 0, self.entries
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._entry(mid)[0] <= byte else (low, mid)
        for run in self.runs(low):
            if run[0] + run[1] > byte:
                return run
        raise IndexError(byte)

    def source_range(self, start: int, end: int) -> tuple[int, int] | None:
        """Raw bytes behind output bytes start to end, which are whole characters; None if that is empty or out of
        bounds."""
        if not 0 <= start < end <= self.size:
            return None
        a, b = self.run_at(start), self.run_at(end - 1)
        return a[2] + (0 if a[4] else start - a[0]), b[2] + (b[3] if b[4] else end - b[0])


def runs_of_ranges(text: str, starts: np.ndarray, ends: np.ndarray) -> Iterable[Run]:
    """Runs of the raw range of each byte of the comparison form."""
    if not len(starts):
        return ()
    at = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])))
    characters = np.add.reduceat((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80, at, dtype=np.int64)
    size = np.diff(np.append(at, len(starts)))
    raw, width = starts[at], ends[at] - starts[at]
    # Characters as wide as before, one after the other, are one run.
    same = (size == width) & (characters == 1)
    joins = np.append(False, same[1:] & same[:-1] & (raw[1:] == raw[:-1] + width[:-1]))
    lead = np.flatnonzero(~joins)
    total = np.add.reduceat(size, lead)
    return zip(at[lead].tolist(), total.tolist(), raw[lead].tolist(), np.where(same[lead], total, width[lead]).tolist(), (~same[lead]).tolist())


_GONE, _BLANK = 0xFFFFFFFF, 32


@cache
def _forms() -> tuple[np.ndarray, np.ndarray]:
    """What becomes of each character of a simple text, and which are white space."""
    stand_in = {**dict.fromkeys(DASHES, DASHES[0]), **dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"')}
    forms = np.array([ord(stand_in.get(chr(c), chr(c).lower()[0])) for c in range(0x2020)], np.uint32)
    forms[ord(SOFT_HYPHEN)] = _GONE
    return forms, np.isin(np.arange(0x2020), [ord(c) for c in SPACES])


def compared_ranges(raw: str) -> tuple[str, np.ndarray, np.ndarray]:
    """A text's comparison form, and the raw byte range of each of its bytes."""
    if not SIMPLE.fullmatch(raw):
        n = normalize(raw)
        return n.text, np.array(n.starts, np.int64), np.array(n.ends, np.int64)
    forms, spaces = _forms()
    chars = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
    wide = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF)
    first = np.cumsum(wide) - wide
    form = forms[chars]
    stays = np.flatnonzero(form != _GONE)
    form = form[stays]
    # Each gap: gone after a hyphen if it has a line feed, and the hyphen with it; else its first character is the space.
    blank = spaces[chars[stays]]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], blank, [False]])))
    begin, stop = edge[::2], edge[1::2]
    feeds = np.concatenate([[0], np.cumsum(form == 10)])
    joins = (feeds[stop] > feeds[begin]) & (begin > 0) & (form[begin - 1] == 45) if len(begin) else np.zeros(0, bool)
    keep = ~blank
    keep[begin[joins] - 1] = False
    solid = np.flatnonzero(keep)
    kept = begin[~joins]
    keep[kept] = True
    form[kept] = _BLANK
    if len(solid):
        keep[: solid[0]] = keep[solid[-1] + 1 :] = False
    else:
        keep[:] = False
    at = stays[keep]
    out = form[keep]
    out[out == ord(DASHES[0])] = 45
    width = 1 + (out > 0x7F).astype(np.int64)
    starts = np.repeat(first[at], width)
    return out.astype("<u4").tobytes().decode("utf-32-le"), starts, starts + np.repeat(wide[at], width)


def offset_map(raw: str) -> bytes:
    """The map of a text's comparison form."""
    return packed(runs_of_ranges(*compared_ranges(raw)))
