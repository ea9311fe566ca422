"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct pre-token encoded once.

The library's pre-tokenizer cuts a text into pre-tokens and encodes each by itself. Here the cuts of texts made of
ASCII and Latin letters are found with array operations on the bytes, every distinct pre-token is encoded by the
library itself, and its ids are kept, by its bytes, in a bounded table that a worker keeps between tasks. Any other
text, any that holds an added token's content (``<|endoftext|>``), and every text if the tokenizer's file names other
rules than the known ones, goes to the library whole. Both ways give the library's ids exactly (the tests hold one
against the other).
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa

from foliant.llm.shared import chunks, utf8

#: Distinct pre-tokens that are kept; beyond it the table starts anew, which costs time and changes no id.
KEPT = 1_000_000
#: Bytes of text that are encoded at once.
BYTES = 1 << 20
L, N, W, P, END, BAD = 1, 2, 3, 4, 5, 6
KIND = np.full(256, BAD, np.uint8)
KIND[33:127] = P
KIND[[*range(65, 91), *range(97, 123)]] = L
KIND[48:58] = N
KIND[[9, 10, 13, 32]] = W
KIND[0] = END


def starts_of(b: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Starts of pre-tokens in texts that each end with a zero byte, which is one of its own."""
    n = len(b)
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    k = kind[runs]
    # White space before a token: its last byte goes to the token if it is a space, else stands alone.
    ws = np.flatnonzero(k == W)
    ws = ws[ws + 1 < len(k)]
    ws = ws[k[ws + 1] != END]
    last = ends[ws] - 1
    new[last] = True
    spaces = b[last] == 32
    new[ends[ws][spaces]] = False
    # 's 't 're 've 'm 'll 'd where a token starts with the apostrophe.
    a = np.flatnonzero((b[:-2] == 39) & new[:-2] & (kind[1:-1] == L)) if n > 2 else np.zeros(0, np.int64)
    if len(a):
        c1, c2 = b[a + 1], b[a + 2]
        two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        one = (c1 == 115) | (c1 == 116) | (c1 == 109) | (c1 == 100)
        size = np.where(one, 1, np.where(two, 2, 0))
        a, size = a[size > 0], size[size > 0]
        new[a + 1] = False
        after = a + 1 + size
        new[after] |= kind[after] == L
    return np.flatnonzero(new)


#: The only pre-tokenizer that starts_of() knows; a tokenizer file with another gets every text encoded by the library.
KNOWN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Longer pre-tokens are encoded anew each time.
LONGEST = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eight_bytes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, of a buffer given as 64-bit words."""
    i, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    # a shift by 64 is none in two steps: by one and by the rest
    return (words[i] >> shift) | ((words[i + 1] << np.uint64(1)) << (np.uint64(63) - shift))


class Table:
    """Ids of pre-tokens by their bytes: two 64-bit words hold the bytes of one of up to 16, so equal words are equal
    bytes; longer ones are kept in a dictionary. Entry 0 is the zero byte that ends a text."""

    def __init__(self, kind: type, end_id: int):
        self.n, self.used = 1, 1
        self.place = np.full(1 << 16, -1, np.int32)
        self.words = np.zeros((2, 1 << 15), np.uint64)
        self.offs = np.zeros(1 << 15, np.int32)
        self.sizes = np.zeros(1 << 15, np.int32)
        self.short = np.ones(1 << 15, bool)
        self.flat = np.zeros(1 << 16, kind)
        self.flat[0], self.sizes[0] = end_id, 1
        self.long: dict[bytes, int] = {}
        self._enter(np.zeros(1, np.int64))

    def _home(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        x = (k0 ^ (k1 * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - (len(self.place).bit_length() - 1))).astype(np.int64)

    def _enter(self, entries: np.ndarray) -> None:
        at, mask = self._home(*self.words[:, entries]), len(self.place) - 1
        while len(entries):
            free = self.place[at] < 0
            self.place[at[free]] = entries[free]
            rest = self.place[at] != entries
            entries, at = entries[rest], (at[rest] + 1) & mask

    def find(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """Entries, or -1."""
        at, mask = self._home(k0, k1), len(self.place) - 1
        out = self.place[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & ((self.words[0][out] != k0) | (self.words[1][out] != k1)))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            got = self.place[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & ((self.words[0][got] != k0[todo]) | (self.words[1][got] != k1[todo]))]
        return out

    def add(self, k0: np.ndarray, k1: np.ndarray, short: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries with their ids; only short ones are found by their words."""
        n, m = self.n, len(sizes)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.offs):
            self.offs, self.sizes, self.short = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offs, self.sizes, self.short))
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], 1)
        new = np.arange(n, n + m)
        self.flat[self.used : self.used + len(flat)] = flat
        self.offs[new], self.sizes[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.words[0, new], self.words[1, new] = k0, k1
        self.short[new] = short
        self.n, self.used = n + m, self.used + len(flat)
        if 2 * self.n > len(self.place):
            self.place = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            self._enter(np.flatnonzero(self.short[: self.n]))
        else:
            self._enter(new[short])
        return new


class Encoder:
    """Ids of texts, with an end id after each."""

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # The library cuts added tokens out before it makes pre-tokens.
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.wide = max([self.library.get_vocab_size(), end_id + 1, *(i + 1 for i in self.library.get_added_tokens_decoder())]) > 65536
        self.kind = np.uint32 if self.wide else np.uint16
        self.end_id = end_id
        self.batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        cuts = about.get("pre_tokenizer") or {}
        model = about.get("model") or {}
        self.known = self.line is not None and all(cuts.get(k) == v for k, v in KNOWN.items()) and not any(about.get(k) for k in ("normalizer", "truncation", "padding")) and model.get("type") == "BPE" and not model.get("dropout")
        self.table = Table(self.kind, end_id)

    def whole(self, text: str) -> np.ndarray:
        ids = self.batch([text], add_special_tokens=False)[0].ids
        return np.array([*ids, self.end_id], self.kind)

    def ids_of(self, strings: list[str], lone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pre-tokens by the library; lone: those of white space."""
        order = np.argsort(lone, kind="stable")
        rest = len(order) - int(lone.sum())
        flat, sizes = np.zeros(0, self.kind), np.zeros(0, np.int64)
        if rest:
            # One text of them all: a line feed between two is a pre-token by itself and has one id.
            text = "\n".join([strings[i] for i in order[:rest]])
            ids = np.array(self.batch([text], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == self.line)
            assert len(cut) == rest - 1
            sizes = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
            flat = ids[ids != self.line]
        if rest < len(order):
            got = [x.ids for x in self.batch([strings[i] for i in order[rest:]], add_special_tokens=False)]
            flat = np.concatenate([flat, np.array([i for x in got for i in x], self.kind)])
            sizes = np.concatenate([sizes, [len(x) for x in got]]).astype(np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts = (np.cumsum(sizes) - sizes)[back]
        sizes = sizes[back]
        stops = np.cumsum(sizes)
        return flat[np.arange(int(stops[-1])) + np.repeat(starts - (stops - sizes), sizes)], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 offsets of the texts in them."""
        b, o = utf8(texts)
        parts, lens = [], []
        for i, j in chunks(o, BYTES):
            ids, ln = self._chunk(b[o[i] : o[j]], o[i : j + 1] - o[i])
            parts.append(ids)
            lens.append(ln)
        offs = np.concatenate([[0], np.cumsum(np.concatenate(lens))]) if lens else np.zeros(1, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, self.kind)), offs.astype(np.int64)

    def places_of_added(self, raw: bytes) -> np.ndarray:
        """Where added tokens start; one across two texts only sends the first to the library."""
        out = []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out.append(at)
                at = raw.find(token, at + 1)
        return np.array(out, np.int64)

    def _chunk(self, b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(o) - 1
        # Latin letters are C3 80 to C3 BF without the two signs; whatever else is not ASCII goes to the library.
        kind = KIND[b]
        lead = np.flatnonzero(b == 0xC3)
        if len(lead):
            ok = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
            kind[ok] = kind[ok + 1] = L
        kind[b == 0] = BAD
        lens = np.diff(o)
        if self.known:
            at = np.concatenate([np.flatnonzero(kind == BAD), self.places_of_added(b.tobytes())])
            bad = np.unique(np.searchsorted(o, at, "right") - 1)
        else:
            bad = np.flatnonzero(lens)
        if not len(bad):
            return self._plain(b, kind, lens)
        good = np.ones(n, bool)
        good[bad] = False
        inside = np.repeat(good, lens)
        ids, out = self._plain(b[inside], kind[inside], lens[good])
        pieces, sizes, at, k = [], [], np.concatenate([[0], np.cumsum(out)]), 0
        for x in range(n):
            if good[x]:
                pieces.append(ids[at[k] : at[k + 1]])
                k += 1
            else:
                pieces.append(self.whole(b[o[x] : o[x + 1]].tobytes().decode("utf-8")))
            sizes.append(len(pieces[-1]))
        return np.concatenate(pieces), np.array(sizes, np.int64)

    def _plain(self, b: np.ndarray, kind: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of texts that starts_of() can cut."""
        if not len(lens):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        # Every text gets a zero byte after it, and the buffer whole words and 16 bytes more.
        n = len(b) + len(lens)
        stops = np.cumsum(lens) + np.arange(len(lens))
        inside = np.ones(n, bool)
        inside[stops] = False
        buffer, kinds = np.zeros(n // 8 * 8 + 32, np.uint8), np.full(n, END, np.uint8)
        buffer[:n][inside], kinds[inside] = b, kind
        b, kind = buffer[:n], kinds
        s = starts_of(b, kind)
        e = np.append(s[1:], n)
        size = e - s
        words = buffer.view("<u8")
        k0 = eight_bytes(words, s) & _MASK[np.minimum(size, 8)]
        k1 = np.zeros(len(s), np.uint64)
        over = np.flatnonzero(size > 8)
        k1[over] = eight_bytes(words, s[over] + 8) & _MASK[np.minimum(size[over] - 8, 8)]
        if self.table.n > KEPT or self.table.used > 16 * KEPT:
            self.table = Table(self.kind, self.end_id)
        entry = self.table.find(k0, k1)
        raw = None
        long = over[size[over] > 16]
        if len(long):
            raw = b.tobytes()
            entry[long] = [self.table.long.get(raw[x:y], -1) for x, y in zip(s[long].tolist(), e[long].tolist())]
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            raw = raw or b.tobytes()
            entry[missing] = self._learn(raw, kind, s, e, k0, k1, missing)
        sizes, offs = self.table.sizes[entry], self.table.offs[entry]
        stop = np.cumsum(sizes, dtype=np.int64)
        ids = self.table.flat[np.arange(int(stop[-1])) + np.repeat(offs - (stop - sizes), sizes)]
        ends = stop[entry == 0]
        return ids, np.diff(np.concatenate([[0], ends]))

    def _learn(self, raw: bytes, kind: np.ndarray, s: np.ndarray, e: np.ndarray, k0: np.ndarray, k1: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Enters what is missing into the table, each distinct one once; returns the entries."""
        short = e[missing] - s[missing] <= 16
        own = missing[short]
        order = np.lexsort((k1[own], k0[own]))
        a, c = k0[own][order], k1[own][order]
        new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[: len(a)]
        number = np.empty(len(own), np.int64)
        number[order] = np.cumsum(new) - 1
        first = own[order][new].tolist()
        seen: dict[bytes, int] = {}
        out = np.empty(len(missing), np.int64)
        out[short] = number
        for x in np.flatnonzero(~short).tolist():
            key = raw[s[missing[x]] : e[missing[x]]]
            if key not in seen:
                seen[key] = len(first)
                first.append(int(missing[x]))
            out[x] = seen[key]
        at = np.array(first, np.int64)
        strings = [raw[x:y].decode("utf-8") for x, y in zip(s[at].tolist(), e[at].tolist())]
        flat, sizes = self.ids_of(strings, kind[e[at] - 1] == W)
        entries = self.table.add(k0[at], k1[at], np.arange(len(at)) < len(at) - len(seen), flat, sizes)
        self.table.long.update((key, int(entries[x])) for key, x in seen.items() if len(key) <= LONGEST)
        return entries[out]


_held: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int = 0) -> Encoder:
    """This worker's encoder: one is kept between tasks, so that what a task has learned serves the next."""
    if (path, end_id) not in _held:
        _held.clear()
        _held[path, end_id] = Encoder(path, end_id)
    return _held[path, end_id]


def crc32_of(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each slice as little-endian 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    at = (offs * 4).tolist()
    return np.fromiter((zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])), np.int64, len(at) - 1)
