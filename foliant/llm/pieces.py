"""Ids of sentencepiece BPE models, by backtracking over longest matches, and their decoding.

A model's file gives pieces with scores. The library merges, again and again, the two neighbours whose union is the
piece with the highest score (the leftmost of equal ones), starting from single characters. A sequence of pieces is the
outcome of these merges exactly if each two neighbours are the outcome for their own two texts: until a merge crosses
the border of two pieces, both sides evolve as they do alone, in the order of their scores, whatever stands around them.
So a text is encoded from left to right: an Aho-Corasick automaton names the pieces that start at each place; the longest
is taken whose union with the piece before it, merged anew, falls apart into just these two, and if none is left the
last piece is taken back, its end marked in a bitfield of places that no encoding passes, and the next shorter one
tried. As a place is marked once, the work is linear in the text.

Where no piece has the space sign after another character, no merge crosses the start of a run of spaces, and none a
border of two characters that stand together in no piece. Texts are cut there, and each distinct unit (mostly a word with
the space before it) is encoded once and kept in a table of bounded size.
Characters without a piece become byte pieces (or the unknown piece, if the model has none).

No shuffle; a task holds one Arrow batch, and of a text without spaces two bytes a piece besides. Edge cases: null and
empty texts have no ids and decode to an empty text; texts of any length are taken whole; space signs in a text count as
spaces, as the library has it, and decode to them; repeated rows are rows of their own; an empty table gives none; other
columns are kept, as they are.
"""

from __future__ import annotations

import codecs
import math
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import lean, ship

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units of a generation and pairs that are kept; beyond it the tables start anew, which costs time and changes no id.
KEPT = 400_000
#: Longer units are encoded anew each time.
LONGEST = 64
#: With more pairs of a word character and another in pieces, texts are not cut between these.
GLUED = 40
#: Characters of a unit whose matches are held together.
WINDOW = 4096
# A byte that is no part of a character becomes a character of its own.
codecs.register_error("one-by-one", lambda e: ("\ufffd", e.start + 1))


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer."""

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            x |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return x

    at = 0
    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + size]
            at += size


class Model:
    """What a model's file says. Fixed values (numbers of fields): the published protocol of these files."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    own = dict(fields(value))
                    self.pieces.append(own.get(1, b"").decode("utf-8"))
                    self.scores.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
                    self.kinds.append(own.get(3, NORMAL))
                elif number == 2:
                    trainer = dict(fields(value))
                elif number == 3:
                    rules = dict(fields(value))
        self.prefix = bool(rules.get(3, 1))
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        self.fallback = bool(trainer.get(35, 0))
        plain = not rules.get(2) and not rules.get(6) and not rules.get(4, 1) and rules.get(5, 1) and not trainer.get(24, 0)
        if trainer.get(3, 1) != 2 or not plain or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models are known here that neither change characters nor drop white space, without pieces of a user's own")


class Units(dict):
    """Ids of units as bytes of 32-bit integers, made when they are first asked for. Two generations are kept: what is
    not asked for while a new one fills up goes with the old one."""

    def __init__(self, encode: Callable[[str], array]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, unit: str) -> bytes:
        got = self.older.get(unit) or self.encode(unit).tobytes()
        if len(unit) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[unit] = got
        return got


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, path: str):
        self.model = m = Model(path)
        self.ids = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] == NORMAL}
        self.unknown = m.kinds.index(UNKNOWN)
        self.id_of_byte = {int(p[1:-1], 16): i for i, p in enumerate(m.pieces) if m.kinds[i] == BYTE}
        self.byte_of_id = {i: b for b, i in self.id_of_byte.items()}
        self.widest = max(map(len, self.ids), default=1)
        self.unit_pattern = self.units_between(p for p in self.ids if len(p) > 1)
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        self.units = Units(self.encode_unit)
        self.fits: dict[tuple[str, str], bool] = {}
        # Of each id the bytes it decodes to; what says more than that (unknown, control) is left to decode().
        surfaces = [bytes([self.byte_of_id[i]]) if i in self.byte_of_id else p.replace(SPACE, " ").encode() if m.kinds[i] == NORMAL else b"" for i, p in enumerate(m.pieces)]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.sizes = np.array([len(x) for x in surfaces], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.plain = np.array([k in (NORMAL, BYTE) for k in m.kinds])
        self.spaced = np.array([m.kinds[i] == NORMAL and p.startswith(SPACE) for i, p in enumerate(m.pieces)])

    def units_between(self, pieces: Iterable[str]) -> re.Pattern | None:
        """What texts can be cut into, as no piece reaches over the cuts: before runs of space signs, around characters
        that no longer piece has, and between a word character and another. None if pieces do reach over these."""
        pairs, joined = set(), set()
        for p in pieces:
            pairs.update(zip(p, p[1:]))
            joined.update(p)
        joined.discard(SPACE)
        words, others = ("".join(map(re.escape, sorted(c for c in joined if c.isalnum() == w))) for w in (True, False))
        if not words or not others or any(b == SPACE != a for a, b in pairs) or not self.model.fallback:
            return None
        # The few pairs of a word character and another that a piece has hold their unit together.
        glued = sorted((a, b) for a, b in pairs if a.isalnum() and not b.isalnum())
        if len(glued) > GLUED:
            return re.compile(f"{SPACE}+[{words}{others}]*|[{words}{others}]+|[^{SPACE}]", re.DOTALL)
        more = f"(?:(?:{'|'.join(f'(?<={re.escape(a)}){re.escape(b)}' for a, b in glued)})[{others}]*[{words}]*)*" if glued else ""
        return re.compile(f"{SPACE}+[{others}]*[{words}]*{more}|[{others}]+[{words}]*{more}|[{words}]+{more}|[^{SPACE}]", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for the short texts of two neighbours."""
        parts, scores, ids = list(text), self.model.scores, self.ids
        while True:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (scores[i] > best or at < 0):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, before: str, this: str) -> bool:
        """Whether two neighbours are what their two texts become; before: empty at the start."""
        got = self.fits.get((before, this))
        if got is None:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            got = self.fits[before, this] = self.merged(before + this) == ([before, this] if before else [this])
        return got

    def starting(self, text: str) -> Callable[[int], list[str]]:
        """Of a place: the pieces that start there, the character itself first, then longer ones."""
        held: dict[int, list[list[str]]] = {}

        def window(k: int) -> list[list[str]]:
            lo = k * WINDOW
            own = [[c] for c in text[lo : lo + WINDOW]]
            n = len(own)
            for end, piece in self.matcher.iter(text[lo : lo + WINDOW + self.widest - 1]):
                if (at := end + 1 - len(piece)) < n:
                    own[at].append(piece)
            return own

        def at(place: int) -> list[str]:
            k = place // WINDOW
            if k not in held:
                if len(held) > 3:
                    held.clear()
                held[k] = window(k)
            return held[k][place % WINDOW]

        return window(0).__getitem__ if len(text) <= WINDOW else at

    def encode_unit(self, unit: str) -> array:
        """Ids of a text in which spaces are space signs."""
        n, at, most, before, starting, fits = len(unit), 0, self.widest, "", self.starting(unit), self.fits
        failed = bytearray(n // 8 + 1)
        stack: list[str] = []
        while at < n:
            for this in reversed(starting(at)):
                size = len(this)
                end = at + size
                if size <= most and not failed[end >> 3] >> (end & 7) & 1:
                    fit = fits.get((before, this))
                    if fit or fit is None and self.compatible(before, this):
                        stack.append(this)
                        at, most, before = end, self.widest, this
                        break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                size = len(stack.pop())
                at, most, before = at - size, size - 1, stack[-1] if stack else ""
        out, get = array("i"), self.ids.get
        for this in stack:
            i = get(this)
            if i is not None:
                out.append(i)
            elif self.model.fallback:
                out.extend(self.id_of_byte[b] for b in this.encode("utf-8"))
            elif not out or out[-1] != self.unknown:  # neighbours that are unknown are one
                out.append(self.unknown)
        return out

    def units_of(self, text: str) -> list[str]:
        """The units of a text, with the sign before its start; none of an empty text."""
        if not text:
            return []
        text = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        return self.unit_pattern.findall(text) if self.unit_pattern else [text]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as bytes of 32-bit integers."""
        known = self.units
        return b"".join([known[u] for u in self.units_of(text or "")])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: a first space sign goes, byte pieces become characters, and bytes that are none U+FFFD."""
        m, out, held, bos, seen, some = self.model, [], bytearray(), True, False, False

        def flush() -> None:
            nonlocal some
            if held:
                out.append(held.decode("utf-8", "one-by-one"))
                held.clear()
                some = True

        for i in ids:
            kind = m.kinds[i]
            if kind == BYTE:
                held.append(self.byte_of_id[i])
                continue
            flush()
            bos, seen = bos and not (seen or some), False
            if kind == UNKNOWN:
                out.append(m.unknown_surface)
            elif kind == NORMAL:
                piece = m.pieces[i]
                seen = bos and m.prefix and piece.startswith(SPACE)
                out.append(piece[seen:].replace(SPACE, " "))
            some = some or kind != CONTROL and bool(out[-1])
        flush()
        return "".join(out)

    def decode_all(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """The texts of slices of ids."""
        n = len(offs) - 1
        size = self.sizes[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        raw = self.surface[np.arange(int(stop[-1])) + np.repeat(self.at[ids] - stop[:-1], size)]
        if self.model.prefix:
            first = offs[:-1][offs[1:] > offs[:-1]]
            first = first[self.spaced[ids[first]]]
            keep = np.ones(len(raw), bool)
            keep[stop[first]] = False
            raw = raw[keep]
            stop = stop - np.searchsorted(stop[first], stop, "left")
        at = stop[offs]
        odd = np.unique(np.searchsorted(offs, np.flatnonzero(~self.plain[ids]), "right") - 1).tolist()
        try:
            raw.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            odd = range(n)
        texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw))
        if not len(odd):
            return texts
        own = {k: self.decode(ids[offs[k] : offs[k + 1]].tolist()) for k in odd}
        return pa.array([own[k] if k in own else texts[k].as_py() for k in range(n)], pa.large_string())


_held: dict[str, PieceCodec] = {}


def codec_of(path: str) -> PieceCodec:
    """This worker's codec: one is kept between tasks, so that what a task has learned serves the next."""
    if path not in _held:
        _held.clear()
        _held[path] = PieceCodec(path)
    return _held[path]


def flat_ids(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and n + 1 offsets, of an array of lists; nulls are empty."""
    o = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64), o


def _mapped(docs: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], new: dict[str, str]) -> DataFrame:
    ship(docs.sparkSession)
    if taken := {c.lower() for c in docs.columns} & set(new):
        raise ValueError(f"columns {sorted(taken)} are what this adds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch)], [*batch.schema.names, *new])

    schema = [*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{k} {v}" for k, v in new.items())]
    return docs.mapInArrow(lean(run), ", ".join(schema))


def encode_texts(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """All columns, with ``ids`` of ``text`` and, if asked for, ``decoded``, the text that these ids stand for."""
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = codec_of(path)
        got = [codec.encode(t) for t in batch.column(at).to_pylist()]
        offs = np.cumsum([0, *(len(x) // 4 for x in got)])
        ids = np.frombuffer(b"".join(got), np.int32)
        out = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))]
        return [*out, codec.decode_all(ids, offs).cast(pa.string())] if decoded else out

    return _mapped(docs, work, {"ids": "array<int>"} | ({"decoded": "string"} if decoded else {}))


def decode_ids(docs: DataFrame, path: str) -> DataFrame:
    """All columns, with ``decoded``, the text of ``ids``; an id that the model does not have is an error."""
    at = docs.columns.index("ids")
    return _mapped(docs, lambda batch: [codec_of(path).decode_all(*flat_ids(batch.column(at))).cast(pa.string())], {"decoded": "string"})


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of the text that they decode to."""
    d = encode_texts(docs.select("doc_id", "text"), path, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
