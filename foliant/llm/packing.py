"""Vector bin packing of tokenized examples into training sequences.

Every sequence is limited in three ways at once: tokens, segments, and tokens that bear loss. An example (its prompt,
which bears no loss, then its text and an end id, which do) is cut where it would pass a limit. Pieces of a whole
sequence stand alone; the others wait in a pool of bounded size, from which sequences are filled one by one with the
piece that has the largest dot product with what the sequence has left in the three dimensions (each as a share of
its limit). Gaps are then filled by cutting the pieces of the emptiest sequences, and what remains of those goes back
to the pool. The task's last incomplete sequence is cut into powers of two, which need no padding.

A task packs what it reads: there is no shuffle, no group to be skewed, and memory holds one batch and one pool. The
same split of the input packs the same way again. Edge cases: null and empty texts are the end id alone; repeated
rows are examples of their own; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import lean, ship
from foliant.llm.tokens import crc32_of, encoder_of


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


#: Pieces that are packed together.
POOL = 2048
PIECES = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    prompt: int
    doc_tokens: int

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.prompt))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:n], self.prompt, self.doc_tokens), Piece(self.doc, self.start + n, self.ids[n:], self.prompt, self.doc_tokens))


def room(p: Piece, tokens: int, loss: int) -> int:
    """How many of a piece's first tokens fit."""
    free = max(0, p.prompt - p.start)
    return max(0, min(len(p.ids), tokens, free + loss))


def cut_example(doc: int | None, ids: np.ndarray, prompt: int, lim: Limits) -> list[Piece]:
    rest, out = Piece(doc, 0, ids, prompt, len(ids)), []
    while len(rest.ids):
        first, rest = rest.cut(room(rest, lim.tokens, lim.loss))
        out.append(first)
    return out


def fill(pieces: list[Piece], lim: Limits) -> list[list[Piece]]:
    """Sequences by the dot-product heuristic."""
    size = np.array([(len(p.ids), 1, p.loss) for p in pieces], np.float64) / (lim.tokens, lim.segments, lim.loss)
    index = np.arange(len(pieces))
    out: list[list[Piece]] = []
    while len(index):
        left, chosen = np.ones(3), []
        alive = np.ones(len(index), bool)
        while True:
            fits = alive & (size <= left + 1e-9).all(1)
            score = np.where(fits, size @ left, -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                break
            chosen.append(int(index[k]))
            alive[k] = False
            left -= size[k]
        out.append([pieces[i] for i in chosen])
        index, size = index[alive], size[alive]
    return out


def close_gaps(bins: list[list[Piece]], lim: Limits) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill what sequences have left with pieces, cut to fit, of the emptiest ones; what those keep is left over."""
    bins = sorted(bins, key=lambda b: -sum(len(p.ids) for p in b))
    spare: list[Piece] = []
    i, j = 0, len(bins) - 1
    while i <= j:
        own = bins[i]
        tokens, loss = lim.tokens - sum(len(p.ids) for p in own), lim.loss - sum(p.loss for p in own)
        while tokens > 0 and len(own) < lim.segments:
            if not spare:
                if i >= j:
                    break
                spare, j = bins[j], j - 1
            if not (n := room(spare[-1], tokens, loss)):
                break
            first, rest = spare.pop().cut(n)
            own.append(first)
            tokens, loss = tokens - n, loss - first.loss
            if len(rest.ids):
                spare.append(rest)
        i += 1
    done = bins[: j + 1]
    if not spare and done and sum(len(p.ids) for p in done[-1]) < lim.tokens:
        spare = done.pop()
    return done, spare


def powers_of_two(pieces: list[Piece], lim: Limits) -> list[list[Piece]]:
    """The pieces in sequences of a power of two each; a limit other than on tokens may leave one that is not."""
    out = []
    while left := sum(len(p.ids) for p in pieces):
        size, own, got, loss = min(lim.tokens, 1 << (left.bit_length() - 1)), [], 0, 0
        while got < size and pieces and len(own) < lim.segments and (n := room(pieces[0], size - got, lim.loss - loss)):
            first, rest = pieces.pop(0).cut(n)
            own.append(first)
            got, loss = got + n, loss + first.loss
            if len(rest.ids):
                pieces.insert(0, rest)
        out.append(own)
    return out


def packer(tokenizer: str, lim: Limits, end_id: int, pool: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, waiting, number = None, [], TaskContext.get().partitionId() << 40

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            flat = [(p, number + k, at) for k, s in enumerate(sequences) for p, at in zip(s, np.cumsum([0, *(len(p.ids) for p in s)]).tolist())]
            number += len(sequences)
            ps = [p for p, _, _ in flat]
            offs = np.cumsum([0, *(len(p.ids) for p in ps)])
            crc = crc32_of(np.concatenate([p.ids for p in ps]), offs)
            i64 = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([i64([p.doc for p in ps]), i64([p.start for p in ps]), i64(np.diff(offs)), i64([p.loss for p in ps]), i64(crc), i64([p.doc_tokens for p in ps]), i64([n for _, n, _ in flat]), i64([at for _, _, at in flat])], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or encoder_of(tokenizer, end_id)
            ids, offs = encoder.encode(batch.column("text"))
            before = encoder.encode(batch.column("prompt")) if "prompt" in batch.schema.names else None
            done: list[list[Piece]] = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own, prompt = ids[offs[k] : offs[k + 1]], 0
                if before is not None:
                    head = before[0][before[1][k] : before[1][k + 1] - 1]
                    own, prompt = np.concatenate([head, own]), len(head)
                for p in cut_example(doc, own, prompt, lim):
                    if len(p.ids) == lim.tokens:
                        done.append([p])
                    else:
                        waiting.append(Piece(p.doc, p.start, p.ids.copy(), p.prompt, p.doc_tokens))
                if len(waiting) >= pool:
                    full, waiting = close_gaps(fill(waiting, lim), lim)
                    done += full
            if done:
                yield rows(done)
        if waiting:
            full, waiting = close_gaps(fill(waiting, lim), lim)
            yield rows(full + powers_of_two(waiting, lim))

    return pack


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, prompt: str | None = None, pool: int = POOL) -> DataFrame:
    """Pieces of every example with their sequence and the offset there; ``prompt`` names the column of prompts."""
    ship(docs.sparkSession)
    columns = ["doc_id", "text", *([F.col(prompt).alias("prompt")] if prompt else [])]
    return docs.select(*columns).mapInArrow(lean(packer(tokenizer, limits, end_id, pool)), PIECES)
