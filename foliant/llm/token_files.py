"""Token-ID files: concatenated ids with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id; each task streams its documents through the tokenizer into one file:

    ids, little-endian, 2 bytes each where the vocabulary allows, else 4
    Elias-Fano sequence of the n + 1 document boundaries in the ids
    Elias-Fano sequence of the doc_ids, less the first; null doc_ids come first and are counted apart
    footer (JSON), its length (4 bytes), the magic ``FOLTOK01``

An Elias-Fano sequence of m values below u takes about m * (2 + log2(u / m)) bits: packed low bits, and a bitmap with
a one at (value >> low) + i for value i. Every 256th one's place is kept (``select`` starts there), so any boundary is
found without a table of 64-bit offsets. A document's global start is the file's start plus its boundary.

Edge cases: null and empty texts hold the end id alone; repeated rows are documents of their own; documents with the
same doc_id follow each other by a hash of their text, then by text, so a repeated task writes the same order, and a
doc_id that many rows share is dealt to several files; an empty table makes no document. Other columns are ignored. An
attempt writes a file of its own name, and the manifest names the files of the attempts that counted, so a task may run
twice, and what a lost attempt leaves is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.shared import lean, new_dir, ship, written
from foliant.llm.tokens import crc32_of, encoder_of

MAGIC = b"FOLTOK01"
SAMPLE = 256
#: Ids that a reader decodes at once, if no document is longer.
READ_IDS = 1 << 20
MANIFEST = "shard long, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of integers from 0 in near-minimal space."""

    def __init__(self, m: int, low: int, lows: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.m, self.low, self.lows, self.high, self.samples = m, low, lows, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        m, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (top // m).bit_length() - 1) if m else 0
        shifts = np.arange(low, dtype=np.uint64)
        step = max(1, (1 << 22) // max(low, 1)) // 8 * 8 or 8  # whole bytes at a time
        parts = [np.packbits(((v[i : i + step, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little") for i in range(0, m, step)] if low else []
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(m)
        bits = np.zeros((int(ones[-1]) + 1 if m else 0), np.uint8)
        bits[ones] = 1
        return cls(m, low, np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4" if not m or ones[-1] < 1 << 32 else "<u8"))

    def between(self, i: int, j: int) -> np.ndarray:
        """Values i up to j, from the sample before i up to the one after j."""
        if i >= j:
            return np.zeros(0, np.int64)
        k, after = i // SAMPLE, -(-j // SAMPLE)
        first = int(self.samples[k]) // 8
        last = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + first * 8
        at = int(np.searchsorted(ones, int(self.samples[k]))) + i - k * SAMPLE
        out = (ones[at : at + j - i] - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            a, z = i * self.low // 8, -(-j * self.low // 8)
            bits = np.unpackbits(self.lows[a:z], bitorder="little")[i * self.low - a * 8 :][: (j - i) * self.low].reshape(j - i, self.low)
            for n in range(self.low):
                out |= bits[:, n].astype(np.uint64) << np.uint64(n)
        return out.astype(np.int64)

    def all(self) -> np.ndarray:
        return self.between(0, self.m)

    def select(self, i: int) -> int:
        """Value i by itself: from the sample before it, over at most SAMPLE ones."""
        if not 0 <= i < self.m:
            raise IndexError(i)
        at, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= need:
            need, byte = need - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(need):
            word &= word - 1
        value = (byte * 8 + (word & -word).bit_length() - 1 - i) << self.low
        for k in range(self.low):
            bit = i * self.low + k
            value |= (int(self.lows[bit // 8]) >> (bit % 8) & 1) << k
        return value

    def parts(self) -> tuple[dict, list[bytes]]:
        blobs = [self.lows.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return {"m": self.m, "low": self.low, "bytes": [len(x) for x in blobs], "sample": self.samples.dtype.str}, blobs

    @classmethod
    def read(cls, about: dict, raw: bytes) -> EliasFano:
        a, b, c = np.cumsum(about["bytes"]).tolist()
        return cls(about["m"], about["low"], np.frombuffer(raw[:a], np.uint8), np.frombuffer(raw[a:b], np.uint8), np.frombuffer(raw[b:c], about["sample"]))


def writer(folder: str, tokenizer: str, end_id: int):
    """Writes the task's documents into one file and yields its manifest row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, bounds, ids_of, total, nulls = None, None, [np.zeros(1, np.int64)], [], 0, 0
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        store, at = fs.FileSystem.from_uri(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = encoder_of(tokenizer, end_id)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(at)
            ids, offs = encoder.encode(batch.column("text"))
            out.write(np.ascontiguousarray(ids).data)
            bounds.append(total + offs[1:])
            total += len(ids)
            nulls += batch.column("doc_id").null_count
            ids_of.append(batch.column("doc_id").drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        if encoder is None:
            return
        own_ids = np.concatenate(ids_of)
        first = int(own_ids[0]) if len(own_ids) else 0
        about = {"width": np.dtype(encoder.kind).itemsize, "n_ids": total, "nulls": nulls, "first": first, "end_id": end_id}
        for name, values in (("bounds", np.concatenate(bounds)), ("docs", own_ids.view(np.uint64) - np.uint64(first & (1 << 64) - 1))):
            about[name], blobs = EliasFano.of(values).parts()
            for x in blobs:
                out.write(x)
        foot = json.dumps(about).encode()
        out.write(foot + len(foot).to_bytes(4, "little") + MAGIC)
        out.close()
        n = about["bounds"]["m"] - 1
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n], "n_ids": [total]})

    return write


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        length = int.from_bytes(tail[:4], "little")
        self.about = json.loads(self.file.read_at(length, size - 12 - length))
        self.width = self.about["width"]
        pos = self.about["n_ids"] * self.width
        for name in ("bounds", "docs"):
            n = sum(self.about[name]["bytes"])
            setattr(self, name, EliasFano.read(self.about[name], self.file.read_at(n, pos)))
            pos += n

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.width, start * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's document i, its end id included."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def doc_ids(self, i: int, j: int) -> pa.Array:
        """The doc_ids of documents i up to j; nulls come first."""
        nulls = self.about["nulls"]
        known = self.docs.between(max(i - nulls, 0), max(j - nulls, 0)).astype(np.uint64) + np.uint64(self.about["first"] & (1 << 64) - 1)
        return pa.concat_arrays([pa.nulls(max(0, min(j, nulls) - i), pa.int64()), pa.array(known.view(np.int64))])

    def batches(self, most: int) -> Iterator[tuple[int, int]]:
        """Ranges of documents with at most that many ids, or of one document; their ends are found by select."""
        i, n = 0, self.bounds.m - 1
        while i < n:
            limit, low, high = self.bounds.select(i) + most, i + 1, n
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self.bounds.select(mid) <= limit else (low, mid - 1)
            yield i, low
            i = low


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            f = TokenFile(path)
            for i, j in f.batches(READ_IDS):
                o = f.bounds.between(i, j + 1)
                crc = crc32_of(f.ids(int(o[0]), int(o[-1])), o - o[0])
                yield pa.RecordBatch.from_arrays([f.doc_ids(i, j), pa.array(base + o[:-1]), pa.array(np.diff(o)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode every whole text into files under folder, in ascending doc_id; returns a manifest with each file's start."""
    ship(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("th").asc_nulls_first()]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select("doc_id", "text")
    manifest = written(ordered.mapInArrow(lean(writer(folder, tokenizer, end_id)), MANIFEST), "manifest")
    # One row a file: what meets in one task here grows with the files, not with the documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start over all files, n_tokens and the crc32 of its ids, from the files alone."""
    ship(manifest.sparkSession)
    files = manifest.select("shard", "path", "base")
    return files.repartition(max(1, manifest.count()), "shard").mapInArrow(lean(read_files), ROWS)


def token_file_digest(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer, new_dir(spark, "tokens"), end_id))
