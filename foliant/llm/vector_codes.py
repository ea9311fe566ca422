"""Product-quantized codes of integer vectors, with codebooks by Lloyd's rounds in exact integers.

Components become floor(scale * x). Vectors are cut into equal parts; each part position has a codebook of its own,
which starts with that part of the vectors with the smallest ids. A round assigns every part to the nearest entry (ties
to the lower index) and moves each entry to its parts' mean, rounded down; then parts are assigned once more.

Rounds follow Hamerly: a part keeps an upper bound of its distance to its own entry and a lower bound of that to
the second nearest. When entries move, the upper bound grows by what its entry moved, the lower one shrinks by the most
that another moved. As long as the upper bound is strictly below the lower one, or below half the distance of its entry
to the next, the entry stays, and is the only nearest one. Else the upper bound is made exact; if that does not help,
the part is compared with all entries in integers. Bounds are floats rounded away from the truth.

A round reads the table of the last one and writes its own to the shared folder (vectors as integers, codes, bounds), with
no shuffle of vectors; a task sends one sum for each entry and component, in limbs that cannot overflow, and
only the codebooks come to the driver. Integers beyond what doubles hold exactly are handled as Python's integers.

Edge cases: vectors that are null, or hold null or non-finite components, take no part. Vectors whose length is no multiple of
the number of parts, or less than the longest, count as filled up with zeros. With fewer vectors than entries, codebooks
are as long as there are vectors. Repeated ids are rows of their own, taken by id, then vector; null ids come last. An
error beyond 64 bits is returned as the largest long. An empty table has no codes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import Scratch, lean, ship

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Sums travel in limbs of so many bits.
LIMB = 30
#: Relative error of a bound that more than covers the rounding of a square root and two sums, in 32-bit floats too.
SLACK = 1e-6
LARGEST = (1 << 63) - 1
HUGE = 1e300
STATE = "id long, label {label}, small array<long>, large array<double>, code binary, upper array<float>, lower array<float>, scans int"


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: as doubles where these are exact, else as Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 1 << 53:
        return y
    # A double times a whole number, exactly: n / d * scale.
    return np.array([n * scale // d for n, d in (float(v).as_integer_ratio() for v in x.ravel())], object).reshape(x.shape)


def exact(*arrays: np.ndarray) -> bool:
    """Whether squared distances between these rows are exact in doubles."""
    if any(a.dtype == object for a in arrays):
        return False
    most = max((np.abs(a).max() for a in arrays if a.size), default=0)
    return 4 * most * most * max(1, arrays[0].shape[1]) < 1 << 52


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exactly."""
    if exact(x, c):
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    x, c = whole(x), whole(c)
    return np.stack([((x - e) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), object) for e in c], 1)


def squared_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, one each."""
    if exact(x, c):
        return ((x - c) ** 2).sum(1)
    return ((whole(x) - whole(c)) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), object)


def whole(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def rooted(d: np.ndarray, up: bool) -> np.ndarray:
    """Square roots rounded up or down; what is too large for that is infinite, or HUGE."""
    if d.dtype == object:
        d = np.array([math.inf if v == math.inf or math.isqrt(int(v)) > HUGE else float(math.isqrt(int(v)) + up) for v in d.ravel()], np.float64).reshape(d.shape)
        d = d if up else np.where(np.isinf(d), HUGE, d)
        return d * (1 + SLACK if up else 1 - SLACK)
    return np.sqrt(d) * (1 + SLACK if up else 1 - SLACK)


@dataclass
class Codebooks:
    """Entries of each part, and how they moved."""

    entries: list[np.ndarray]  # of each part: entries by components; doubles, or Python's integers
    moved: list[np.ndarray]
    half: list[np.ndarray]

    @classmethod
    def of(cls, entries: list[list[list[int]]], before: Codebooks | None = None) -> Codebooks:
        own = [np.array(e, object).reshape(len(e), len(e[0]) if e else 0) for e in entries]
        own = [e.astype(np.float64) if not e.size or max(abs(v) for v in e.ravel()) < 1 << 53 else e for e in own]
        moved, half = [], []
        for p, e in enumerate(own):
            moved.append(np.zeros(len(e)) if before is None else rooted(squared_own(before.entries[p], e), True))
            apart = rooted(squared(e, e), False) / 2
            apart[np.arange(len(e)), np.arange(len(e))] = np.inf
            half.append(apart.min(1) * (1 - SLACK) if len(e) else np.zeros(0))
        return cls(own, moved, half)

    def integers(self) -> list[list[list[int]]]:
        return [[[int(v) for v in row] for row in e] for e in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.integers() for row in part for v in row).encode()).hexdigest()


def assign(x: np.ndarray, books: Codebooks, p: int, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper and lower bound of each row's part p, and which rows were compared with all entries."""
    c, n = books.entries[p], len(x)
    todo = np.ones(n, bool)
    if state is None:
        code, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    else:
        code, upper, lower = state[0].astype(np.int64), state[1].astype(np.float64), state[2].astype(np.float64)
        moved = books.moved[p]
        first = int(moved.argmax())
        second = np.delete(moved, first).max() if len(moved) > 1 else 0.0
        upper = (upper + moved[code]) * (1 + SLACK)
        lower = (lower - np.where(code == first, second, moved[first])) * (1 - SLACK)
        least = np.maximum(lower, books.half[p][code])
        todo = ~(upper < least)
        some = np.flatnonzero(todo)
        if len(some):
            upper[some] = rooted(squared_own(x[some], c[code[some]]), True)
            todo[some] = ~(upper[some] < least[some])
    some = np.flatnonzero(todo)
    if len(some):
        d = squared(x[some], c)
        best = d.argmin(1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
        at = np.arange(len(some))
        code[some], upper[some] = best, rooted(d[at, best], True)
        d[at, best] = math.inf
        lower[some] = rooted(d.min(1), False)
    return code, upper, lower, todo


def component_sums(x: np.ndarray, code: np.ndarray, sums: dict[tuple[int, int], int], p: int, cells: np.ndarray) -> None:
    """Adds part p of all rows to the task's sums: cells in 64-bit integers, and ``sums`` where these may not do."""
    if x.dtype != object and (not x.size or np.abs(x).max() < 1 << 24):
        np.add.at(cells[p], code, np.concatenate([x.astype(np.int64), np.ones((len(x), 1), np.int64)], 1))
        return
    wide = x.shape[1] + 1
    for row, e in zip(whole(x).tolist(), code.tolist()):
        for k, v in enumerate([*row, 1]):
            if v:
                key = ((p * cells.shape[1] + e) * wide + k, 0)
                sums[key] = sums.get(key, 0) + v


def limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if low := value & ((1 << LIMB) - 1):
            yield k, sign * low
        value, k = value >> LIMB, k + 1


class Table:
    """The rows of a batch, as integers of one width."""

    def __init__(self, batch: pa.RecordBatch, wide: int):
        self.n = batch.num_rows
        self.big = batch.column("large").is_valid().to_numpy(zero_copy_only=False)
        self.x = padded(batch.column("small"), np.float64, wide)
        self.vectors = batch.column("large")
        self.wide = wide

    def rows(self, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows and their integers: those that doubles hold, then the others."""
        fine = np.flatnonzero(~self.big)
        if len(fine):
            yield fine, self.x[fine]
        rest = np.flatnonzero(self.big)
        if len(rest):
            yield rest, whole(integers(padded(self.vectors.take(pa.array(rest)), np.float64, self.wide), scale))


def padded(lists: pa.Array, kind: type, wide: int) -> np.ndarray:
    """Lists as rows of one width, filled up with zeros; null lists are zeros."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (size == wide).all():
        return values.reshape(len(lists), wide)
    out = np.zeros((len(lists), wide), kind)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def entering(wide: int, scale: int) -> Callable:
    """Rows as integers: ``small`` where doubles hold these exactly, else ``large``, the vector itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = padded(b.column("vector"), np.float64, wide)
            with np.errstate(over="ignore"):
                y = np.floor(x * scale)
            big = (np.abs(y) >= 1 << 53).any(1)
            at = np.arange(0, (b.num_rows + 1) * wide, wide) if wide else np.zeros(b.num_rows + 1, np.int64)

            def lists(values: np.ndarray, kind: pa.DataType, null: np.ndarray) -> pa.Array:
                own = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.ravel(), kind))
                return pc.if_else(pa.array(null), pa.scalar(None, own.type), own)

            small = lists(np.where(big[:, None], 0, y).astype(np.int64), pa.int64(), big)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), small, lists(x, pa.float64(), ~big)], ["id", "label", "small", "large"])

    return run


def assigning(books: Codebooks, parts: int, wide: int, scale: int, final: bool) -> Callable:
    """A round's assignment; the last one returns codes and errors."""
    step = wide // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not (n := b.num_rows):
                continue
            t, known = Table(b, wide), "code" in b.schema.names
            code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
            scans, error = np.zeros(n, np.int64), np.zeros(n, object)
            if known:
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                upper, lower = (padded(b.column(k), np.float64, parts) for k in ("upper", "lower"))
                scans = b.column("scans").to_numpy().astype(np.int64)
            for at, x in t.rows(scale):
                for p in range(parts):
                    own = x[:, p * step : (p + 1) * step]
                    code[at, p], upper[at, p], lower[at, p], all_ = assign(own, books, p, (code[at, p], upper[at, p], lower[at, p]) if known else None)
                    scans[at] += all_
                    if final:
                        d = squared_own(own, books.entries[p][code[at, p]])
                        error[at] += np.array([int(v) for v in d], object)
            scans_ = pa.array(scans, pa.int32())
            if final:
                texts = [bytes(row.astype(np.uint8)).hex() for row in code]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(texts), pa.array([min(v, LARGEST) for v in error], pa.int64()), scans_], ["id", "label", "code", "error", "scans"])
                continue
            raw = [row.tobytes() for row in code.astype(np.uint8)]
            stop = pa.array(np.arange(0, (n + 1) * parts, parts), pa.int32())
            with np.errstate(over="ignore"):
                up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
                low = np.nextafter(np.minimum(lower, 1e38).astype(np.float32), np.float32(-np.inf))
            bounds = [pa.ListArray.from_arrays(stop, pa.array(v.ravel(), pa.float32())) for v in (up, low)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("id", "label", "small", "large")), pa.array(raw, pa.binary()), *bounds, scans_], ["id", "label", "small", "large", "code", "upper", "lower", "scans"])

    return run


def summing(parts: int, entries: int, wide: int, scale: int) -> Callable:
    """A task's sums of components by part and entry, and their numbers, as cells in limbs."""
    step = wide // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, large, rows = np.zeros((parts, entries, step + 1), np.int64), {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            rows += b.num_rows
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            for at, x in Table(b, wide).rows(scale):
                for p in range(parts):
                    component_sums(x[:, p * step : (p + 1) * step], code[at, p], large, p, cells)
        flat = cells.ravel()
        out = [(int(c), k, v) for c in np.flatnonzero(flat).tolist() for k, v in limbs(int(flat[c]))] + [(c, k, v) for (c, _), value in large.items() for k, v in limbs(value)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["cell", "limb", "total"])

    return run


def means(sums: DataFrame, books: Codebooks) -> list[list[list[int]]]:
    """Entries moved to the mean of their parts, rounded down; unused ones stay."""
    out = books.integers()
    values: dict[int, int] = {}
    for cell, limb, total in sums.groupBy("cell", "limb").agg(F.sum("total").alias("total")).collect():
        values[cell] = values.get(cell, 0) + (total << (LIMB * limb))
    entries, wide = len(out[0]), len(out[0][0]) + 1
    for p, part in enumerate(out):
        for e, row in enumerate(part):
            base = (p * entries + e) * wide
            if count := values.get(base + wide - 1, 0):
                row[:] = [values.get(base + k, 0) // count for k in range(wide - 1)]
    return out


def vector_codes(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks, Callable[[], None]]:
    """id, label, code, error and scans (comparisons with all entries) of every row, the codebooks, and what drops the
    tables behind the rows once they are read."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    step = -(-longest // parts)
    first = [r[0] for r in rows.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect()]
    start = [whole(integers(np.array([[*v, *[0.0] * (step * parts - len(v))]], np.float64), scale))[0].tolist() for v in first]
    books = Codebooks.of([[v[p * step : (p + 1) * step] for v in start] for p in range(parts)])
    kind = rows.schema["label"].dataType.simpleString()
    scratch = Scratch(spark)
    before, table = None, rows.mapInArrow(lean(entering(step * parts, scale)), f"id long, label {kind}, small array<long>, large array<double>")
    for k in range(rounds if first else 0):
        part = scratch.inner()
        table = part(table.mapInArrow(lean(assigning(books, parts, step * parts, scale, False)), STATE.format(label=kind)), f"codes-{k}")
        if before is not None:
            before.drop()
        before = part
        books = Codebooks.of(means(table.mapInArrow(lean(summing(parts, len(first), step * parts, scale)), "cell long, limb long, total long"), books), books)
    final = f"id long, label {kind}, code string, error long, scans int"
    if not first:
        return spark.createDataFrame([], final), books, scratch.drop
    out = scratch(table.mapInArrow(lean(assigning(books, parts, step * parts, scale, True)), final), "codes")
    before.drop() if before is not None else None
    return out, books, scratch.drop


def code_digest(vectors: DataFrame) -> DataFrame:
    """Codes with errors, errors summed over equal labels, and a digest of the codebooks."""
    codes, books, _ = vector_codes(vectors)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    both = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, every part compared with every entry."""
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, vec_id, label, p, x, min({{'d': {square}, 'e': e}}) AS b FROM parts JOIN c{k} USING (p) GROUP BY ALL)")
        if k < rounds:
            total = "sum(x[i])::BIGINT"
            mean = f"({total} - (({total} % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(f"m{k} AS (SELECT p, b.e AS e, i, {mean} AS v FROM a{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(list(v ORDER BY i) FILTER (v IS NOT NULL), any_value(c)) AS c FROM c{k} LEFT JOIN m{k} USING (p, e) GROUP BY p, e)")
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, unnest(range({parts})) AS t(p)),
c0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM parts WHERE r < {entries}),
{''', '''.join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM c{rounds}),
coded AS (SELECT r, vec_id, label, string_agg(lpad(lower(to_hex(b.e)), 2, '0'), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded, books"""
