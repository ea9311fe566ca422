"""Maximal periodic runs of words in every text, and texts with each run cut down to its first period.

A run is a stretch of consecutive words that repeats with a smallest period q (words q apart are identical), is at
least ``least`` words and ``times`` periods long, and that no neighbouring word extends. Runs are found with a suffix
automaton: from the longest state to the shortest, the ordered set of a state's end positions is merged into that of
its suffix link, the smaller set into the larger. Two end positions that become neighbours in a state, no further
apart than the state's length, end a square; it is extended to both sides until the period breaks. The neighbours of
a merge are final ones, so the distance is the smallest period there, and every run is met with it: its last word and
the one a period before meet in the state of all but one of its periods.

An automaton is only built where a run can be: every word of a run starts, or lies in, a stretch of words whose next
``gram`` words recur no further away than a run within that stretch has its period. That test compares hashes of
words, so equal words always pass it; the automaton compares the words themselves.

No shuffle: a task holds one Arrow batch, cut into chunks of whole texts, and the automaton of one stretch (about half a
kilobyte a word of it). Edge cases: null texts have no words, no runs and an empty collapsed text; texts of any length
are taken whole; repeated rows are rows of their own; an empty table gives none; other columns are kept, as they are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import BYTE, WORD, chunks, lean, ship, slice_hashes, utf8, words

LEAST, TIMES = 24, 3
#: Elements of an ordered set that lie together.
BLOCK = 512
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Positions:
    """An ordered set of end positions, in blocks of bounded size."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, x: int):
        self.blocks, self.firsts, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours of a new element."""
        firsts = self.firsts
        k = max(0, bisect_left(firsts, x) - 1)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else None
        after = block[i] if i < len(block) else self.firsts[k + 1] if k + 1 < len(firsts) else None
        block.insert(i, x)
        self.size += 1
        if i == 0:
            firsts[k] = x
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            firsts.insert(k + 1, block[half])
        return before, after


def automaton(seq: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state but the first: length, suffix link, and the position it was made for (-1: a clone)."""
    length, link, made = [0], [-1], [-1]
    step: list[dict[int, int]] = [{}]
    last = 0
    for at, c in enumerate(seq):
        new, p = len(length), last
        length.append(length[last] + 1)
        link.append(0)
        made.append(at)
        step.append({})
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                made.append(-1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, made


class Runs:
    """Squares extended to runs, each run once."""

    def __init__(self, seq: list[int]):
        self.seq, self.words = seq, np.array(seq)
        self.found: dict[int, list[tuple[int, int]]] = {}

    def _same(self, at: int, d: int, way: int) -> int:
        """How many words from this one on, in this direction, equal the one d to its left."""
        seq, n, got = self.seq, len(self.seq), 0
        while got < 32:
            k = at + way * got
            if k < d or k >= n or seq[k] != seq[k - d]:
                return got
            got += 1
        size = 64
        while True:
            lo, hi = (at + got, min(n, at + got + size)) if way > 0 else (max(d, at - got - size + 1), at - got + 1)
            if hi <= lo:
                return got
            same = self.words[lo:hi] == self.words[lo - d : hi - d]
            if way < 0:
                same = same[::-1]
            if not same.all():
                return got + int(same.argmin())
            got, size = got + hi - lo, min(2 * size, 1 << 16)

    def square(self, end: int, d: int) -> None:
        """The run of the square of period d that ends here."""
        known = self.found.setdefault(d, [])
        k = bisect_left(known, (end - 2 * d + 2,)) - 1  # two runs of one period share less than a period
        if k >= 0 and known[k][1] > end:
            return
        left = self._same(end, d, -1)
        insort(known, (end - left - d + 1, end + 1 + self._same(end + 1, d, 1)))


def runs_of(seq: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of each run, by start, then period."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    length, link, made = automaton(seq)
    # The state in which a run is met is as long as all but one of its periods.
    shortest = -(-least * (times - 1) // times)
    sets: dict[int, Positions] = {v: Positions(at) for v, at in enumerate(made) if at >= 0 and length[v] >= shortest}
    runs = Runs(seq)
    for v in sorted((v for v in range(1, len(length)) if length[v] >= shortest), key=length.__getitem__, reverse=True):
        own, up = sets.pop(v), link[v]
        most = length[up]
        if most < shortest:
            continue
        if up not in sets:
            sets[up] = own
            continue
        large = sets[up]
        small, large = (own, large) if own.size <= large.size else (large, own)
        x, after = None, None
        for y in small:
            if after is not None and after < y and after - x <= most:
                runs.square(after, after - x)
            x = y
            before, after = large.add(x)
            if before is not None and x - before <= most:
                runs.square(x, x - before)
        if after is not None and after - x <= most:
            runs.square(after, after - x)
        sets[up] = large
    return sorted((s, e - s, d) for d, known in runs.found.items() for s, e in known if e - s >= max(least, times * d))


def stretches(hashes: np.ndarray, first: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Ranges of words, none across texts, outside of which there is no run. first: each text's first word (n + 1)."""
    gram = min(8, least * (times - 2) // times + 1)
    n = len(hashes) - gram + 1
    if n < least - gram + 1:
        return []
    key = np.zeros(n, np.uint64)
    for k in range(gram):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    alive = text[:n] == text[gram - 1 :]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    gap = np.where(same, np.diff(order), n)
    near = np.full(n, n, np.int64)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    alive &= near < n
    new = np.append(True, text[1:n] != text[: n - 1])
    while True:
        begins = alive & (new | ~np.append(False, alive[:-1]))
        lo = np.flatnonzero(begins)
        places = np.flatnonzero(alive)
        number = np.cumsum(begins)[places] - 1
        size = np.bincount(number, minlength=len(lo)) + gram - 1
        keep = near[places] <= np.where(size >= least, size // times, 0)[number]
        if keep.all():
            return list(zip(lo.tolist(), (lo + size).tolist()))
        alive[places[~keep]] = False


def ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]))).tolist()
    return list(zip(edge[::2], edge[1::2]))


def collapse(b: np.ndarray, o: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, dropped: np.ndarray) -> pa.Array:
    """Texts of the words that stay, one space between two."""
    stay = np.flatnonzero(~dropped)
    text = np.searchsorted(first, stay, "right") - 1
    parted = np.append(text[1:] == text[:-1], False)[: len(stay)]
    mask = np.append(WORD[b], False)
    for lo, hi in ranges(dropped):
        mask[s[lo] : e[hi - 1]] = False
    gaps = e[stay[parted]]
    mask[gaps] = True
    out = np.append(b, np.uint8(0))
    out[gaps] = 32
    kept = np.concatenate([[0], np.cumsum(mask)])
    return pa.LargeStringArray.from_buffers(len(o) - 1, pa.py_buffer(kept[o].astype(np.int64)), pa.py_buffer(out[mask]))


def of_batch(texts: pa.Array, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[pa.Array]]:
    """Number of words, runs and collapsed texts."""
    b, o = utf8(texts)
    counts, found, cut = [], [], []
    for i, j in chunks(o):
        own, offs = b[o[i] : o[j]], o[i : j + 1] - o[i]
        s, e, first = words(own, offs)
        counts.append(np.diff(first))
        here: list[list[tuple[int, int, int]]] = [[] for _ in range(j - i)]
        dropped = np.zeros(len(s), bool)
        if len(s):
            raw = own.tobytes()
            for lo, hi in stretches(slice_hashes(own, s, e, BYTE), first, least, times):
                number: dict[bytes, int] = {}
                seq = [number.setdefault(raw[x:y], len(number)) for x, y in zip(s[lo:hi].tolist(), e[lo:hi].tolist())]
                text = int(np.searchsorted(first, lo, "right")) - 1
                for start, size, period in runs_of(seq, least, times):
                    here[text].append((lo + start - int(first[text]), size, period))
                    dropped[lo + start + period : lo + start + size] = True
        found += here
        cut.append(collapse(own, offs, s, e, first, dropped))
    return np.concatenate(counts) if counts else np.zeros(0, np.int64), found, cut


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """All columns, with n_words, runs (by start, then period) and collapsed, the text without what runs repeat."""
    spark = docs.sparkSession
    ship(spark)
    new = ("n_words", "runs", "collapsed")
    if taken := {c.lower() for c in docs.columns} & set(new):
        raise ValueError(f"columns {sorted(taken)} are what this adds")
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, found, cut = of_batch(batch.column(at), least, times)
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in sorted(x)] for x in found], kind)
                texts = pa.concat_arrays(cut).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), runs, texts], [*batch.schema.names, *new])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), "n_words bigint", f"runs {RUNS}", "collapsed string"])
    return docs.mapInArrow(lean(find), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of each tenth document (by the crc32 of its doc_id) the words from some place on repeat there."""
    word = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, word).alias("w"))
    d = d.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i >= a, a + (i - a) % p, i) as int)]), ' ')")
    return d.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """One row a document: the run with the greatest exponent, and digests of all runs and of the collapsed text."""
    # Exponents are compared as exact fractions: length1 / period1 > length2 / period2.
    better = "x.length * y.period > y.length * x.period or (x.length * y.period = y.length * x.period and (x.start < y.start or (x.start = y.start and x.period < y.period)))"
    best = F.expr(f"if(size(runs) > 0, aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (y, x) -> if({better}, x, y)), null)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    d = found.withColumn("best", best)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def run_digest_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return run_digest(periodic_runs(with_planted_runs(docs)))


def oracle(least: int = LEAST, times: int = TIMES, levels: int = 21) -> str:
    """DuckDB SQL for run_digest_of() over documents, by another way: equal stretches of 2^k words get equal ranks, from those
    of half the length; the next equal stretch of at least a period's length lies a period further in every run. Periods
    found so are tried at every word. Periods up to 2^(levels - 1) words."""
    bits = "list_reduce([xor(c, CAST(ascii(b) AS BIGINT))] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)"
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT)), lambda c, b: " + bits.replace("CAST(ascii(b) AS BIGINT)", "b") + "), 4294967295::BIGINT)"
    ranks = ["k0 AS MATERIALIZED (SELECT r, i, dense_rank() OVER (ORDER BY w) AS k FROM words)"]
    near = []
    for n in range(1, levels):
        half, size = 1 << (n - 1), 1 << n
        ranks.append(f"k{n} AS MATERIALIZED (SELECT a.r, a.i, dense_rank() OVER (ORDER BY a.k, b.k) AS k FROM k{n - 1} a JOIN k{n - 1} b ON b.r = a.r AND b.i = a.i + {half})")
        if size >= 8:
            near.append(f"SELECT r, lead(i) OVER (PARTITION BY r, k ORDER BY i) - i AS q FROM k{n} QUALIFY q BETWEEN {half + 1 if size > 8 else 1} AND {size}")
    return f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc} AS h FROM documents),
placed AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 AND len(w) > 0 THEN h // 10 END AS g FROM texts),
spread AS (SELECT r, w, n, unnest(range(n)) AS i, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM placed WHERE n > 0),
words AS MATERIALIZED (SELECT r, i, w[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END + 1] AS w FROM spread),
{', '.join(ranks)},
periods AS MATERIALIZED (SELECT DISTINCT r, q FROM ({' UNION ALL '.join(near)})),
same AS (SELECT c.r, c.q, x.i, x.i - row_number() OVER (PARTITION BY c.r, c.q ORDER BY x.i) AS island FROM periods c JOIN words x ON x.r = c.r JOIN words y ON y.r = c.r AND y.i = x.i - c.q AND y.w = x.w),
stretches AS (SELECT r, q, min(i) - q AS s, count(*) + q AS size FROM same GROUP BY r, q, island HAVING count(*) + q >= greatest({least}, {times} * q)),
runs AS MATERIALIZED (SELECT * FROM stretches a WHERE NOT EXISTS (SELECT 1 FROM stretches b WHERE b.r = a.r AND b.q < a.q AND b.s <= a.s AND b.s + b.size >= a.s + a.size)),
digests AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY size / CAST(q AS DOUBLE) DESC, s, q) = 1),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM words x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND x.i >= y.s + y.q AND x.i < y.s + y.size) GROUP BY r)
SELECT p.doc_id, coalesce(d.n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.size AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.size // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(d.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM placed p LEFT JOIN digests d USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept k USING (r)"""
