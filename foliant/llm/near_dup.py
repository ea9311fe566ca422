"""Near-duplicate documents by Chosen-Path set similarity join.

1. Every document becomes a set of hashed word shingles, of which only a fingerprint, a size and a sketch of minwise
   tokens are kept. Documents with equal sets are one class with one representative, however many they are.
2. Independent trees branch the representatives: at each level a tree chooses one of the minwise tokens, and those
   that agree on it stay together. Nodes of at most ``SMALL`` members are compared exhaustively on their sketches;
   larger ones are compared with a pivot and branched again by the next token. A pair at the threshold t agrees on one
   chosen token with probability t, so ``TREES`` trees miss it with (1 - t ** depth) ** TREES.
3. Only the strongest links of a node that span it (a maximum spanning forest), and each member's best pivot, become
   candidates, so a group of copies gives candidates in proportion to its members and not all pairs. They are
   confirmed on the full sets, and components found.
4. Nodes that still hold several components are compared again, now exhaustively between different components:
   members with a possible partner bring their full sets along, are compared on those, and only links that join
   components leave the node.
5. Members of nodes that are still large at the last level, or whose sets are too many bytes for one task, are branched
   once more, by tokens of their full sets: each goes to one node for every one of its rarest tokens, as many as a
   partner must share at least one of. Of two partners the smaller needs fewer, so documents that only have a common
   passage meet nowhere. What meets there in different components is compared by bitmaps of the full sets, which bound
   how many tokens two sets do not share, and what is left confirmed on the full sets; this step is exact.
   So a link is only left untested if its two ends are known to be in one component already, or if no tree brought
   them together.

Edge cases: null texts and texts without words have an empty set and link with nothing; fewer words than a shingle are
one shingle; repeated rows are one class; a null doc_id never is the smallest of a class unless all are null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import FOLDED, Scratch, chunks, lean, mix, ship, slice_hashes, unused, utf8, words, written

SKETCH = 64
TREES = 16
#: Levels that all large nodes are branched to by minwise tokens, and the most that LEVELS may be.
LEVELS, DEEPEST = 3, 8
SMALL = 128
#: Shingles that the members of a node may have together to be compared in one task.
HEAVY = 1 << 22
#: Counts of tokens by a hash tell rare from frequent ones: a table of fixed size, which orders tokens and decides no link.
COUNTS = 1 << 20
#: Members that index a token in one block; more of them make more blocks.
BLOCK = 2048
#: Bits of a set's bitmap.
BITS = 1024
#: Sketches that agree on fewer of their tokens are no candidates: at a similarity of 0.75 that is 4.6 deviations off.
AGREE = 32
#: Rows of ids (32 bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
_rng = np.random.default_rng(577215)
_MULT = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_FLIP = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)
_SPREAD = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_TREE = _rng.integers(0, 1 << 63, (TREES, DEEPEST), dtype=np.uint64)
#: Which token each tree chooses at each level: no two trees share one in the first four levels.
CHOSEN = np.array([[(4 * t + v) % SKETCH if v < 4 else (4 * t + 17 * v + 1) % SKETCH for v in range(DEEPEST)] for t in range(TREES)])


def shingles(b: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and n + 1 offsets."""
    n = len(o) - 1
    s, e, first = words(b, o)
    w = slice_hashes(b, s, e, FOLDED)
    m = np.diff(first)
    count = np.where(m >= k, m - k + 1, (m > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    h = np.minimum(m, k)[doc].astype(np.uint64) * _MULT[7]
    short = bool((m < k).any())
    for j in range(k):
        x = at + j
        if short:
            inside = x < first[doc + 1]
            h += np.where(inside, mix(w[np.minimum(x, len(w) - 1)] * _MULT[j % 7] + np.uint64(j)), np.uint64(0)) if len(w) else np.uint64(0)
        else:
            h += mix(w[x] * _MULT[j % 7] + np.uint64(j))
    h = mix(h)
    offs = np.concatenate([[0], np.cumsum(count)])
    for x, y in zip(offs[:-1].tolist(), offs[1:].tolist()):
        h[x:y].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    starts = offs[:-1][count > 0]
    new[starts] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[offs]


def _binary(x: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix as fixed pieces of bytes."""
    width = x.itemsize * x.shape[1]
    offs = pa.py_buffer(np.arange(0, width * (len(x) + 1), width, dtype=np.int32))
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(x), [mask, offs, pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(x: pa.Array, kind: str) -> np.ndarray:
    """The way back."""
    if not len(x):
        return np.zeros((0, SKETCH), kind)
    _, offs, data = x.buffers()
    o = np.frombuffer(offs, np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(kind).reshape(len(x), -1)


def prints(h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprint of each set, and which are not empty."""
    full = np.diff(o) > 0
    out = np.zeros((len(full), 2), np.uint64)
    if full.any():
        at = o[:-1][full]
        for c in range(2):
            out[full, c] = np.add.reduceat(mix(h ^ _MULT[c + 5]), at)
        out[full, 0] += mix(np.diff(o)[full].astype(np.uint64))
    return out, full


def describer(k: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, o = utf8(batch.column("text"))
            for i, j in chunks(o):
                h, so = shingles(b[o[i] : o[j]], o[i : j + 1] - o[i], k)
                fp, full = prints(h, so)
                sketch = np.zeros((j - i, SKETCH), np.uint32)
                if full.any():
                    h32, at = (h >> np.uint64(32)).astype(np.uint32), so[:-1][full]
                    rows = np.empty((SKETCH, len(at)), np.uint32)
                    for x in range(SKETCH):
                        rows[x] = np.minimum.reduceat((h32 ^ _FLIP[x]) * _SPREAD[x], at)
                    sketch[full] = rows.T
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("th")[i:j], _binary(fp, full), pa.array(np.diff(so)), _binary(sketch, full)], ["doc_id", "th", "fp", "n", "sketch"])

    return describe


def setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, o = utf8(batch.column("text"))
            for i, j in chunks(o):
                h, so = shingles(b[o[i] : o[j]], o[i : j + 1] - o[i], k)
                fp, full = prints(h, so)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((so * 8).astype(np.int32)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([_binary(fp, full), raw], ["fp", "hashes"])

    return sets


def brancher(level: int):
    """Each row's nodes: of all trees at the first level, of its own tree further down."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _matrix(batch.column("sketch"), "<u4").astype(np.uint64)
            if level == 0:
                node = mix(mix(sketch[:, CHOSEN[:, 0]] + np.uint64(1)) ^ _TREE[:, 0]).ravel()
                tree = np.tile(np.arange(TREES, dtype=np.int32), len(sketch))
                fp = batch.column("fp").take(pa.array(np.repeat(np.arange(len(sketch)), TREES)))
            else:
                tree = batch.column("tree").to_numpy(zero_copy_only=False).astype(np.int32)
                parent = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
                node = mix(parent + mix(sketch[np.arange(len(sketch)), CHOSEN[tree, level]] + np.uint64(1)) ^ _TREE[tree, level])
                fp = batch.column("fp")
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(tree), fp], ["node", "tree", "fp"])

    return branch


def agreements(s: np.ndarray) -> np.ndarray:
    """How many tokens each two sketches share."""
    out = np.zeros((len(s), len(s)), np.int16)
    for x in range(SKETCH):
        out += s[:, x, None] == s[None, :, x]
    return out


def spanning(a: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over pairs that agree on enough."""
    m, out = len(a), []
    todo = np.ones(m, bool)
    while todo.any():
        root = int(todo.argmax())
        todo[root] = False
        best, via = a[root].copy(), np.full(m, root)
        while True:
            x = int(np.where(todo, best, -1).argmax())
            if not todo[x] or best[x] < AGREE:
                break
            out.append((int(via[x]), x))
            todo[x] = False
            better = a[x] > best
            best[better], via[better] = a[x][better], x
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of sorted batches; a run is bounded by the size of a node."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        cols = [held.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        at = [0, *cut.tolist()]
        flat = held.combine_chunks()
        for x, y in zip(at, at[1:]):
            yield flat.slice(x, y - x)
        held = flat.slice(at[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def spanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (node, a, b) that span each node."""
    node, left, right = [], [], []

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["node", "a", "b"])
        node.clear(), left.clear(), right.clear()
        return out

    for t in groups(batches, ["node"]):
        if t.num_rows < 2:
            continue
        a = agreements(_matrix(t["sketch"].combine_chunks(), "<u4"))
        np.fill_diagonal(a, -1)
        if not (a >= AGREE).any():
            continue
        fp = t["fp"].to_pylist()
        for i, j in spanning(a):
            node.append(t["node"][0].as_py())
            left.append(min(fp[i], fp[j]))
            right.append(max(fp[i], fp[j]))
        if len(node) > 50_000:
            yield rows()
    yield rows()


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and pivots whose sketches agree on enough, and on how many tokens."""
    for batch in batches:
        n = (_matrix(batch.column("sa"), "<u4") == _matrix(batch.column("sb"), "<u4")).sum(1).astype(np.int32)
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "fp", "pivot")), pa.array(n)], ["node", "fp", "pivot", "n"])
        yield out.filter(pa.array(n >= AGREE))


def seekers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each node that may link to one of another component there."""
    for t in groups(batches, ["node"]):
        if t.num_rows < 2:
            continue
        near = agreements(_matrix(t["sketch"].combine_chunks(), "<u4")) >= AGREE
        _, root = np.unique(np.array(t["root"].to_pylist(), object), return_inverse=True)
        some = (near & (root[:, None] != root[None, :])).any(1)
        if some.any():
            yield from t.select(["node", "fp", "root"]).filter(pa.array(some)).combine_chunks().to_batches()


def common(sets: list[np.ndarray], width: int = 1 << 15) -> np.ndarray:
    """Sizes of the intersections of each two sets."""
    m = len(sets)
    h, row = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    o = np.argsort(h, kind="stable")
    h, row = h[o], row[o]
    col = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
    twice = np.bincount(col)[col] > 1
    row, col = row[twice], col[twice]
    if len(col):
        col = np.cumsum(np.append(True, col[1:] != col[:-1])) - 1
    out = np.zeros((m, m))
    n = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, n, width):
        x, y = np.searchsorted(col, [at, at + width])
        has = np.zeros((m, min(width, n - at)), np.float32)
        has[row[x:y], col[x:y] - at] = 1
        out += has @ has.T
    return out.astype(np.int64)


def linker(percent: int):
    """Links (a, b) that join different components in a node, as few as join them."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for t in groups(batches, ["node"]):
            if t.num_rows < 2:
                continue
            fp = t["fp"].to_pylist()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"].combine_chunks()]
            size, both = np.array([len(x) for x in sets]), common(sets)
            close = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            _, root = np.unique(np.array(t["root"].to_pylist(), object), return_inverse=True)
            for i in range(len(fp)):
                for other in np.unique(root[close[i] & (root != root[i])]).tolist():
                    j = int(np.flatnonzero(close[i] & (root == other))[0])
                    left.append(min(fp[i], fp[j]))
                    right.append(max(fp[i], fp[j]))
                    root[root == other] = root[i]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return link


def confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def need(x, y, percent: int):
    """The least intersection of sets of x and y elements that are similar enough."""
    return -(-percent * (x + y) // (100 + percent))


def bitmap(h: np.ndarray) -> np.ndarray:
    """Of each of BITS classes of tokens, whether the set holds an odd number. Two sets' bitmaps differ in no more bits than
    there are tokens that only one of them holds."""
    return np.packbits((np.bincount((mix(h ^ _MULT[0]) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(COUNTS, np.int64)
    for batch in batches:
        for x in batch.column("hashes"):
            n += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])


def rarest(frequent, percent: int):
    """Of each set the tokens that lead it to nodes: token, size of the set, place of the token in it, and whether the
    set is to be found there by larger ones (place within the first few) or only looks for smaller ones."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = frequent.value
        for batch in batches:
            tokens, owner, place, found, bits = [], [], [], [], np.zeros((batch.num_rows, BITS // 8), np.uint8)
            for k, x in enumerate(batch.column("hashes")):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(h)
                if not n:
                    continue
                bits[k] = bitmap(h)
                looks, shown = n + percent * n // -100 + 1, n - int(need(n, n, percent)) + 1
                h = h[np.lexsort((h, count[(h % np.uint64(COUNTS)).astype(np.int64)]))[:looks]]
                tokens.append(h.view(np.int64))
                owner.append(np.full(len(h), k))
                place.append(np.arange(len(h), dtype=np.int32))
                found.append(np.arange(len(h)) < shown)
            if tokens:
                who = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *(batch.column(c).take(who) for c in ("fp", "root", "n")), pa.array(np.concatenate(place)), pa.array(np.concatenate(found)), _binary(bits).take(who)], ["token", "fp", "root", "n", "place", "shown", "bits"])

    return branch


def meeting(percent: int):
    """Pairs that meet at a token and may be similar enough, of rows sorted by (token, block, looks): those that are
    shown there come first and are held, a block of them; those that look pass by."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            t = pa.Table.from_batches([batch]).combine_chunks()
            token, block, looks = (t[c].to_numpy() for c in ("token", "block", "looks"))
            cut = np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1]) | (looks[1:] != looks[:-1])) + 1
            ends = [0, *cut.tolist(), len(token)] if len(token) else [0]
            for x, y in zip(ends, ends[1:]):
                part, now = t.slice(x, y - x), (int(token[x]), int(block[x]))
                if now != key:
                    key, held = now, []
                if not looks[x]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [pa.concat_tables(held).combine_chunks()]
                shown = held[0]
                (na, pa_, ra), (nb, pb, rb) = ([p[c].to_numpy() for c in ("n", "place", "of")] for p in (shown, part))
                sa, sb = (_matrix(p["bits"].combine_chunks(), "<u8") for p in (shown, part))
                for at in range(0, len(nb), SMALL):  # bounds the matrix
                    m, q, r = (x[at : at + SMALL, None] for x in (nb, pb, rb))
                    j, i = np.nonzero((ra != r) & (na <= m) & (100 * na >= percent * m) & (np.minimum(na - pa_, m - q) >= need(na, m, percent)))
                    for c in range(0, len(j), 1 << 16):
                        u, v = at + j[c : c + (1 << 16)], i[c : c + (1 << 16)]
                        apart = np.bitwise_count(sb[u] ^ sa[v]).sum(1, dtype=np.int64)
                        fits = apart <= na[v] + nb[u] - 2 * need(na[v], nb[u], percent)
                        if fits.any():
                            out = pa.table({"a": part["fp"].take(pa.array(u[fits])), "b": shown["fp"].take(pa.array(v[fits]))})
                            yield from out.combine_chunks().to_batches()

    return meet


def led_by_rarest(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Members (fp, root, n) at each node (token, block) that their rarest tokens lead them to."""
    spark = members.sparkSession
    held = scratch(members.join(sets, "fp").select("fp", "root", "n", "hashes"), "held")
    seen = held.select("hashes").mapInArrow(lean(token_counts), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(COUNTS, np.int64)
    count[seen["bucket"].to_numpy()] = seen["n"].to_numpy()
    rows = scratch(held.mapInArrow(lean(rarest(spark.sparkContext.broadcast(count), percent)), "token long, fp binary, root binary, n long, place int, shown boolean, bits binary"), "rarest")
    several = rows.groupBy("token").agg(F.count_if("shown").alias("size"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y and size > 0")
    rows = rows.join(several.select("token", "size"), "token").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    columns = ["token", "fp", F.xxhash64("root").alias("of"), "n", "place", "bits"]
    shown = rows.filter("shown").select(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("looks"), *columns)
    looks = rows.select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("looks"), *columns)
    return shown.union(looks)


def branched_by_rarest(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of members (fp, root, n) in different components that may be similar enough."""
    led = led_by_rarest(members, sets, percent, scratch)
    pairs = led.repartition("token", "block").sortWithinPartitions("token", "block", "looks").mapInArrow(lean(meeting(percent)), "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def full_sets(ids: DataFrame, reps: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(fp, hashes) of the classes in ids."""
    wanted = scratch(ids.join(reps.select("fp", "doc_id", "th"), "fp").select(F.col("doc_id").alias("want_id"), F.col("th").alias("want_th")), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(side, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("th") == F.col("want_th")), "left_semi")
    return scratch(texts.select("text").mapInArrow(lean(setter(k)), "fp binary, hashes binary").dropDuplicates(["fp"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of fingerprints) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(lean(confirmer(percent)), "a binary, b binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of every end of a link: the smallest reachable end, by label propagation with pointer jumping."""
    own = scratch.inner()
    ends = own(links.select("a", "b").union(links.select("b", "a")).distinct(), "ends")
    label = own(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), "label")
    while True:
        near = ends.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("m"))
        stepped = own(label.join(near, "v").select("v", "root", F.least("root", "m").alias("r2")), "stepped")
        jump = stepped.select(F.col("v").alias("r2"), F.col("r2").alias("r3"))
        label = scratch(stepped.join(jump, "r2", "left").select("v", F.coalesce("r3", "r2").alias("root"), (F.coalesce("r3", "r2") != F.col("root")).alias("moved")), "label")
        if label.filter("moved").isEmpty():
            own.drop()
            return label.select("v", "root")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row per document."""
    return classified(docs, k, percent, Scratch(docs.sparkSession)).drop("th")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The documents that near_duplicates() keeps, with all their columns; of rows with equal id and text, the one whose
    columns have the least hash."""
    held = Scratch(docs.sparkSession)
    found = written(classified(docs, k, percent, held), "found")
    held.drop()
    name = unused("key", docs.columns)
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"))
    of = F.struct(F.col("doc_id").alias("i"), F.col("th").alias("t")).alias(name)

    def sized(keys: DataFrame) -> DataFrame:
        keys = written(keys, "keys")
        return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys

    rows = docs.withColumn(name, key)
    best = rows.join(sized(found.filter("not kept").select(of).distinct()), name, "left_anti")
    again = sized(found.filter("kept").groupBy(of).agg(F.count("*").alias(unused("n", [name]))).filter(F.col(unused("n", [name])) > 1).select(name))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    twice = best.join(again, name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return best.join(again, name, "left_anti").select(*columns).union(twice.select("row.*"))


def classified(docs: DataFrame, k: int, percent: int, result: Scratch) -> DataFrame:
    """near_duplicates() with a hash of each text, th; what it reads stays in result, which the caller may drop."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    seen = result(docs.mapInArrow(lean(describer(k)), "doc_id long, th long, fp binary, n long, sketch binary"), "described")
    full = seen.filter("n > 0")
    reps = scratch(full.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.first("sketch").alias("sketch"), F.first("n").alias("n")).select("fp", "first.doc_id", "first.th", "sketch", "n"), "classes")

    sketches = reps.select("fp", "sketch")
    rows = sketches.mapInArrow(lean(brancher(0)), "node long, tree int, fp binary")
    small, pivots, large = [], [], None
    for level in range(LEVELS):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"))
        shared = scratch(rows.join(sizes.filter("size > 1"), "node"), f"nodes{level}")
        small.append(shared.filter(F.col("size") <= SMALL))
        large = shared.filter(F.col("size") > SMALL)
        if large.isEmpty():
            large = None
            break
        heads = large.groupBy("node").agg(F.min(F.struct(F.xxhash64("fp").alias("h"), "fp")).alias("q"))
        pivots.append(large.join(heads, "node").select("node", "fp", F.col("q.fp").alias("pivot")).filter("fp != pivot"))
        if level + 1 < LEVELS:
            rows = large.join(sketches, "fp").select("node", "tree", "fp", "sketch").mapInArrow(lean(brancher(level + 1)), "node long, tree int, fp binary")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return out

    pair = "node long, a binary, b binary"
    members = union([x.select("node", "fp") for x in small])
    found = members.join(sketches, "fp").select("node", "fp", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(lean(spanner), pair)
    if pivots:
        near = union(pivots).dropDuplicates(["fp", "pivot"])
        near = near.join(sketches.toDF("fp", "sa"), "fp").join(sketches.toDF("pivot", "sb"), "pivot").select("node", "fp", "pivot", "sa", "sb").mapInArrow(lean(alike), "node long, fp binary, pivot binary, n int")
        near = near.groupBy("fp").agg(F.max(F.struct("n", "pivot", "node")).alias("best"))
        found = found.union(near.select("best.node", F.least("fp", "best.pivot"), F.greatest("fp", "best.pivot")))
    found = scratch(found, "candidates")
    tested = found.select("a", "b").distinct()
    sets = full_sets(tested.select(F.col("a").alias("fp")).union(tested.select("b")).distinct(), reps, docs, k, scratch)
    links = scratch(confirmed(tested, sets, percent), "links")
    roots = components(links, scratch)
    rooted = scratch(reps.select("fp", "n").join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "rooted")

    def mixed(nodes: DataFrame) -> DataFrame:
        """Members, with their component, of nodes that hold more than one."""
        m = scratch(nodes.join(rooted, "fp").select("node", "fp", "n", "root"), "members")
        several = m.groupBy("node").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.sum("n").alias("weight")).filter("x != y")
        return scratch(m.join(several.select("node", "weight"), "node"), "mixed")

    late = []
    held = mixed(members.join(found.select("node").distinct(), "node", "left_semi"))
    wide = held.filter(F.col("weight") > HEAVY)
    if large is not None:
        wide = wide.union(mixed(large.select("node", "fp")))
    light = held.filter(F.col("weight") <= HEAVY).join(sketches, "fp").select("node", "fp", "root", "sketch").repartition("node").sortWithinPartitions("node")
    active = scratch(light.mapInArrow(lean(seekers), "node long, fp binary, root binary"), "active")
    if not active.isEmpty():
        sets = full_sets(active.select("fp").distinct(), reps, docs, k, scratch)
        brought = active.join(sets, "fp").select("node", "fp", "root", "hashes").repartition("node").sortWithinPartitions("node")
        late.append(scratch(brought.mapInArrow(lean(linker(percent)), "a binary, b binary").distinct(), "links"))
    wide = scratch(wide.select("fp", "root", "n").distinct(), "wide")
    if not wide.isEmpty():
        sets = full_sets(wide.select("fp"), reps, docs, k, scratch)
        late.append(scratch(confirmed(scratch(branched_by_rarest(wide, sets, percent, scratch), "pairs"), sets, percent), "links"))
    if late and not union(late).isEmpty():
        # Only components and what joins them take part again, however many links these had.
        ends = union(late).join(rooted.select(F.col("fp").alias("a"), F.col("root").alias("x")), "a").join(rooted.select(F.col("fp").alias("b"), F.col("root").alias("y")), "b")
        above = components(ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), scratch).toDF("root", "top")
        roots = rooted.select(F.col("fp").alias("v"), "root").join(above, "root", "left").select("v", F.coalesce("top", "root").alias("root"))

    joined = reps.select("fp", "doc_id").join(roots.withColumnRenamed("v", "fp"), "fp")
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    moved = joined.join(least, "root").select("fp", "component_id")
    final = result(reps.select("fp", "doc_id").join(moved, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id")), "final")
    scratch.drop()
    out = seen.select("doc_id", "th", "fp", F.col("n").alias("n_shingles")).join(final, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def oracle(k: int = 5, percent: int = 75) -> str:
    """DuckDB SQL for near_duplicates() over documents whose doc_ids are unique."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct([array_to_string(words[i:i + {k - 1}], ' ') for i in range(1, greatest(len(words) - {k - 2}, 2))]) END AS s
  FROM split),
sized AS (SELECT doc_id, len(s) AS n FROM sets),
elements AS (SELECT doc_id, hash(unnest(s)) AS h, unnest(s) AS e FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM elements a JOIN elements b ON a.h = b.h AND a.e = b.e AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common c JOIN sized a ON a.doc_id = c.x JOIN sized b ON b.doc_id = c.y WHERE 100 * shared >= {percent} * (a.n + b.n - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM sized UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, l.component_id, l.component_id = s.doc_id AS kept FROM sized s JOIN least l ON l.doc_id = s.doc_id"""
