"""Exact top-k search over term impacts by MaxScore.

Entries and queries are sparse vectors of integer impacts: an id, terms, and an impact for each. Entries are dealt into
cells by the signs of random projections, so that similar ones meet, and large cells by a hash of the id into shards of
bounded size; each shard builds an inverted index with the bounds of every term. A query is first answered by the shard
that is like it; the k-th best score there is its threshold. It then visits only the shards whose bounds can still reach
the threshold, and they get it in blocks of queries. In a shard, the terms that even together cannot lift an entry to
the threshold are non-essential: only the postings of the others are traversed, and the non-essential terms are
probed, the largest bound first, for the entries that are still competitive. The shards' results are merged by score.

Impacts may be negative: a term's bound is the most that any entry can gain by it (0 for an entry without it), so
an entry outside all essential postings stays below the threshold all the same. Entries at the threshold are kept, so
ties go to the smaller id exactly. Impacts are integers of any size: where sums may leave 64 bits they are made of
Python's integers. A score beyond 64 bits is returned as the nearest long, but ranked by its exact value.

How many rows move depends on the data: vectors in clusters visit few shards; with vectors that have no structure no
exact method can leave shards out, and every block of queries visits every shard.

Edge cases: rows with a null id, terms or impacts take no part; of rows with the same id the least (by terms, then
impacts) counts; entries with the query's id are never its results; with fewer than k entries all are results, also at
score 0 or below; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import Scratch, lean, mix, ship, written

SHARD, BLOCK = 8192, 2048
#: Entries of a shard that set the first threshold.
SEED = 256
#: Bytes of bounds that are broadcast at once; more of them are looked through one part after the other.
BOUNDS_BYTES = 16 << 20
#: Sums below it stay in 64-bit integers.
SAFE = 1 << 62
RESULT = "query_id long, id long, score long, big string"


class Shard:
    def __init__(self, ids: np.ndarray, offs: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        owner = place[np.repeat(np.arange(len(ids)), np.diff(offs))]
        by = np.lexsort((owner, terms))
        owner, terms, impacts = owner[by], terms[by], impacts[by]
        names, at = np.unique(terms, return_index=True)
        ends = np.append(at[1:], len(terms))
        self.postings = {int(t): (owner[x:y], impacts[x:y]) for t, x, y in zip(names, at, ends)}
        n = len(ids)
        self.bounds = {t: (int(v.min()) if len(o) == n else min(0, int(v.min())), int(v.max()) if len(o) == n else max(0, int(v.max()))) for t, (o, v) in self.postings.items()}
        self.whole = {t: v.astype(np.int64) for t, (o, v) in self.postings.items() if max(abs(x) for x in self.bounds[t]) < SAFE}

    def add(self, to: np.ndarray, t: int, q: int, only: np.ndarray | None = None) -> None:
        """Adds a term's scores to all entries, or to those of ``only`` (ascending)."""
        owner, v = self.postings[t][0], self.whole[t]
        if len(owner) == len(self.ids):
            to += q * (v if only is None else v[only])
        elif only is None:
            np.add.at(to, owner, q * v)
        else:
            at = np.minimum(np.searchsorted(owner, only), len(owner) - 1)
            to += np.where(owner[at] == only, q * v[at], 0)

    def search(self, terms: np.ndarray, impacts: np.ndarray, own: int, k: int, theta: int | None = None) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best entries but the query's own, of those that reach theta; ties to the smaller id."""
        q = [(int(t), int(w)) for t, w in zip(terms, impacts) if w and int(t) in self.postings]
        if sum(abs(w) * max(abs(x) for x in self.bounds[t]) for t, w in q) >= SAFE:
            return self.search_wide(q, own, k)
        gain = {t: max(w * self.bounds[t][0], w * self.bounds[t][1]) for t, w in q}
        q.sort(key=lambda x: gain[x[0]])
        allowed = self.ids != own
        seed = np.flatnonzero(allowed[: SEED + k])
        if len(seed) >= k:
            first = np.zeros(len(seed), np.int64)
            for t, w in q:
                self.add(first, t, w, seed)
            best = int(np.partition(first, len(first) - k)[len(first) - k])
            theta = best if theta is None else max(theta, best)
        split, rest = 0, 0
        while theta is not None and split < len(q) and rest + gain[q[split][0]] < theta:
            rest += gain[q[split][0]]
            split += 1
        score = np.zeros(len(self.ids), np.int64)
        for t, w in q[split:]:
            self.add(score, t, w)
        alive = np.flatnonzero(allowed if theta is None else allowed & (score + rest >= theta))
        score = score[alive]
        for t, w in reversed(q[:split]):
            self.add(score, t, w, alive)
            rest -= gain[t]
            keep = score + rest >= theta
            alive, score = alive[keep], score[keep]
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[keep], score[keep]
        best = np.lexsort((alive, -score))[:k]  # entries are in ascending id
        return self.ids[alive[best]], score[best].tolist()

    def search_wide(self, q: list[tuple[int, int]], own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """The same for sums that may leave 64 bits."""
        score = np.zeros(len(self.ids), object)
        for t, w in q:
            owner, v = self.postings[t]
            np.add.at(score, owner, np.array([w * int(x) for x in v], object))
        best = sorted(np.flatnonzero(self.ids != own).tolist(), key=lambda i: (-score[i], i))[:k]
        return self.ids[best], [int(score[i]) for i in best]


def _exact(x: pa.Array) -> np.ndarray:
    """Impacts as they are: integers, or whole numbers in doubles."""
    return x.flatten().to_numpy(zero_copy_only=False)


def _lists(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    lists = [t[c].combine_chunks() for c in ("terms", "impacts")]
    offs = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return t["id"].to_numpy(), offs, _exact(lists[0]).astype(np.int64), _exact(lists[1])


def big_key(score: int) -> str | None:
    """For a score beyond 64 bits, a string that sorts as the score does."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return text if score > 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def searcher(k: int):
    def search(entries: pa.Table, queries: pa.Table) -> pa.Table:
        who, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        if entries.num_rows and queries.num_rows:
            shard = Shard(*_lists(entries))
            qid, offs, terms, impacts = _lists(queries)
            theta = queries["theta"].to_pylist()
            for n, own in enumerate(qid.tolist()):
                a, s = shard.search(terms[offs[n] : offs[n + 1]], impacts[offs[n] : offs[n + 1]], own, k, theta[n])
                who.append(np.full(len(a), own))
                ids.append(a)
                scores += s
        big = pa.array([big_key(x) for x in scores], pa.string())
        low, high = -(1 << 63), (1 << 63) - 1
        return pa.table({"query_id": np.concatenate(who), "id": np.concatenate(ids), "score": pa.array([min(max(x, low), high) for x in scores], pa.int64()), "big": big})

    return search


def placer(bits: int):
    """Each vector's cell: the signs of its projections on random directions."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("terms", "impacts")]
            n = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, impacts = _exact(lists[0]).astype(np.int64).view(np.uint64), _exact(lists[1]).astype(np.float64)
            impacts = impacts / np.repeat(np.maximum(np.maximum.reduceat(np.append(np.abs(impacts), 0), np.cumsum(n) - n), 1e-300), n)
            cell = np.zeros(len(n), np.int64)
            sums = np.zeros(len(impacts) + 1)
            ends = np.cumsum(n)
            for b in range(bits):
                # a sum of the uniform bits of a hash is near enough to a normal direction
                h = mix(terms + np.uint64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                way = sum(((h >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.float64) for j in range(4)) - 131070.0
                np.cumsum(impacts * way, out=sums[1:])
                cell |= (sums[ends] - sums[ends - n] > 0).astype(np.int64) << b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return place


def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and the greatest impact of each term in each shard, and in how many entries it is."""
    for batch in batches:
        _, offs, terms, impacts = _lists(pa.Table.from_batches([batch]).select(["id", "terms", "impacts"]))
        shard = np.repeat(batch.column("shard").to_numpy(), np.diff(offs))
        by = np.lexsort((terms, shard))
        shard, terms, impacts = shard[by], terms[by], impacts[by].astype(np.float64)
        at = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (terms[1:] != terms[:-1]))[: len(shard)])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard[at], terms[at], np.minimum.reduceat(impacts, at), np.maximum.reduceat(impacts, at), np.diff(np.append(at, len(shard))))], ["shard", "term", "low", "high", "n"])


def visitor(bounds):
    """(query, shard) for each shard whose bounds reach the query's threshold, but its own."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, names, low, high = bounds.value
        for batch in batches:
            ids, offs, terms, impacts = _lists(pa.Table.from_batches([batch]).select(["id", "terms", "impacts"]))
            theta, home = batch.column("theta").to_pylist(), batch.column("shard").to_numpy()
            who, where = [], []
            for n in range(len(ids)):
                q, t = impacts[offs[n] : offs[n + 1]].astype(np.float64), terms[offs[n] : offs[n + 1]]
                at = np.minimum(np.searchsorted(names, t), len(names) - 1)
                known = names[at] == t
                q, at = q[known], at[known]
                most = np.maximum(low[:, at] * q, high[:, at] * q)
                slack = 1e-9 * np.abs(most).sum(1) + 1  # more than rounding can take
                there = np.flatnonzero((shards != home[n]) & ((theta[n] is None) | ~(most.sum(1) + slack < (theta[n] or 0))))
                who.append(np.full(len(there), n))
                where.append(shards[there])
            rows = np.concatenate(who) if who else np.zeros(0, np.int64)
            out = batch.drop_columns(["shard"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(where) if where else np.zeros(0, np.int64))], [*out.schema.names, "shard"])

    return visit


def bounds_of(rows: list, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shards, terms, and matrices of the bounds of each term in each shard."""
    shards, names = np.array(sorted(sizes), np.int64), np.array(sorted({r["term"] for r in rows}), np.int64)
    low, high = np.zeros((2, len(shards), len(names)))
    at = {int(s): k for k, s in enumerate(shards)}
    place = {int(t): k for k, t in enumerate(names)}
    for r in rows:
        i, j, full = at[r["shard"]], place[r["term"]], r["n"] == sizes[r["shard"]]
        low[i, j], high[i, j] = (r["low"], r["high"]) if full else (min(0.0, r["low"]), max(0.0, r["high"]))
    return shards, names, low, high


def answered(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Results of queries (shard, id, terms, impacts, theta) in their shards, which get them in blocks."""
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    q = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id", F.lit(4)), F.col("blocks")).cast("int")).select("shard", "block", "id", "terms", "impacts", "theta")
    e = entries.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "block", "id", "terms", "impacts")
    return e.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(searcher(k), RESULT)


def top_k(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id and score of each query's k best; both sides have id, terms and impacts of equal length."""
    spark = entries.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    whole = "id is not null and terms is not null and impacts is not null and size(terms) = size(impacts)"
    least = F.min(F.struct("terms", "impacts")).alias("least")
    entries, queries = (x.select(F.col("id").cast("long"), "terms", "impacts").filter(whole).groupBy("id").agg(least).select("id", "least.*") for x in (entries, queries))
    entries, queries = scratch(entries, "entries"), scratch(queries, "queries")
    n = entries.count()
    bits = max(0, (-(-n // SHARD) - 1).bit_length())
    kind = {c: entries.schema[c].dataType.simpleString() for c in ("terms", "impacts")}
    placed = f"id long, terms {kind['terms']}, impacts {kind['impacts']}, cell long"
    entries, queries = (x.mapInArrow(lean(placer(bits)), placed) for x in (entries, queries))
    entries = scratch(entries, "placed")
    sizes = entries.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).alias("parts"))
    shard = (F.col("cell") * (1 << 24) + F.pmod(F.xxhash64("id", F.lit(3)), F.coalesce("parts", F.lit(1)))).alias("shard")
    entries, queries = (x.join(sizes, "cell", "left").select("id", "terms", "impacts", shard) for x in (entries, queries))
    entries, queries = scratch(entries.repartition("shard"), "shards"), scratch(queries, "asked")
    first = scratch(answered(entries, queries.withColumn("theta", F.lit(None).cast("long")), k), "first")
    # A threshold beyond 64 bits is none: the nearest long is no lower bound for negative scores.
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.when((F.count("*") >= k) & (F.min("score") > -(1 << 62)), F.min("score")).alias("theta"))
    asked = scratch(queries.join(reached, "id", "left").select("id", "terms", "impacts", "theta", "shard"), "asked")
    counts = {r["shard"]: r["count"] for r in entries.groupBy("shard").count().collect()}  # a shard holds up to SHARD entries
    later = []
    if len(counts) > 1:
        terms = scratch(entries.mapInArrow(lean(limits), "shard long, term long, low double, high double, n long").groupBy("shard", "term").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")), "bounds")
        every = sorted(counts)
        step = max(1, BOUNDS_BYTES // (16 * max(1, terms.select("term").distinct().count())))
        for x in range(0, len(every), step):
            some = every[x : x + step]
            rows = terms.filter(F.col("shard").between(some[0], some[-1])).collect()
            bounds = spark.sparkContext.broadcast(bounds_of(rows, {s: counts[s] for s in some}))
            later.append(scratch(asked.mapInArrow(lean(visitor(bounds)), f"id long, terms {kind['terms']}, impacts {kind['impacts']}, theta long, shard long"), "visits"))
            bounds.unpersist()
    found = first
    for visits in later:
        found = found.union(answered(entries, visits, k))
    wide = F.coalesce("big", F.when(F.col("score") > 0, "").otherwise("~"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), wide.desc(), "id"))
    out = written(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score"), "found")
    scratch.drop()
    return out


def impacts_of(vector: Column, scale: int = 64) -> Column:
    """Integer impacts floor(scale * x) of a dense vector, in doubles, which hold them exactly; null where it has a null
    or non-finite component, or one whose product with the scale is no double any more (beyond 1e306)."""
    x = lambda v: v.cast("double") * scale
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < float("inf")))
    # beyond 2 ** 52 a double is whole, and floor() would leave the range of a long
    each = F.transform(vector, lambda v: F.when(F.abs(x(v)) < float(1 << 52), F.floor(x(v)).cast("double")).otherwise(x(v)))
    return F.when(whole, each)


def vector_entries(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """Dense vectors (vec_id, embedding) as entries: their dimensions are the terms."""
    v = vectors.select(F.col("vec_id").alias("id"), impacts_of(F.col("embedding"), scale).alias("impacts"))
    return v.withColumn("terms", F.transform("impacts", lambda x, i: i))


def oracle(k: int = 20, every: int = 20) -> str:
    """DuckDB SQL for the query over embeddings (floor(64 * x)), for impacts whose sums fit 64 bits."""
    return f"""
WITH v AS (
  SELECT vec_id, min([CAST(floor(64.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding]) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.w[i] * c.w[i] for i in range(1, least(len(q.w), len(c.w)) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= {k}"""
