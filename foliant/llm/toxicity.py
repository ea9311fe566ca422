"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary documents.

Words are runs of letters, digits and non-ASCII characters (A-Z folded), hashed into fixed tables. Each class has an
interpolated bigram model of all places in all its labelled documents outside the held-out and the calibration fold;
exact copies of a text count once. Counts of the larger class are scaled to the smaller one's total. With D the
absolute discount and c a class:

    word level: own(w) = max(different words before w - D, 0)
    p(w) = (own(w) + shared(w)) / sum over all words
    pair level: own(h, w) = max(count of w after h - D, 0)
    p(w | h) = (own(h, w) + shared(h, w) * tilt(w) + rest(h) * p(w)) / total(h)

The shared counts are the same for both classes: ``FLOOR`` and the share ``BACKOFF`` of the classes' mean count, so an
expression that is rare in both is about as likely in either. rest(h) is what the discounts and the pairs that are not
kept leave of the counts after h, plus ``FLOOR``; tilt(w) is p(w) over its mean of both classes; total(h) is the sum of
the numerators, so each distribution sums to 1.

The counts of pairs are a distributed table that grows with the labelled texts. Of it the models keep the pairs that
matter: those whose share of all pairs, times the change of the log ratio that they make against the word level, is at
least ``MATTERS``. Shares sum to 1 and a change is at most the logarithm of the largest ratio, so no input, however
large, has more than a few million such pairs; the others are left to rest(h).

A document's evidence is its length-normalised log-likelihood ratio, over the whole text and over its most toxic runs of
``RUNS`` words each (a long text may be toxic in one place only); a logistic function of it, learned from other labelled
documents, makes it a score. The calibration sees about ``sample`` documents a class at most, which the models have not
seen; if one of the two parts lacks a class, both parts are all labelled documents outside the held-out fold.

Edge cases: a null or wordless text has no evidence either way and gets the score of a ratio of 0; without labels of
both classes every score is 0; several labels of one doc_id, or of one text, count as toxic if one does; labels of null
doc_ids are not used; a doc_id with several texts labels each of them, and its repeated rows count each; repeated rows
are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.language_id import fold_of
from foliant.llm.shared import FOLDED, Scratch, chunks, lean, ship, slice_hashes, utf8, words

WORDS = 1 << 18
#: Ids that may be broadcast; more are joined by shuffling.
BROADCAST_IDS = 200_000
#: Lengths in words of the runs whose mean ratio is evidence.
RUNS = (1, 2, 4, 8)
DISCOUNT = 0.75
FLOOR = 3.0
BACKOFF = 0.2
MATTERS = 1e-6
#: Distinct pairs that a task adds up before it hands them on.
HELD = 1 << 20
MEMBER = np.zeros(256, bool)
MEMBER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Settings:
    """sample: about how many documents a class the calibration sees at most."""

    sample: int = 6000


def bigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of texts: its range, the bucket of each word and of the word before it (0 at the start), and offsets."""
    b, o = utf8(texts)
    for i, j in chunks(o):
        s, e, first = words(b[o[i] : o[j]], o[i : j + 1] - o[i], MEMBER)
        w = (slice_hashes(b[o[i] : o[j]], s, e, FOLDED) % np.uint64(WORDS - 1)).astype(np.int64) + 1
        h = np.concatenate([[0], w[:-1]]) if len(w) else w
        h[first[:-1][first[:-1] < len(h)]] = 0
        yield i, j, w, h, first


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts (2 x n)."""
    key, n = np.concatenate(keys), np.concatenate(counts, 1)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[:, order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[at], (np.add.reduceat(n, at, 1) if len(at) else n)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words (the first << 20 | the second) and how often they stand in ordinary and in toxic texts of a task."""
    keys, counts, size = [], [], 0

    def rows() -> pa.RecordBatch:
        key, n = added(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[0]), pa.array(n[1])], ["key", "n0", "n1"])

    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, w, h, first in bigrams(batch.column("text")):
            own = np.repeat(toxic[i:j], np.diff(first))
            key, n = np.unique((h << 21) | (w << 1) | own, return_counts=True)
            keys.append(key >> 1)
            counts.append(np.where(np.stack([key & 1 == 0, key & 1 == 1]), n, 0))
            size += len(key)
        if size > HELD:
            key, n = added(keys, counts)
            keys[:], counts[:], size = [key], [n], len(key)
            if size > HELD // 2:
                yield rows()
                keys, counts, size = [], [], 0
    if keys:
        yield rows()


def scales(totals: np.ndarray) -> np.ndarray:
    return (totals.min() / np.maximum(totals, 1))[:, None]


@dataclass
class Words:
    """What the word level and the contexts have: arrays over WORDS for each class."""

    p: np.ndarray  # 2 x WORDS
    after: np.ndarray  # WORDS: mean scaled count of pairs with this first word
    scale: np.ndarray  # of pairs, 2 x 1

    @classmethod
    def of(cls, kinds: np.ndarray, after: np.ndarray) -> Words:
        """kinds: different words before each word, after: pairs with this first word; 2 x WORDS each."""
        own = np.maximum(kinds - DISCOUNT, 0) * scales(kinds.sum(1))
        p = own + FLOOR + BACKOFF * own.mean(0)
        scale = scales(after.sum(1))
        return cls(p / p.sum(1, keepdims=True), (after * scale).mean(0), scale)

    @property
    def tilt(self) -> np.ndarray:
        return self.p / self.p.mean(0)

    def parts(self, pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs with counts n (2 x pairs): the discounted counts, and these with the shared ones."""
        own = np.maximum(n - DISCOUNT, 0) * self.scale
        return own, own + (FLOOR + BACKOFF * own.mean(0)) * self.tilt[:, pairs & 1048575]

    def matter(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        own, top = self.parts(pairs, n)
        w = pairs & 1048575
        share = own.mean(0) / max(self.after.sum(), 1.0)
        return share * np.abs(np.log(top[1] / top[0]) - np.log(self.p[1, w] / self.p[0, w])) >= MATTERS


@dataclass
class Model:
    """Log ratios of toxic to ordinary."""

    pairs: np.ndarray  # pairs of words that are kept, ascending
    pair: np.ndarray  # of each pair
    word: np.ndarray  # WORDS: of a word in any pair that is not kept
    before: np.ndarray  # WORDS: of the totals after a word

    @classmethod
    def of(cls, words: Words, pairs: np.ndarray, n: np.ndarray) -> Model:
        """pairs: ascending; n: their counts, 2 x pairs."""
        top, total = levels(words, pairs, n)
        w = words.p
        return cls(pairs, np.log(top[1] / top[0]), np.log(w[1] / w[0]), np.log(total[1] / total[0]))

    def ratios(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = self.word[w]
        if len(self.pairs):
            key = (h << 20) | w
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = np.flatnonzero(self.pairs[at] == key)
            out[hit] = self.pair[at[hit]]
        return out - self.before[h]

    def evidence(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Of each text: the mean log ratio, and those of its most toxic runs."""
        for _, _, w, h, first in bigrams(texts):
            n = np.diff(first)
            full = np.flatnonzero(n)
            out = np.zeros((len(n), 1 + len(RUNS)))
            if len(full):
                at = first[:-1][full]
                sums = np.concatenate([[0.0], np.cumsum(self.ratios(w, h))])
                out[full, 0] = (sums[first[1:]] - sums[first[:-1]])[full] / n[full]
                ends = np.repeat(first[1:], n)
                for k, size in enumerate(RUNS):
                    run = (sums[np.minimum(np.arange(len(w)) + size, ends)] - sums[:-1]) / size
                    out[full, k + 1] = np.maximum(np.maximum.reduceat(run, at), 0)
            yield out

    def score(self, texts: pa.Array, curve: np.ndarray) -> np.ndarray:
        parts = [1 / (1 + np.exp(-np.clip(curve[0] + columns(x) @ curve[1:], -40, 40))) for x in self.evidence(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)


def levels(words: Words, pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that are kept: their numerators (2 x pairs), and total() of all contexts (2 x WORDS)."""
    own, top = words.parts(pairs, n)
    h, w = pairs >> 20, pairs & 1048575
    rest = rest_of(words, pairs, own)
    total = np.stack([rest + np.bincount(h, x, WORDS) for x in top])
    return top + rest[h] * words.p[:, w], total


def rest_of(words: Words, pairs: np.ndarray, own: np.ndarray) -> np.ndarray:
    return words.after - np.bincount(pairs >> 20, own.mean(0), WORDS) + FLOOR


def columns(evidence: np.ndarray) -> np.ndarray:
    """What the curve weighs: the evidence, and that of runs squared too, as chance makes many weak runs."""
    return np.column_stack([evidence, evidence[:, 1:] ** 2])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on a log loss with a ridge penalty on the standardised columns; the bias comes first."""
    mid, spread = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mid) / spread])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) / len(y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mid / spread).sum()], w[1:] / spread])


def known_texts(docs: DataFrame, labels: DataFrame, s: Settings, scratch: Scratch) -> DataFrame | None:
    """Labelled texts outside the held-out fold: those to count (learn) and those to calibrate on (prove)."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic in (0, 1)")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").isNotNull().alias("there"))
    ids = scratch(hashed.filter("there").filter(fold_of() != 0).join(known, "doc_id").withColumn("part", (fold_of() == 4).cast("int")).select("doc_id", "th", "toxic", "part"), "labelled")
    # Of documents with one text, the first of the earliest part counts for all.
    ids = scratch(ids.groupBy("th").agg(F.max("toxic").alias("toxic"), F.min(F.struct("part", "doc_id")).alias("first")).select("th", "toxic", "first.*"), "texts")
    counts = {(r["toxic"], r["part"]): r["count"] for r in ids.groupBy("toxic", "part").count().collect()}
    if {t for t, _ in counts} != {0, 1}:
        return None
    apart = len(counts) == 4
    size = counts if apart else {(t, 1): sum(n for (x, _), n in counts.items() if x == t) for t in (0, 1)}
    draw, share = F.pmod(F.xxhash64("th", F.lit(5)), F.lit(1 << 20)), F.lit(0)
    for toxic in (0, 1):
        share = F.when(F.col("toxic") == toxic, F.lit(min(1 << 20, -(-s.sample * (1 << 20) // size[toxic, 1])))).otherwise(share)
    chosen = ids.select("doc_id", "th", "toxic", ((F.col("part") == 0) if apart else F.lit(True)).alias("learn"), (((F.col("part") == 1) if apart else F.lit(True)) & (draw < share)).alias("prove")).filter("learn or prove")
    if sum(counts.values()) <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    return scratch(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(chosen, ["doc_id", "th"]).select("text", "toxic", "learn", "prove"), "sample")


def table_of(rows: DataFrame, *columns: str) -> np.ndarray:
    """Rows of (bucket, ...) as arrays over WORDS."""
    t = rows.toArrow()
    out = np.zeros((len(columns), WORDS))
    for k, c in enumerate(columns):
        out[k, t["bucket"].to_numpy()] = t[c].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()):
    """A broadcast model of labelled documents outside the held-out fold, and its curve; None without both classes."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    texts = known_texts(docs, labels, s, scratch)
    if texts is None:
        scratch.drop()
        return None
    pairs = texts.filter("learn").select("text", "toxic").mapInArrow(lean(counted), "key long, n0 long, n1 long")
    pairs = scratch(pairs.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "pairs")
    kinds = table_of(pairs.groupBy(F.expr("key & 1048575").alias("bucket")).agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")), "n0", "n1")
    after = table_of(pairs.groupBy(F.expr("key >> 20").alias("bucket")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "n0", "n1")
    level = Words.of(kinds, after)
    kept = pairs.mapInArrow(lean(chooser(spark.sparkContext.broadcast(level))), "key long, n0 long, n1 long").toArrow().sort_by("key")
    sent = spark.sparkContext.broadcast(Model.of(level, kept["key"].to_numpy(), np.stack([kept["n0"].to_numpy(), kept["n1"].to_numpy()])))
    rows = texts.filter("prove").select("toxic", "text").mapInArrow(lean(prover(sent)), "toxic long, evidence array<double>").toArrow()
    x, y = columns(np.array(rows["evidence"].to_pylist()).reshape(-1, 1 + len(RUNS))), rows["toxic"].to_numpy()
    order = np.lexsort((y, *x.T))
    scratch.drop()
    return sent, logistic(x[order], y[order])


def chooser(words):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.stack([batch.column(c).to_numpy() for c in ("n0", "n1")])
            yield batch.filter(pa.array(words.value.matter(batch.column("key").to_numpy(), n)))

    return choose


def prover(model):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(model.value.evidence(batch.column("text")))
            if got:
                yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int64()), pa.array(np.concatenate(got).tolist(), pa.list_(pa.float64()))], ["toxic", "evidence"])

    return prove


def scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = model[0].value.score(batch.column("text"), model[1]) if model is not None else np.zeros(batch.num_rows)
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, s)
    rows = docs.select("doc_id", (fold_of() == 0).alias("held_out"), "text")
    return rows.mapInArrow(lean(scorer(model)), "doc_id long, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents, with all their columns, that are not predicted to be toxic."""
    model = fit(docs, labels, s)
    if model is None:
        return docs
    sent, curve = model

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(sent.value.score(batch.column("text"), curve) < 0.5))

    return docs.mapInArrow(lean(keep), docs.schema)
