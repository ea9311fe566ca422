"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters (A-Z and the Latin-1 capitals folded) of the whole text, weighted
(1 + ln tf) * idf and scaled to length 1. Document frequencies cover all documents to learn from. The weights are
fitted by follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded sample of them:
``sample`` documents a language at most, ``total`` in all, those with the least hashes of id and text; a fifth of the
sample is kept apart and sets the temperature of the softmax. The ``languages`` most frequent languages are learned (of
as frequent ones the first by code point).

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is nothing to
learn from; repeated rows are predicted alike; a null doc_id is never learned from; other columns are ignored. Ties
between languages go to the first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import chunks, lean, ship, utf8

BUCKETS = 1 << 15
ORDERS = 3
UNKNOWN = "und"
#: A score is no guess if it is better than that of a guess by this share of it.
MARGIN = 0.1


@dataclass(frozen=True)
class Settings:
    """sample and total: the bounds on documents, of a language and of all, that the weights are fitted on; languages: how
    many are learned at most."""

    sample: int = 800
    total: int = 8000
    languages: int = 200
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.02


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of UTF-8 texts, and their offsets."""
    at = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[o]
    c = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[(c >= 65) & (c <= 90) | (c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)] += 32
    return c, at


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Of each text: its buckets and their counts; None if it has no letter."""
    b, o = utf8(texts)
    for i, j in chunks(o):
        c, at = code_points(b[o[i] : o[j]], o[i : j + 1] - o[i])
        letter = np.concatenate([[0], np.cumsum(_letters()[c])])
        grams, h = [], np.zeros(len(c), np.uint32)
        for k in range(ORDERS):
            h = (h[: len(c) - k] if k else h) * np.uint32(0x01000193) + (c[k:] + np.uint32(1)) * np.uint32(0x9E3779B1)
            x = h ^ (h >> np.uint32(15))
            grams.append(((x * np.uint32(0x85EBCA6B) + np.uint32(k * 0x27D4EB2F)) >> np.uint32(17)).astype(np.int64))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            if letter[y] == letter[x]:
                yield None
                continue
            count = np.bincount(np.concatenate([g[x : max(x, y - k)] for k, g in enumerate(grams)]), minlength=BUCKETS)
            idx = np.flatnonzero(count)
            yield idx, count[idx]


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for f in features(batch.column("text")):
            if f is not None:
                df[f[0]] += 1
                n += 1
    df[BUCKETS] = n
    idx = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(df[idx])], ["bucket", "df"])


def weigh(idx: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[idx]
    return (x / max(float(np.sqrt(x @ x)), 1e-12)).astype(np.float32)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [f for f in zip(features(batch.column("text")), batch.column("lang").to_pylist()) if f[0] is not None]
        yield pa.RecordBatch.from_arrays([pa.array([lang for _, lang in rows], pa.string()), pa.array([f[0].astype(np.uint16).tobytes() for f, _ in rows], pa.binary()), pa.array([f[1].astype(np.uint32).tobytes() for f, _ in rows], pa.binary())], ["lang", "idx", "count"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: Settings) -> np.ndarray:
    """Weights (BUCKETS x classes) after s.epochs passes in a fixed random order."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    order = np.random.default_rng(11)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for e in order.permutation(len(examples)):
            idx, x, y = examples[e]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            after = ni + g * g
            z[idx] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / s.alpha * w
            n[idx] = after
    return weights(z, n).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The T of softmax(logits / T) with the least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    w: np.ndarray
    temperature: float

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        lang, score = [], []
        for f in features(texts):
            if f is None or not self.langs:
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            p = softmax(weigh(*f, self.idf) @ self.w[f[0]] / self.temperature)
            k = int(p.argmax())
            lang.append(self.langs[k])
            score.append(float(min(1.0, p[k])))
        return lang, score


def fit(learn: DataFrame, s: Settings = Settings()) -> Model:
    """A model of the rows (doc_id, text, lang) to learn from; the sample is the same at every run."""
    spark = learn.sparkSession
    ship(spark)
    learn = learn.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(s.languages).collect()}
    langs = sorted(counts, key=lambda x: x.encode())
    idf = np.zeros(BUCKETS, np.float32)
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), 1.0)
    df = learn.select("text").mapInArrow(lean(document_frequencies), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    seen = np.zeros(BUCKETS + 1, np.int64)
    seen[df["bucket"].to_numpy()] = df["df"].to_numpy()
    idf = (np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1).astype(np.float32)
    most = min(s.sample, max(1, s.total // len(langs)))
    # Rows below a hash that about twice as many pass as are wanted, and of those the first.
    limits = spark.createDataFrame([(lang, min(1 << 20, -(-2 * most * (1 << 20) // counts[lang]) + (1 << 12))) for lang in langs], "lang string, share long")
    hashed = learn.withColumn("h", F.xxhash64("doc_id", "text", F.lit(7))).join(F.broadcast(limits), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.col("share"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h"))
    some = hashed.withColumn("r", first).filter(F.col("r") <= most)
    rows = some.select("text", "lang").mapInArrow(lean(vectors), "lang string, idx binary, count binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["idx"], r["count"]))
    number = {x: k for k, x in enumerate(langs)}
    examples = []
    for r in rows:
        idx = np.frombuffer(r["idx"], np.uint16).astype(np.int64)
        examples.append((idx, weigh(idx, np.frombuffer(r["count"], np.uint32), idf), number[r["lang"]]))
    apart, fitted = examples[::5], [e for k, e in enumerate(examples) if k % 5] or examples
    w = ftrl(fitted, len(langs), s)
    logits = np.array([x @ w[idx] for idx, x, _ in apart]).reshape(len(apart), len(langs))
    return Model(langs, idf, w, temperature(logits, np.array([y for _, _, y in apart], np.int64)))


def predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.value.predict(batch.column("text"))
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those that are not held out."""
    spark = docs.sparkSession
    model = fit(docs.filter(fold_of() != 0), s)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the input
    rows = docs.select("doc_id", (fold_of() == 0).alias("held_out"), "text")
    return rows.mapInArrow(lean(predictor(shared)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, s: Settings = Settings(), margin: float = MARGIN) -> DataFrame:
    """The documents, with all their columns, in a language the model knows: not ``und``, and scored better than a guess
    among the learned languages by the margin (a share of the guess); a single learned language is never a guess, and with
    nothing to learn from all texts with a letter stay."""
    model = fit(docs.filter(fold_of() != 0), s)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least = (1 + margin) / len(model.langs) if len(model.langs) > 1 else 0.0

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value.langs:
                lang, score = shared.value.predict(batch.column("text"))
                stays = [x != UNKNOWN and p >= least for x, p in zip(lang, score)]
            else:
                stays = [f is not None for f in features(batch.column("text"))]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
