import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import language_id, toxicity
from foliant.llm.shared import Scratch
from tests_llm_prose import prose

WORDS = {"aa": "the and of with house water stone river".split(), "bb": "der und von mit haus wasser stein fluss".split(), "cc": "le et de avec maison eau pierre fleuve".split()}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    rows = []
    for n in range(240):
        lang = ("aa", "bb", "cc")[n % 3]
        rows.append((n, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))), lang, "s", "x"))
    rows += [(500, None, "aa", None, None), (501, "", "bb", None, None), (502, "123 !?\n", "aa", None, None), (503, "maison", None, None, None), (504, "wasser " * 20000, "bb", None, None), (None, "river stone", "bb", None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


def test_language(spark, texts):
    rows = language_id.identify(texts).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == texts.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(by[x]["lang_pred"] == "und" and by[x]["score"] == 0 for x in (500, 501, 502))
    assert by[503]["lang_pred"] == "cc" and by[504]["lang_pred"] == "bb" and by[None]["lang_pred"] == "aa"
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in rows)
    assert held and sum(r["lang_pred"] == ("aa", "bb", "cc")[r["doc_id"] % 3] for r in held) >= 0.95 * len(held)
    kept = language_id.keep_known(texts)
    assert kept.columns == texts.columns and kept.count() == len(rows) - 3


def test_language_without_anything(spark, texts):
    none = texts.limit(0)
    assert language_id.identify(none).count() == 0
    mute = texts.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(mute).collect()} == {"und"}
    assert language_id.keep_known(mute).count() == texts.count() - 3  # what has a letter


def plain_buckets(text):
    """Counts of hashed n-grams, one character after the other."""
    c = [ord(x) + 32 if "A" <= x <= "Z" or "\u00c0" <= x <= "\u00de" and x != "\u00d7" else ord(x) for x in text]
    out = defaultdict(int)
    for k in range(1, 4):
        for i in range(len(c) - k + 1):
            h = 0
            for x in c[i : i + k]:
                h = (h * 0x01000193 + (x + 1) * 0x9E3779B1) % 2**32
            h ^= h >> 15
            out[((h * 0x85EBCA6B + (k - 1) * 0x27D4EB2F) % 2**32) >> 17] += 1
    return dict(out)


def test_features_and_weights_as_one_by_one():
    texts = ["Ab \u00c4b ba", "x", "aaa aaa", "\u65e5\u672c x\U0001f600y"]
    got = list(language_id.features(pa.array([*texts, "12", None])))
    assert got[4:] == [None, None] and [dict(zip(i.tolist(), n.tolist())) for i, n in got[:4]] == [plain_buckets(t) for t in texts]
    df = defaultdict(int)
    for t in texts:
        for b in plain_buckets(t):
            df[b] += 1
    idf = np.zeros(language_id.BUCKETS, np.float32)
    for b, n in df.items():
        idf[b] = math.log((1 + len(texts)) / (1 + n)) + 1
    for t, (idx, n) in zip(texts, got):
        x = {b: (1 + math.log(k)) * float(idf[b]) for b, k in plain_buckets(t).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        assert np.allclose(language_id.weigh(idx, n, idf), [x[b] / size for b in idx.tolist()], atol=1e-6)


def test_ftrl_as_one_by_one():
    s = language_id.Settings(epochs=2)
    rng = np.random.default_rng(2)
    examples = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(12)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= s.l1:
            return 0.0
        return -(z[key] - math.copysign(s.l1, z[key])) / ((s.beta + math.sqrt(n[key])) / s.alpha + s.l2)

    order = np.random.default_rng(11)
    for _ in range(s.epochs):
        for e in order.permutation(len(examples)):
            idx, x, y = examples[e]
            w = {(i, c): weight((i, c)) for i in idx.tolist() for c in range(3)}
            score = [sum(v * w[i, c] for i, v in zip(idx.tolist(), x)) for c in range(3)]
            p = [math.exp(v - max(score)) for v in score]
            for i, v in zip(idx.tolist(), x):
                for c in range(3):
                    g = v * (p[c] / sum(p) - (c == y))
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / s.alpha
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    got = language_id.ftrl(examples, 3, s)
    assert np.allclose(got[:50], [[weight((i, c)) for c in range(3)] for i in range(50)], atol=1e-6) and not got[50:].any()


def test_temperature_is_the_best():
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 300)
    logits = rng.normal(size=(300, 3)) * 4
    logits[np.arange(300), y] += 3
    t = language_id.temperature(logits, y)
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(300), y]).mean()
    assert all(loss(t) <= loss(t * f) + 1e-6 for f in (0.5, 0.9, 1.1, 2)) and t > 1


def test_the_sample_is_bounded_by_rows(spark, texts, monkeypatch):
    """Rows of one id are no way around the bound, and rare languages beyond the most are not learned."""
    many = texts.union(texts.filter("doc_id = 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).withColumn("text", F.concat("text", F.lit(" "), F.col("n").cast("string"))).drop("n"))
    seen = []
    real = language_id.ftrl
    monkeypatch.setattr(language_id, "ftrl", lambda e, c, s: seen.append((len(e), c)) or real(e, c, s))
    language_id.fit(many.filter("lang is not null"), language_id.Settings(sample=20))
    language_id.fit(many, language_id.Settings(total=30))
    language_id.fit(many, language_id.Settings(languages=2))
    assert 40 <= seen[0][0] <= 48 and seen[0][1] == 3 and seen[1][0] <= 24 and seen[2][1] == 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for n in range(500):
        words = prose(rng, rng.randint(20, 200)).split()
        toxic = n % 4 == 0
        for _ in range(max(1, len(words) // 40) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "Filthy!"])
        rows.append((n, " ".join(words), "x"))
        if n % 5 < 3:
            labels.append((n, 1, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "?!", "x"), (None, "vile rotten filthy", "x"), rows[1], rows[1]]
    labels += [(None, 1, 1), (3, None, None), (labels[0][0], 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 500]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    by = {r["doc_id"]: r["predicted"] for r in rows}
    assert by[900] == by[901] == by[902] == 0 and by[None] == 1
    kept = toxicity.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.keep_ordinary(docs, labels.filter("toxic = 0")).count() == docs.count()


def test_toxicity_learns_from_all_labelled_texts(spark):
    rng = random.Random(3)
    abuse = [f"vile{n}" for n in range(8)]
    rows, labels = [], []
    for n in range(1500):
        words = prose(rng, 60).split()
        if n % 5 == 0:
            words[rng.randrange(len(words))] = abuse[n // 5 % 8]
        rows.append((n, " ".join([*words, *words[:20]])))
        labels.append((n, int(n % 5 == 0)))
    rows += [(4000, rows[7][1]), (4001, rows[7][1]), (4002, " ".join(prose(rng, 30).split() * 700 + ["vile3"]))]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (4000, 0), (4001, 0)], "doc_id long, toxic int")
    few, scratch = toxicity.Settings(sample=40), Scratch(spark)
    texts = toxicity.known_texts(docs, labels, few, scratch)
    got = texts.filter("learn").select("text", "toxic").mapInArrow(toxicity.counted, "key long, n0 long, n1 long").agg(F.sum("n0"), F.sum("n1")).first()
    learned = {t: n for n, t in rows[:1500] if zlib.crc32(str(n).encode()) % 5 in (1, 2, 3)}
    assert list(got) == [sum(len(t.split()) for t, n in learned.items() if (n % 5 == 0) == c) for c in (False, True)]
    out = toxicity.toxicity(docs, labels, few).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1500]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.95 * len(held)
    assert {r["doc_id"]: r["predicted"] for r in out}[4002] == 1  # one word at the end of a very long text


@pytest.mark.parametrize("folds", [(1, 2, 3), (4,)])
def test_toxicity_where_a_part_lacks_a_class(spark, labelled, folds):
    docs, labels = labelled
    some = labels.filter(language_id.fold_of().isin(*folds))
    rows = toxicity.toxicity(docs, some).collect()
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 500]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in own) >= 0.9 * len(own)


def test_toxicity_with_several_texts_of_one_id(spark, labelled):
    docs, labels = labelled
    more = docs.union(docs.filter("doc_id = 8").withColumn("text", F.lit("calm words")))
    runs = [sorted((str(r["doc_id"]), r["score"]) for r in toxicity.toxicity(more.repartition(n), labels).collect()) for n in (1, 5)]
    assert [a for a, _ in runs[0]] == [a for a, _ in runs[1]] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(*runs))


def plain_counts(texts):
    """Pairs of words and their counts in ordinary and toxic texts; the first of a text follows a start."""
    out = defaultdict(lambda: [0, 0])
    for text, toxic in texts:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        for pair in zip(["<s>", *words], words):
            out[pair][toxic] += 1
    return out


def plain_model(counts, size, keep):
    """The documented formulas on dictionaries: p(w | h) of each class, for every h and w."""
    d, floor, share = toxicity.DISCOUNT, toxicity.FLOOR, toxicity.BACKOFF
    vocabulary = range(size)
    kinds = [[sum(n[c] > 0 for (_, w), n in counts.items() if w == x) for x in vocabulary] for c in (0, 1)]
    scaled = lambda totals: [min(totals) / max(t, 1) for t in totals]
    g = scaled([sum(k) for k in kinds])
    own = [[max(k - d, 0) * g[c] for k in kinds[c]] for c in (0, 1)]
    top = [[own[c][x] + floor + share * (own[0][x] + own[1][x]) / 2 for x in vocabulary] for c in (0, 1)]
    p = [[x / sum(t) for x in t] for t in top]
    g = scaled([sum(n[c] for n in counts.values()) for c in (0, 1)])
    out = {}
    for h in vocabulary:
        pairs = {w: [max(n[c] - d, 0) * g[c] for c in (0, 1)] for (x, w), n in counts.items() if x == h and (h, w) in keep}
        after = sum((n[0] * g[0] + n[1] * g[1]) / 2 for (x, _), n in counts.items() if x == h)
        rest = after - sum(sum(a) / 2 for a in pairs.values()) + floor
        for c in (0, 1):
            top = {w: a[c] + (floor + share * sum(a) / 2) * p[c][w] / ((p[0][w] + p[1][w]) / 2) for w, a in pairs.items()}
            total = rest + sum(top.values())
            out[c, h] = [(top.get(w, 0.0) + rest * p[c][w]) / total for w in vocabulary]
    return out


def test_kneser_ney_as_on_dictionaries(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 40)
    rng = random.Random(9)
    counts = defaultdict(lambda: [0, 0])
    for _ in range(3000):
        c = int(rng.random() < 0.2)
        counts[min(39, int(rng.expovariate(0.15))), min(39, int(rng.expovariate(0.1)) + c)][c] += 1
    pairs = sorted(counts)
    key = np.array([(h << 20) | w for h, w in pairs])
    n = np.array([counts[x] for x in pairs]).T
    kinds = np.stack([np.bincount(key[n[c] > 0] & 1048575, minlength=40) for c in (0, 1)]).astype(float)
    after = np.stack([np.bincount(key >> 20, n[c], 40) for c in (0, 1)])
    words = toxicity.Words.of(kinds, after)
    keep = np.array([k % 3 > 0 for k in range(len(key))])
    want = plain_model(counts, 40, {x for x, k in zip(pairs, keep) if k})
    top, total = toxicity.levels(words, key[keep], n[:, keep])
    rest = toxicity.rest_of(words, key[keep], words.parts(key[keep], n[:, keep])[0])
    model = toxicity.Model.of(words, key[keep], n[:, keep])
    at = {int(k): i for i, k in enumerate(key[keep])}
    for h in range(40):
        for c in (0, 1):
            got = [(top[c, at[h << 20 | w]] if h << 20 | w in at else rest[h] * words.p[c, w]) / total[c, h] for w in range(40)]
            assert abs(sum(got) - 1) < 1e-9 and np.allclose(got, want[c, h])
        ratio = model.ratios(np.arange(40), np.full(40, h))
        assert np.allclose(ratio, np.log(np.array(want[1, h]) / np.array(want[0, h])))


def test_pairs_are_counted_at_every_place(spark):
    texts = [("a b a b c", 0), ("b a B", 1), (None, 1), ("", 0), ("b a b", 1)]
    rows = spark.createDataFrame(texts, "text string, toxic int").coalesce(1).mapInArrow(toxicity.counted, "key long, n0 long, n1 long").collect()
    assert sorted((r["n0"], r["n1"]) for r in rows) == sorted(tuple(x) for x in plain_counts(texts).values())


def test_few_pairs_matter():
    """Twice the counts keep about the same pairs: the bound does not grow with the input."""
    rng = np.random.default_rng(4)
    sizes = []
    for scale in (1, 4):
        h, w = rng.zipf(1.3, (2, 200_000 * scale)) % 20_000
        toxic = rng.random(len(h)) < 0.2
        key, n = toxicity.added([(h << 20) | w], [np.stack([~toxic, toxic]).astype(np.int64)])
        kinds = np.stack([np.bincount(key[n[c] > 0] & 1048575, minlength=toxicity.WORDS) for c in (0, 1)]).astype(float)
        words = toxicity.Words.of(kinds, np.stack([np.bincount(key >> 20, n[c], toxicity.WORDS) for c in (0, 1)]))
        sizes.append((len(key), int(words.matter(key, n).sum())))
    assert sizes[1][0] > 2 * sizes[0][0] and sizes[1][1] <= 2 * sizes[0][1]
