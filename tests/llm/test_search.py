import math

import numpy as np
import pytest

from foliant.llm import ann, topk


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)) * rng.uniform(0.5, 2, (400, 1))
    x[50:90] = x[0]  # copies, which tie
    rows = [(n, v.tolist(), 1) for n, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [float("nan")] * 16, 1), (1040, [None, *[1.0] * 15], 1), (1060, [math.inf, *[0.0] * 15], 1), (1080, [0.0] * 16, 1), (1100, [1.0, 2.0], 1), (None, [1.0] * 16, 1), rows[7], rows[20]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)


def lists(rows, score=lambda x: x):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], score(r["score"])))
    return out


def test_neighbours(spark, vectors):
    got = lists(ann.nearest(vectors, 10, 20).collect())
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.collect() if r["vec_id"] is not None and r["vec_id"] < 1000]
    hit = total = 0
    assert sorted(got) == sorted({i for i, _ in rows if i % 20 == 0})
    for q, own in got.items():
        v = next(v for i, v in rows if i == q)
        want = sorted({(-float(v @ w), i) for i, w in rows if i != q})[:10]
        assert [s for _, s in own] == sorted((s for _, s in own), reverse=True) and len(own) == 10
        for i, s in own:
            assert s == pytest.approx(float(v @ next(w for j, w in rows if j == i)), rel=1e-12)
        hit += len({i for i, _ in own} & {i for _, i in want})
        total += 10
    assert hit / total >= 0.9
    copies = [i for i, _ in got[60] if i == 0 or 50 <= i < 90]  # of the query's own vector: the smallest ids, ascending
    assert copies == [0, *range(50, 60), *range(61, 90)][: len(copies)]


def recall_of(spark, x, k=10, every=20):
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = lists(ann.nearest(df, k, every).collect())
    hit = 0
    for q, own in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hit += len({i for i, _ in own} & set(np.lexsort((np.arange(len(x)), -score))[:k].tolist()))
    assert sorted(got) == list(range(0, len(x), every))
    return hit / (k * len(got))


@pytest.mark.parametrize("kind", ["one long vector", "lengths of all sizes", "tiny and huge"])
def test_neighbours_of_all_lengths(spark, kind):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1200, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "one long vector":
        x[17] *= 1000
    elif kind == "lengths of all sizes":
        x *= np.exp(rng.normal(size=len(x)))[:, None]
    else:
        x[::2] *= 1e-150
        x[1::6] *= 1e120
    assert recall_of(spark, x) >= 0.9


def test_shells(spark):
    steps = [40, 39, 33, 32, 3, 2, -400]
    rows = spark.createDataFrame([(n, s) for n, s in enumerate(steps)], "id long, step int")
    assert [(low, high, size) for low, high, _, size in ann.shells_of(rows)] == [(33, 40, 3), (25, 32, 1), (-4, 3, 2), (-407, -400, 1)]


def brute_lists(rows, k, every):
    """Every query's k best by comparing all, in Python's own order of scores and ids."""
    rows, out = sorted(dict(rows).items()), {}
    for q, x in rows:
        if q % every == 0:
            out[q] = [i for _, i in sorted((-float(np.dot(x, y)), i) for i, y in rows if i != q)[:k]]
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_low_recall_is_answered_exactly(spark, vectors, monkeypatch, block):
    """Where the search cannot find what comparing all finds, all are compared."""
    monkeypatch.setattr(ann, "BLOCK", block)
    some = vectors.filter("vec_id between 0 and 399")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in some.collect()]
    got = {q: [i for i, _ in v] for q, v in lists(ann.nearest(some, 10, 20, ann.Settings(links=1, sample=1, rounds=0, steps=0, again=1)).collect()).items()}
    want = brute_lists(rows, 10, 20)
    assert got.keys() == want.keys() and len(got) == 20
    same = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert same > 0.999  # equal but for scores that differ in their last bits


def test_no_wider_search_that_costs_more_than_all(spark, vectors, monkeypatch):
    calls, search = [], ann.greedy_search
    monkeypatch.setattr(ann, "greedy_search", lambda *a: calls.append(a[6]) or search(*a))
    some = vectors.filter("vec_id < 200")
    got = lists(ann.nearest(some, 10, 20, ann.Settings(links=1, sample=1, rounds=0, steps=0, again=3)).collect())
    assert len(set(calls)) == 1 and len(calls) <= 2, calls  # in the query's own shell, and in the others
    assert all(len(v) == 10 for v in got.values())


def test_ids_below_zero(spark):
    x = np.random.default_rng(8).normal(size=(90, 8))
    df = spark.createDataFrame([(n - 60, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = lists(ann.nearest(df, 5, 20).collect())
    assert sorted(got) == [-60, -40, -20, 0, 20]
    for q, own in got.items():
        score = x @ x[q + 60]
        score[q + 60] = -np.inf
        assert [i + 60 for i, _ in own] == np.argsort(-score)[:5].tolist()


def test_lengths_that_differ_much(spark):
    """Vectors of many directions whose lengths are log-normal: every query has its 20, whichever way they are found."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 96)) * np.exp(rng.normal(size=(1200, 1)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q: [i for i, _ in v] for q, v in lists(ann.nearest(df, 20, 20).collect()).items()}
    want = brute_lists(list(enumerate(x)), 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9


def test_few_and_none(spark, vectors):
    few = vectors.filter("vec_id < 3")
    assert {q: [i for i, _ in v] for q, v in lists(ann.nearest(few, 10, 1).collect()).items()}.keys() == {0, 1, 2}
    assert ann.nearest(vectors.filter("vec_id = 1000"), 10, 20).count() == 0
    assert ann.nearest(vectors.filter("vec_id = 0"), 10, 20).count() == 0
    assert topk.top_k(topk.vector_entries(vectors.filter("vec_id > 5000")), topk.vector_entries(vectors.filter("vec_id > 5000")), 3).count() == 0


@pytest.mark.parametrize("shard, block", [(8192, 2048), (64, 4)])
def test_top_k(spark, vectors, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    e = topk.vector_entries(vectors)
    got = lists(topk.top_k(e, e.filter("id % 20 = 0"), 12).withColumnRenamed("id", "vec_id").collect())
    rows = []
    for r in vectors.collect():
        if r["vec_id"] is not None and r["embedding"] is not None and all(v is not None and math.isfinite(v) for v in r["embedding"]):
            x = [math.floor(64 * v) for v in r["embedding"]]
            rows.append((r["vec_id"], np.array(x + [0] * (16 - len(x)), np.int64)))
    rows = dict(rows)  # a repeated row counts once
    for q in {i for i in rows if i % 20 == 0}:
        want = sorted((-int(rows[q] @ w), i) for i, w in rows.items() if i != q)[:12]
        assert got[q] == [(i, -s) for s, i in want]


def test_impacts_of_any_size(spark, monkeypatch):
    """Components whose products leave 64 bits are scored and ranked exactly."""
    monkeypatch.setattr(topk, "SHARD", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    x[::7] *= 1e12
    x[::11] *= 1e40
    x[3], x[4] = [1e12, 0, 0, 0, 0, 1], [0.05, 1, 0, 0, 0, 1]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    e = topk.vector_entries(df)
    got = lists(topk.top_k(e, e.filter("id % 5 in (0, 4)"), 8).withColumnRenamed("id", "vec_id").collect())
    whole = [[math.floor(64 * c) for c in v] for v in x.tolist()]
    dot = lambda a, b: sum(p * q for p, q in zip(whole[a], whole[b]))
    assert dot(4, 3) > 2**40 and abs(dot(11, 22)) > 2**64
    for q in (n for n in range(90) if n % 5 in (0, 4)):
        want = sorted((-dot(q, i), i) for i in range(90) if i != q)[:8]
        assert got[q] == [(i, min(max(-s, -(2**63)), 2**63 - 1)) for s, i in want]


def test_rows_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 9.0]), (2, [0.5, 0.0])]
    for n in (1, 3):
        e = topk.vector_entries(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n))
        assert [tuple(r) for r in topk.top_k(e, e.filter("id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 1, 2 * 64 * 64), (0, 2, 2, 32 * 64)]


def test_clusters_visit_few_shards(spark, monkeypatch):
    """On vectors in clusters the (query, shard) pairs grow with the vectors, not with their square."""
    monkeypatch.setattr(topk, "SHARD", 50)
    visits = {}
    held = topk.answered
    for n in (1000, 2000):
        rng = np.random.default_rng(n)
        centre = rng.normal(size=(n // 50, 16)) * 3
        x = centre[np.arange(n) % len(centre)] + rng.normal(size=(n, 16)) * 0.05
        e = topk.vector_entries(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
        asked = []
        monkeypatch.setattr(topk, "answered", lambda a, b, k: asked.append(b.count()) or held(a, b, k))  # noqa: B023
        got = lists(topk.top_k(e, e.filter("id % 20 = 0"), 10).withColumnRenamed("id", "vec_id").collect())
        whole = np.floor(64 * x).astype(np.int64)
        for q in range(0, n, 100):
            score = whole @ whole[q]
            want = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:10]
            assert got[q] == [(i, -s) for s, i in want]
        visits[n] = sum(asked) / (n // 20)
    shards = 2000 // 50
    assert visits[2000] < 0.5 * shards and visits[2000] <= 2 * visits[1000], visits


def test_sparse_terms(spark):
    rng = np.random.default_rng(1)
    rows = [(n, sorted(rng.choice(40, 5, replace=False).tolist()), rng.integers(-3, 9, 5).tolist()) for n in range(700)]
    df = spark.createDataFrame(rows + [(900, [1, 2], [1]), (901, [], [])], "id long, terms array<int>, impacts array<long>")
    got = {}
    for r in topk.top_k(df, df.filter("id % 100 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    flat = {i: dict(zip(t, w)) for i, t, w in rows} | {901: {}}
    for q in range(0, 700, 100):
        want = sorted((-sum(w * d.get(t, 0) for t, w in flat[q].items()), i) for i, d in flat.items() if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in want]


def test_a_search_keeps_one_state(spark, vectors, monkeypatch):
    """What a step has written and shuffled goes before the next one's is added to it."""
    live, most = set(), []

    class Watched(ann.Scratch):
        def __call__(self, df, name):
            out = super().__call__(df, name)
            if name == "state":
                live.add(self.paths[-1])
                most.append(len(live))
            return out

        def inner(self):
            self.parts.append(Watched(self.spark))
            return self.parts[-1]

        def drop(self):
            live.difference_update(self.paths)
            super().drop()

    monkeypatch.setattr(ann, "Scratch", Watched)
    got = ann.nearest(vectors.filter("vec_id < 300"), 5, 20, ann.Settings(links=8, sample=4, recall=0.0)).collect()
    assert got and max(most) < len(most) and not live
