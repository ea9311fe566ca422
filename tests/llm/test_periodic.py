"""Runs by the automaton against every period at every place."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_prose import prose

from foliant.llm.periodic import Positions, of_batch, periodic_runs, run_digest, runs_of, with_planted_runs


def brute(seq, least, times):
    out, n = [], len(seq)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(seq[k] == seq[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([(24, 3), (4, 2), (6, 3), (1, 2), (9, 4)]))
@settings(max_examples=300, deadline=None)
def test_any_runs(seq, least_times):
    assert runs_of(seq, *least_times) == brute(seq, *least_times)


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 6)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_repeats(parts):
    seq = [x for part, n in parts for _ in range(n) for x in part]
    assert runs_of(seq) == brute(seq, 24, 3)


def test_large_sets():
    """More end positions than a block holds, in the orders in which they come."""
    for order in (list(range(3000)), list(range(3000, 0, -1)), random.Random(1).sample(range(10**6), 3000)):
        p, all_ = Positions(order[0]), {order[0]}
        for x in order[1:]:
            before, after = p.add(x)
            all_.add(x)
            if x % 97 == 0:
                assert before == max((y for y in all_ if y < x), default=None) and after == min((y for y in all_ if y > x), default=None)
        assert list(p) == sorted(all_)
    for n, q in ((20_000, 1), (20_000, 3), (30_000, 9_000)):
        assert runs_of([k % q for k in range(n)]) == [(0, n, q)]


def plain(text, least=24, times=3):
    words = text.split()
    runs = brute(words, least, times)
    drop = {k for s, size, q in runs for k in range(s + q, s + size)}
    return len(words), runs, " ".join(w for k, w in enumerate(words) if k not in drop)


def odd_texts():
    rng = random.Random(8)
    line = lambda n: prose(rng, n)
    out = [None, "", " \t\n", "one", " ".join(["a"] * 23), " ".join(["a"] * 24), "\n".join(["a b c"] * 8) + " ", "  " + "a  b\x0bc\x0c" * 9]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [line(rng.randrange(1, 60)), " ".join([line(rng.randrange(1, 30))] * rng.randrange(1, 9))]
        out.append(rng.choice([" ", "\n", " \r\n"]).join(parts))
    same = line(40)
    out += [same + " " + line(300) + " " + same, " ".join([same] * 2), " ".join([same] * 3), " ".join([line(7) + " x"] * 5 + [line(7) + " x"] * 5), " ".join(["x y"] * 12 + ["y"] * 30 + ["é 日"] * 12)]
    return out


def test_texts():
    texts = odd_texts()
    n, runs, cut = of_batch(pa.array(texts))
    got = list(zip(n.tolist(), [sorted(r) for r in runs], pa.concat_arrays(cut).to_pylist()))
    assert got == [plain(t or "") for t in texts]
    assert sum(len(r) for r in runs) > 30


@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=14), st.integers(1, 5)), max_size=5), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_texts(texts):
    """The test before the automaton loses no run, whatever stands around it."""
    texts = [" ".join(x for part, n in t for _ in range(n) for x in part) for t in texts]
    n, runs, cut = of_batch(pa.array(texts, pa.string()))
    got = list(zip(n.tolist(), [sorted(r) for r in runs], pa.concat_arrays(cut).to_pylist() if cut else []))
    assert got == [plain(t) for t in texts]


def test_other_limits():
    texts = odd_texts()
    for least, times in ((4, 2), (10, 2), (40, 5)):
        n, runs, cut = of_batch(pa.array(texts), least, times)
        assert list(zip(n.tolist(), [sorted(r) for r in runs], pa.concat_arrays(cut).to_pylist())) == [plain(t or "", least, times) for t in texts]


def digest(doc_id, text):
    words = (text or "").split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    _, runs, cut = plain(" ".join(words))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(cut))


def test_whole_query(spark):
    rng = random.Random(3)
    texts = odd_texts() + [prose(rng, rng.randrange(1, 120)) for _ in range(150)]
    rows = [(n, t, n, "x") for n, t in enumerate(texts)] + [(None, texts[30], 1, "y"), (30, texts[30], 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, h string").repartition(3)
    got = run_digest(periodic_runs(with_planted_runs(docs))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((digest(d, t) for d, t, _, _ in rows), key=key)
    assert sum(r["n_runs"] for r in got) > 30
    assert run_digest(periodic_runs(with_planted_runs(docs.limit(0)))).count() == 0


def test_long_texts_and_other_columns(spark):
    text = prose(random.Random(2), 30_000)
    docs = spark.createDataFrame([(1, text + " " + " ".join(["a b"] * 50_000), [1.5], 7), (2, " ".join(["w"] * 100_000), None, None)], "doc_id int, text string, `se lf` array<double>, start long")
    a, b = periodic_runs(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in a["runs"]] == [(30_000, 100_000, 2)] and a["collapsed"] == text + " a b" and a["se lf"] == [1.5] and a["start"] == 7
    assert [tuple(r) for r in b["runs"]] == [(0, 100_000, 1)] and b["collapsed"] == "w"
    with pytest.raises(ValueError, match="runs"):
        periodic_runs(docs.withColumn("runs", docs.start))


def test_as_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from foliant.llm.periodic import oracle, run_digest_of

    rng = random.Random(6)
    texts = odd_texts() + [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(oracle(levels=9))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, run_digest_of(spark, docs).select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
