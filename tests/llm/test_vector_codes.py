"""Codes by bounds against comparing every part with every entry, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import vector_codes as vc
from foliant.llm.vector_codes import code_digest, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = -(-max((len(r[1]) for r in kept), default=0) // parts)
    ints = [[n * scale // d for n, d in (float(x).as_integer_ratio() for x in [*r[1], *[0.0] * (step * parts - len(r[1]))])] for r in kept]
    out, sums, text = [["", 0] for _ in kept], {}, []
    for p in range(parts):
        own = [v[p * step : (p + 1) * step] for v in ints]
        book = own[:entries]
        for k in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book)) for x in own]
            if k < rounds:
                for e in range(len(book)):
                    if mine := [x for x, (_, f) in zip(own, near) if f == e]:
                        book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        for o, (d, e) in zip(out, near):
            o[0] += f"{e:02x}"
            o[1] += d
        text += [str(v) for c in book for v in c]
    sha = hashlib.sha256(",".join(text).encode()).hexdigest()
    for r, o in zip(kept, out):
        sums[r[2]] = sums.get(r[2], 0) + o[1]
    most = vc.LARGEST
    return [(r[0], code, min(error, most), min(most, sum(min(o[1], most) for q, o in zip(kept, out) if q[2] == r[2])), sha) for r, (code, error) in zip(kept, out)]


def check(spark, rows, schema=SCHEMA):
    got = code_digest(spark.createDataFrame(rows, schema).repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def vectors(n, d, seed, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    x = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, d)) * 0.3
    return np.round(x * 2) / 256 if ties else x


def test_clusters(spark):
    check(spark, [(n * 3, v.tolist(), "abc"[n % 3] if n % 4 else None) for n, v in enumerate(vectors(700, 32, 1))])


def test_ties(spark):
    """Few distinct integers: many parts are as near to two entries, and entries are equal."""
    check(spark, [(n, v.tolist(), "a") for n, v in enumerate(vectors(400, 16, 2, True))])
    check(spark, [(n % 50, v.tolist(), str(n % 2)) for n, v in enumerate(vectors(300, 48, 3, True))])


def test_odd_rows(spark):
    rng = random.Random(5)
    own = lambda n: [rng.uniform(-2, 2) for _ in range(n)]
    rows = [(n, own(rng.choice([32, 32, 32, 7, 0, 33])), rng.choice(["a", None])) for n in range(150)]
    rows += [(None, own(32), "a"), (None, own(32), None), (3, own(32), "a"), (200, None, "a"), (201, [1.0, None], "a"), (202, [math.nan] * 32, "b"), (203, [math.inf, 1.0], "b"), rows[5], rows[5]]
    check(spark, rows)
    check(spark, rows[:20])
    check(spark, [(1, [0.5] * 16, None)])
    check(spark, [(1, [], "a"), (2, [], "b")])
    check(spark, [(1, None, "a")])
    check(spark, [])


@pytest.mark.parametrize("size", [1e7, 1e14, 1e20, 1.7e308])
def test_large_components(spark, size):
    rng = random.Random(6)
    rows = [(n, [rng.uniform(-1, 1) * (size if rng.random() < 0.2 or n > 80 else 1) for _ in range(32)], "ab"[n % 2]) for n in range(100)]
    check(spark, rows)
    check(spark, [(-n, v, label) for n, v, label in rows])


def test_other_columns_and_kinds(spark):
    rows = [(n, v.tolist(), n % 2, "x", 1) for n, v in enumerate(vectors(90, 32, 4))]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int, code string, id int")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert sorted(map(tuple, code_digest(df).collect())) == sorted(brute(rows))


def test_bounds_save_comparisons(spark):
    """After the first round most parts keep their entry without being compared with all."""
    df = spark.createDataFrame([(n, v.tolist(), "a") for n, v in enumerate(vectors(3000, 32, 7))], SCHEMA)
    codes, books, drop = vector_codes(df, rounds=4, entries=16)
    scans = codes.agg(F.avg("scans")).first()[0]
    assert 16 <= scans < 0.7 * 16 * 5
    assert sorted(r["code"] for r in codes.collect()) == sorted(r[1] for r in brute([(r["vec_id"], r["embedding"], "a") for r in df.collect()], entries=16, rounds=4))
    paths = codes.inputFiles()
    drop()
    assert paths and not any(spark._jvm.java.io.File(p.removeprefix("file:")).exists() for p in paths)


def test_as_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(n, v.tolist(), n % 5 if n % 7 else None) for n, v in enumerate(vectors(300, 48, 8))] + [(900, None, 1), (901, [math.nan] * 48, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.sql(vc.oracle())
    got = code_digest(df).select(*want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)
