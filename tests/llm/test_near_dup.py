import re
from collections import Counter

import numpy as np
import pytest

from foliant.llm import near_dup
from foliant.llm.shared import Scratch, ship

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOW))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], len(s), least.get(find(i)) if s else r["doc_id"]) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("small, levels, heavy", [(128, 6, 1 << 22), (4, 2, 1 << 22), (6, 3, 500)])
def test_as_brute_force(documents, monkeypatch, small, levels, heavy):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "HEAVY", heavy)
    monkeypatch.setattr(near_dup, "LEVELS", levels)
    got = near_dup.near_duplicates(documents).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(documents.collect())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def sets_with_a_passage(n, seed=1):
    """Sets of 130 common and 40 own tokens; every tenth is a copy of the one before with a few tokens changed."""
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    out = []
    for k in range(n):
        x = np.concatenate([passage, rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
        if k % 10 == 9:
            x = np.concatenate([out[-1][:-(k % 20)], x[-(k % 20):]])
        out.append(np.unique(x))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_a_common_passage_makes_no_pairs(spark, monkeypatch, block):
    """Documents that share most of their text but not enough of it: what meets grows with them, not with their pairs."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    ship(spark)
    rows = {}
    for n in (500, 1000, 2000) if block > 3 else (300,):
        sets = sets_with_a_passage(n)
        names = [k.to_bytes(16, "big") for k in range(n)]
        held = spark.createDataFrame([(f, x.tobytes()) for f, x in zip(names, sets)], "fp binary, hashes binary")
        members = spark.createDataFrame([(f, f, len(x)) for f, x in zip(names, sets)], "fp binary, root binary, n long")
        scratch = Scratch(spark)
        led = near_dup.led_by_rarest(members, held, 75, scratch)
        largest = led.groupBy("token", "block").count().agg({"count": "max"}).first()[0] or 0
        pairs = near_dup.branched_by_rarest(members, held, 75, scratch)
        got = {(bytes(r["a"]), bytes(r["b"])) for r in near_dup.confirmed(pairs, held, 75).collect()}
        rows[n] = (led.count(), largest, pairs.count())
        if n <= 500:
            plain = [set(x.tolist()) for x in sets]
            want = {(names[i], names[j]) for i in range(n) for j in range(i + 1, n) if 100 * len(plain[i] & plain[j]) >= 75 * len(plain[i] | plain[j])}
            assert got == want and len(want) >= n // 10
        scratch.drop()
    if block > 3:
        assert all(rows[2 * n][0] <= 2.6 * rows[n][0] and rows[2 * n][1] <= 2.6 * rows[n][1] and rows[2 * n][2] <= 2.6 * rows[n][2] for n in (500, 1000)), rows


def test_sets_that_meet_but_differ_make_no_pairs(spark):
    """A group of copies that have drifted apart meets at its rarest tokens; bitmaps leave only what is nearly a link."""
    ship(spark)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, 150, replace=False)) for _ in range(80)]
    sets += [np.unique(np.append(x[: 149 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64))) for k, x in enumerate(sets[:22])]
    names = [k.to_bytes(16, "big") for k in range(len(sets))]
    held = spark.createDataFrame([(f, x.tobytes()) for f, x in zip(names, sets)], "fp binary, hashes binary")
    members = spark.createDataFrame([(f, f, len(x)) for f, x in zip(names, sets)], "fp binary, root binary, n long")
    scratch = Scratch(spark)
    pairs = near_dup.branched_by_rarest(members, held, 75, scratch)
    made, got = pairs.count(), {(bytes(r["a"]), bytes(r["b"])) for r in near_dup.confirmed(pairs, held, 75).collect()}
    plain = [set(x.tolist()) for x in sets]
    alike = {(i, j): len(plain[i] & plain[j]) / len(plain[i] | plain[j]) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    assert got == {(names[i], names[j]) for (i, j), x in alike.items() if x >= 0.75} and len(got) >= 18
    assert made <= sum(x >= 0.65 for x in alike.values()) < len(alike) / 4, made
    scratch.drop()


def test_clashing_names(spark):
    """Columns named like the outputs and like what the operator adds."""
    text = "one two three four five six seven"
    rows = [(1, text, 1, 2, 3, 4), (1, text, 9, 2, 3, 4), (2, text, 5, 6, 7, 8), (3, "other", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, component_id int, fp int, n_shingles int")
    runs = [sorted(near_dup.one_of_each(docs.repartition(n)).collect()) for n in (1, 4)]
    assert runs[0] == runs[1] and [r["doc_id"] for r in runs[0]] == [1, 3] and runs[0][0].asDict().keys() == set(docs.columns)
    assert near_dup.near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_shuffled_sides(documents, monkeypatch):
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", -1)
    rows = near_dup.one_of_each(documents).collect()
    want = {k for k in brute(documents.collect()) if k[0] == k[2]}
    assert Counter(r["doc_id"] for r in rows) == Counter(k[0] for k in want)
    assert set(rows[0].asDict()) == set(documents.columns)


def test_nothing(nothing):
    assert near_dup.near_duplicates(nothing).count() == 0 and near_dup.one_of_each(nothing).count() == 0
