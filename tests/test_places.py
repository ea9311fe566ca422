"""Offset maps and near windows against plain implementations."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions.approx import Pattern, most_errors, near_windows, plain_places
from foliant.functions.offsets import EVERY, OffsetMap, compared_ranges, offset_map
from foliant.functions.text import normalize

RAW = st.one_of(st.text(alphabet="aB- \n\tÉß“’–­ ", max_size=60), st.text(alphabet="a -\nﬁé́ΣΑ　­", max_size=40), st.text(max_size=40))


@given(RAW)
@settings(max_examples=250, deadline=None)
def test_ranges_are_those_of_normalize(raw):
    n = normalize(raw)
    text, starts, ends = compared_ranges(raw)
    assert (text, starts.tolist(), ends.tolist()) == (n.text, n.starts, n.ends)


@given(RAW, st.integers(1, 9))
@settings(max_examples=120, deadline=None)
def test_maps(raw, times):
    raw *= times
    n, m = normalize(raw), OffsetMap(offset_map(raw))
    assert m.size == len(n.starts)
    # Every character, and stretches of characters: maps are about whole ones.
    bounds = [k for k in range(len(n.starts) + 1) if k == len(n.starts) or n.text.encode()[k] & 0xC0 != 0x80]
    for i in range(len(bounds) - 1):
        for j in (i + 1, min(i + 7, len(bounds) - 1), len(bounds) - 1):
            if j > i:
                assert m.source_range(bounds[i], bounds[j]) == n.source_range(bounds[i], bounds[j]), (bounds[i], bounds[j])
    assert m.source_range(0, 0) is None and m.source_range(0, m.size + 1) is None and m.source_range(-1, 1) is None


def test_maps_are_small():
    rng = random.Random(1)
    raw = "".join(rng.choice(["word ", "two  ", "naïve ", "x-\ny ", "“so” "]) for _ in range(20_000))
    m = offset_map(raw)
    n = normalize(raw)
    assert len(m) < 3 * OffsetMap(m).n < len(raw) and OffsetMap(m).n > 10 * EVERY  # less than three bytes a run
    for _ in range(300):
        a = rng.randrange(len(n.text) - 1)
        b = rng.randrange(a + 1, min(len(n.text), a + 50) + 1)
        i, j = len(n.text[:a].encode()), len(n.text[:b].encode())
        assert OffsetMap(m).source_range(i, j) == n.source_range(i, j)
    assert len(offset_map("plain words " * 10_000)) < 40


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@given(st.text(alphabet="ab ", min_size=1, max_size=90), st.text(alphabet="ab ", max_size=40))
@settings(max_examples=80, deadline=None)
def test_distances(pattern, text):
    assert list(Pattern(pattern).distances(iter(text), True)) == [distance(pattern, text[:k]) for k in range(1, len(text) + 1)]
    assert list(Pattern(pattern).distances(iter(text), False)) == [min(distance(pattern, text[i:k]) for i in range(k + 1)) for k in range(1, len(text) + 1)]


def brute(text, pattern, most):
    starts = [i for i in range(len(text)) if text[i] != " " and (i == 0 or text[i - 1] == " ")]
    ends = [j for j in range(1, len(text) + 1) if text[j - 1] != " " and (j == len(text) or text[j] == " ")]
    near = [(i, j, d) for i in starts for j in ends if i < j and (d := distance(text[i:j], pattern)) <= most]
    return [x for x in near if x[2] == min(y[2] for y in near)]


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=4), max_size=14), st.lists(st.text(alphabet="abc", min_size=1, max_size=4), min_size=1, max_size=5), st.integers(0, 6))
@settings(max_examples=80, deadline=None)
def test_near_windows(words, pattern, most):
    assert near_windows(" ".join(words), " ".join(pattern), most) == brute(" ".join(words), " ".join(pattern), most)


def test_planted_windows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    for _ in range(25):
        words = [word() for _ in range(14)]
        i = rng.randrange(6)
        pattern = list(" ".join(words[i : i + 8]))
        most = most_errors(len(pattern))
        for _ in range(rng.randrange(most + 2)):
            k = rng.randrange(len(pattern))
            rng.choice([lambda: pattern.__setitem__(k, "z"), lambda: pattern.pop(k), lambda: pattern.insert(k, "q")])()
        assert near_windows(" ".join(words), "".join(pattern), most) == brute(" ".join(words), "".join(pattern), most)


@pytest.mark.parametrize("text, piece, want", [("aaaa", "aa", [0, 2]), ("a.b.a", ".", [1, 3]), ("", "a", []), ("a", "", [])])
def test_plain_places(text, piece, want):
    assert plain_places(text, piece) == want


def test_errors():
    assert [most_errors(n) for n in (1, 20, 21, 100, 101, 140)] == [1, 1, 2, 5, 6, 7]


# over tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_places_of_quotes(spark):
    from foliant.operators.places import chosen, places

    text = "One two. The wind-\nmill turns — slowly.  One two; the WINDMILL turns - slowly, one two"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "naïve ﬁsh “swim” far away from the cold northern shores of this land")], "doc_id long, text string")
    asked = [
        (1, 1, "One two", ""), (2, 1, "One two", "slowly. "), (3, 1, "one  TWO", "slowly, "), (4, 1, "windmill turns – slowly", ""), (5, 1, "windmill tuns - slowly", "x"),
        (6, 1, "unknown words", ""), (7, 2, "One", ""), (8, 9, "One", ""), (9, 4, "fish \"swim\" far", "naive"), (10, 4, "fish swim far away from the cold northen shores of this", "naïve"),
        (11, 1, "", ""), (12, 1, None, ""), (13, 1, " \n ", None), (14, 3, "a", None),
    ]
    q = spark.createDataFrame(asked, "quote_id long, doc_id long, quote string, before string")
    got = {r["quote_id"]: r for r in chosen(places(docs, q)).collect()}
    raw = {1: text.encode(), 4: docs.filter("doc_id = 4").first()["text"].encode()}
    said = {k: (r["state"], r["errors"], raw[r["doc_id"]][r["raw_start"] : r["raw_end"]].decode(), r["n_places"]) for k, r in got.items()}
    assert said == {
        1: ("exact", 0, "One two", 2), 2: ("exact", 0, "One two", 2), 3: ("normalized", 0, "one two", 3), 4: ("normalized", 0, "wind-\nmill turns — slowly", 2),
        5: ("fuzzy", 2, "wind-\nmill turns — slowly.", 2), 9: ("normalized", 0, "ﬁsh “swim” far", 1), 10: ("fuzzy", 3, "ﬁsh “swim” far away from the cold northern shores of this", 1),
    }
    assert got[2]["position"] == text.rindex("One two;") and got[1]["position"] == 0
    # As many quotes as it takes to deal a document to several rows.
    many = spark.range(1000).selectExpr("id AS quote_id", "1L AS doc_id", "'the WINDMILL' AS quote", "'x' AS before")
    assert chosen(places(docs, many)).filter("state = 'exact' and n_places = 1").count() == 1000
    assert places(docs.limit(0), q).count() == places(docs, q.limit(0)).count() == 0


def test_raw_ranges(spark):
    from foliant.operators.places import raw_ranges

    docs = spark.createDataFrame([(1, "Ab  wind-\nmill éﬁ “x”"), (2, None)], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 0, 2, "a"), (1, 3, 8, "b"), (1, 12, 3, "c"), (1, 16, 3, "d"), (1, 18, 9, "e"), (1, 3, 0, "f"), (2, 0, 1, "g"), (3, 0, 1, "h")], "doc_id long, position long, size long, tag string")
    got = rows(raw_ranges(hits, docs).select("tag", "raw_start", "raw_end", "raw"), "tag")
    assert got == [("a", 0, 2, "Ab"), ("b", 4, 14, "wind-\nmill"), ("c", 15, 20, "éﬁ"), ("d", 21, 28, "“x”"), ("e", None, None, None), ("f", None, None, None), ("g", None, None, None)]


def test_quotes_over_page_breaks(spark):
    from foliant.operators.texts import verified

    pages = [(1, 0, "i", "Alpha beta gam-"), (1, 1, "ii", "ma delta"), (1, 2, "iii", ""), (1, 3, "iv", "epsilon zeta alpha beta"), (2, 0, None, None), (2, 1, "x", "é alpha")]
    p = spark.createDataFrame(pages, "doc_id long, page int, label string, text string")
    asked = [(1, 1, "gamma", None), (2, 1, "beta gamma delta", "ii"), (3, 1, "delta epsilon", "ii"), (4, 1, "alpha BETA", "iv"), (5, 1, "alpha beta", "x"), (6, 1, "Alpha beta gamma delta epsilon zeta", "iii"), (7, 1, "zeta eta", "i"), (8, 2, "É Alpha", "x"), (9, 7, "alpha", None), (10, 1, None, None), (11, 1, "beta gamma delta epsilno zeta alpha", "iv")]
    q = spark.createDataFrame(asked, "quote_id long, doc_id long, quote string, hint string")
    want = [(1, "found", 0, 1), (2, "found", 0, 1), (3, "found", 1, 3), (4, "found", 3, 3), (5, "found_elsewhere", 0, 0), (6, "found", 0, 3), (7, "not_found", None, None), (8, "found", 1, 1), (9, "not_found", None, None), (10, "not_found", None, None), (11, "not_found", None, None)]
    assert rows(verified(p, q), "quote_id") == want
    assert rows(verified(p, q, 0.05), "quote_id") == [*want[:-1], (11, "found", 0, 3)]


def test_near_boxes(spark):
    from foliant.operators.spans import boxes_near

    rng = random.Random(7)
    place = lambda: rng.choice([rng.uniform(-30, 30), float(rng.randrange(-5, 6)), 12.0])
    a = [(rng.randrange(2), k, place(), place()) for k in range(120)] + [(0, 500, None, 1.0), (0, 501, float("nan"), 1.0)]
    b = [(rng.randrange(2), place(), place()) for _ in range(150)] + [(0, 12.0, 12.0)] * 400 + [(0, None, 1.0)]
    got = boxes_near(spark.createDataFrame(a, "g int, k int, left double, top double"), spark.createDataFrame(b, "g int, left double, top double"), ["g"], 6.0).collect()
    want = []
    for g, k, x, y in a[:-2]:
        near = [abs(x - p) + abs(y - q) for h, p, q in b if h == g and p is not None and abs(x - p) < 6 and abs(y - q) < 6]
        if near:
            want.append((g, k, len(near), min(near)))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60


@pytest.mark.parametrize("pairs", [1, 1 << 20])
def test_near_boxes_in_rows(spark, monkeypatch, pairs):
    from foliant.operators import spans

    monkeypatch.setattr(spans, "PAIRS", pairs)
    rng = random.Random(8)
    place = lambda: rng.choice([rng.uniform(-30, 30), float(rng.randrange(-5, 6)), 12.0, 1e300, -1e17])
    rows = [(g, [(k, place(), place()) for k in range(g * 40)] + [(500, None, 1.0), (501, float("nan"), 1.0), (502, float("inf"), 12.0)], [(place(), place()) for _ in range(g * 50)] + [(12.0, 12.0)] * 300 + [(None, 1.0)]) for g in range(3)] + [(7, [], [(1.0, 1.0)]), (8, [(1, 1.0, 1.0)], []), (9, None, [(1.0, 1.0)])]
    frame = spark.createDataFrame(rows, "g int, a array<struct<k:int,left:double,top:double>>, b array<struct<left:double,top:double>>").repartition(2)
    got = spans.boxes_near_in_rows(frame, 6.0).collect()
    want = []
    for g, a, b in rows[:3]:
        for k, x, y in a[:-3]:
            near = [abs(x - p) + abs(y - q) for p, q in b if p is not None and abs(x - p) < 6 and abs(y - q) < 6]
            if near:
                want.append((g, k, len(near), min(near)))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60


@pytest.mark.parametrize("name", ["near_boxes", "span_join", "spans_with_text", "bbox_union"])
def test_spans_are_set_in_rows(spark, tmp_path, name):
    """No words are shuffled to set them, to join them or to find what is near them."""
    from foliant.plans.queries import QUERIES

    spark.createDataFrame([(1, "a word\nof two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan and ("Aggregate" not in plan or name == "bbox_union")


def test_lines_are_pages_in_rows(spark, tmp_path):
    """documents_of_spans groups its pages once; its words are not shuffled."""
    from foliant.plans.queries import QUERIES

    spark.createDataFrame([(1, "a word\nof two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["documents_of_spans"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan


def test_window_agreement(spark):
    from foliant.operators.wording import window_agreement

    rng = random.Random(9)
    words = lambda n: [rng.choice("aa ba ca ab a b".split()) for _ in range(n)]
    rows = []
    for d in range(30):
        w = words(rng.choice([0, 1, 2, 5, 7, 8, 9, 30, 90]))
        rows += [(d, "x", " ".join(w)), (d, "y", " ".join(rng.choice([v, v, v, v, v + "b", "a" + v]) for v in w)), (d, "z", " ".join(w[:-1] + ["q"] + w[3:]))]
    rows += [(99, "x", None), (99, "y", "a"), (100, "x", "alone")]
    got = {(r["doc_id"], r["reference"], r["other"]): r["percent"] for r in window_agreement(spark.createDataFrame(rows, "doc_id long, tool string, text string")).collect()}
    want = {}
    for d, a, t in rows:
        for e, b, u in rows:
            if d == e and a != b:
                if t is None or u is None:
                    want[d, a, b] = 0.0
                    continue
                w = t.split(" ")
                starts = [i * 7919 % max(len(w) - 8, 1) for i in range(200)]
                want[d, a, b] = sum(" ".join(w[i : i + 8]) in u for i in starts) * 100 / 200
    assert got == want and len(set(want.values())) > 5


def test_windows_meet_in_a_row(spark):
    """Two texts meet whole: no rows are made of their words, which were shuffled."""
    from foliant.operators.wording import window_agreement

    texts = spark.createDataFrame([(1, "x", "a b"), (1, "y", "a b")], "doc_id long, tool string, text string")
    assert "Generate" not in window_agreement(texts)._jdf.queryExecution().optimizedPlan().toString()


def test_short_wordings_in_long_texts(spark, monkeypatch):
    from foliant.operators import wording

    monkeypatch.setattr(wording, "LONG", 200)
    monkeypatch.setattr(wording, "SHORT", 50)
    rng = random.Random(10)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.choice([0, 3, 200]))) for _ in range(25)]
    asked = ["ab c", "é", "abc", "cc bb", "zzz", "a" * 30] + [t[k : k + 40].strip() for t in texts[:8] for k in (0, 190, 480)]
    docs, wordings = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    want = sorted((d, i, t.find(w)) for d, t in enumerate(texts) for i, w in enumerate(asked) if w and w in t)
    assert sorted(map(tuple, wording.find_wordings(docs, wordings).collect())) == want
    monkeypatch.setattr(wording, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, wording.find_wordings(docs, wordings).collect())) == want


def test_raw_ranges_read_a_text_once(spark, tmp_path):
    """A hit meets its text in one row, and neither hits nor forms are computed again for a filter or a semi join."""
    from foliant.plans.queries import QUERIES

    spark.createDataFrame([(1, "a word\nof two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["raw_ranges"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1
    assert [tuple(r)[:4] for r in got.collect()] == [(1, 7, 7, 13)]


@pytest.mark.parametrize("name", ["quotes_verified", "quotes_across_pages"])
def test_pages_come_together_once(spark, tmp_path, name):
    from foliant.plans.queries import QUERIES

    spark.createDataFrame([(1, "a word\nof two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(p#") == 1


def test_hints_of_the_quotes_of_a_page(spark):
    from foliant.operators.places import on_pages

    p = spark.createDataFrame([(1, 5, "v", "é x  y"), (1, 7, None, "z-"), (1, 9, "ix", "w é x")], "doc_id long, page long, label string, text string")
    q = spark.createDataFrame([(1, 1, "y zw", "ix"), (2, 1, "É X", "v"), (3, 1, "x", None)], "quote_id long, doc_id long, quote string, hint string")
    got = rows(on_pages(p, q).select("quote_id", "raw_start", "raw_end", "first_page", "last_page", "named"), "quote_id", "raw_start")
    assert got == [(1, 6, 12, 5, 9, True), (2, 0, 4, 5, 5, True), (2, 13, 17, 9, 9, False), (3, 3, 4, 5, 5, False), (3, 16, 17, 9, 9, False)]


def test_quotes_get_their_form_by_whole_strings(monkeypatch):
    """No steps over the characters of simple quotes, no copies of the text before a place, no expression compiled for a quote."""
    import re

    from foliant.operators import places as P

    def none(*_):
        raise AssertionError

    monkeypatch.setattr(P, "normalize", none, raising=False)
    monkeypatch.setattr(re, "finditer", none)
    text = "É  a b " * 3 + "wind-\nmill"
    got = list(P.places_in(text, [{"quote_id": 1, "quote": "É a", "before": "b"}, {"quote_id": 2, "quote": "b É", "before": " a "}, {"quote_id": 3, "quote": "WINDMILL", "before": ""}]))
    assert [(r[0], r[1], *r[3:]) for r in got] == [
        (1, "normalized", 0, 3, 0, 5, False), (1, "normalized", 6, 9, 8, 13, True), (1, "normalized", 12, 15, 16, 21, True),
        (2, "exact", 5, 8, 6, 10, True), (2, "exact", 12, 15, 14, 18, True), (3, "normalized", 18, 26, 24, 34, True),
    ]


def test_a_short_quote_comes_as_one_row(spark):
    """However often it stands there; repeated quotes have a row each time, and their places add up."""
    from foliant.operators import places

    docs = spark.createDataFrame([(1, "de " * 500 + "fin"), (2, "a b")], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, 1, "de", "fin "), (7, 1, "de", "fin "), (8, 1, "fin", "de "), (9, 2, "zz", "")], "quote_id long, doc_id long, quote string, before string")
    rows = places.best_places(docs, quotes).collect()
    assert sorted((r["quote_id"], r["position"], r["n"]) for r in rows) == [(7, 0, 500), (7, 0, 500), (8, 1500, 1)]
    columns = ["quote_id", "doc_id", "state", "errors", "position", "end", "raw_start", "raw_end", "n_places"]
    want = places.chosen(places.places(docs, quotes)).select(*columns).collect()
    assert sorted(places.chosen(places.best_places(docs, quotes)).select(*columns).collect()) == sorted(want)


def test_places_go_back_in_few_batches():
    """Not in one for each document."""
    import pyarrow as pa

    from foliant.operators import places

    got = list(places.batched(((n, str(n)) for n in range(10_000)), ["a", "b"], [pa.int64(), pa.string()]))
    assert [b.num_rows for b in got] == [4096, 4096, 1808] and got[2].column("b")[-1].as_py() == "9999"
    assert list(places.batched(iter(()), ["a"], [pa.int64()])) == []


@pytest.mark.parametrize("name", ["documents_of_spans", "near_boxes", "span_join"])
def test_all_lines_of_a_text_are_set(spark, tmp_path, name):
    """Lines beyond the fortieth count, as they do in the query's SQL."""
    from foliant.plans.queries import QUERIES, SQL

    duckdb = pytest.importorskip("duckdb")
    lines = [f"line {k} of  words" + " more" * (k % 7) for k in range(130)]
    texts = ["\n".join(lines), "\n".join(lines[:60]), "\n".join(lines[:41]), "\n".join(lines[:40]), "\n" * 50 + "end", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(SQL[name])
    found = [tuple(r) for r in got.select(*want.columns).collect()]
    assert sorted(found) == sorted(want.fetchall())
    if "n" in want.columns:
        assert {r[1] for r in found if r[0] == 0} == set(range(130))
    else:
        assert len({r[1] for r in found if r[0] < 4}) == 4
