import datetime as dt
import random

from pyspark.sql import functions as F

from foliant.functions import records
from foliant.functions import text as text_functions
from foliant.operators import drift, findings, resolve, review, snapshot, spans, wording

SOURCE = "id long, library_id long, citation_key string, title string, year int, doi string, status string"


def order(spark):
    return spark.createDataFrame([(0, 0), (42, 1), (99, 2)], "library_id long, position int")


def test_agreement_is_not_transitive(spark):
    rows = [(1, 0, "k", "T1", 2020, "10.1/d1", "active"), (2, 42, "k", "t1", 2020, None, "active"), (3, 99, "k", "T2", 2021, "10.1/D1", "active")]
    for shift in range(3):
        s = spark.createDataFrame([(*r[:1], rows[(n + shift) % 3][1], *r[2:]) for n, r in enumerate(rows)], SOURCE)
        assert [r["citation_key"] for r in resolve.conflicts(s, order(spark)).collect()] == ["k"]
    two = spark.createDataFrame(rows[:2], SOURCE)
    r = resolve.resolve(two, order(spark), spark.createDataFrame([("k",), ("none",)], "citation_key string")).orderBy("citation_key").collect()
    assert [(x["status"], x["winner"], x["n_others"]) for x in r] == [("found", 1, 1), ("not_found", None, None)]
    assert [tuple(x) for x in resolve.others(two, order(spark), spark.createDataFrame([("k",)], "citation_key string")).collect()] == [("k", 2, 2)]


def test_equal_sources_without_anything_conflict(spark):
    rows = [(1, 0, "k", "", None, None, "active"), (2, 42, "k", "", None, "", "active"), (3, 0, "one", "", None, None, "active"), (4, 0, "old", "A", 1, None, "retired"), (5, 7, "else", "A", 1, None, "active")]
    s = spark.createDataFrame(rows, SOURCE)
    assert [(r["citation_key"], r["members"]) for r in resolve.conflicts(s, order(spark)).collect()] == [("k", 2)]
    assert {r["citation_key"] for r in resolve.winners(s, order(spark)).collect()} == {"k", "one"}


def test_drift_is_asymmetric(spark):
    e = spark.createDataFrame([("a", "X", None, "10.1/A", 0), ("a", "Y", None, "10.1/A", 1), ("b", None, 2001, None, 2), ("c", "T", 1, None, 3)], "key string, title string, year int, doi string, position int")
    s = spark.createDataFrame([("a", "y", 1999, "10.1/a"), ("b", "Z", 2000, None)], "citation_key string, title string, year int, doi string")
    got = {(r["key"], r["kind"], r["field"]) for r in drift.compare(e, s).collect()}
    assert got == {("b", "differs", "year"), ("c", "only_in_file", None)}


def test_sync_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "A", 1, "h", "active", "t", "0", "0"), (1, "B", 2, "h", "active", "t", "0", "0"), (1, "C", 3, "h", "retired", "t", "0", "0")], "library_id long, item_key string, id long, data_hash string, status string, title string, first_seen string, last_seen string")
    fetched = spark.createDataFrame([(1, "A", 0, "h2", "t2"), (1, "C", 1, "h", "t"), (1, "N", 2, "h", "t"), (2, "N", 0, "h", "t")], "library_id long, item_key string, position long, data_hash string, title string")
    c = snapshot.counters(snapshot.classify(stored, fetched)).filter("library_id = 1").first()
    assert (c["n_seen"], c["n_new"], c["n_changed"], c["n_reactivated"], c["n_retired"]) == (3, 1, 1, 1, 1)
    after = snapshot.next_sources(stored, fetched, F.lit("1"), ["title"])
    rows = {(r["library_id"], r["item_key"]): (r["id"], r["status"], r["first_seen"]) for r in after.collect()}
    assert rows == {(1, "A"): (1, "active", "0"), (1, "B"): (2, "retired", "0"), (1, "C"): (3, "active", "0"), (1, "N"): (4, "active", "1"), (2, "N"): (5, "active", "1")}
    again = snapshot.counters(snapshot.classify(after, fetched)).agg(*(F.sum(x).alias(x) for x in ("n_new", "n_changed", "n_reactivated", "n_retired"))).first()
    assert list(again) == [0, 0, 0, 0]


def test_attachment_path_change_resets_checksum(spark):
    old = spark.createDataFrame([(1, "A", 5, "/a", "c", 3), (1, "B", 5, None, "c", 3), (1, "C", 5, "/c", "c", 3)], "library_id long, item_key string, source_id long, path string, checksum string, page_count int")
    new = spark.createDataFrame([(1, "A", "S", "/b"), (1, "B", None, None)], "library_id long, item_key string, parent_key string, path string")
    s = spark.createDataFrame([(1, "S", 9)], "library_id long, item_key string, id long")
    got = {r["item_key"]: (r["source_id"], r["checksum"], r["status"]) for r in snapshot.next_attachments(old, new, s).collect()}
    assert got == {"A": (9, None, "active"), "B": (None, "c", "active"), "C": (5, "c", "retired")}


def test_review_queue(spark):
    q = spark.createDataFrame([("a", None), ("b", dt.datetime(2020, 1, 1))], "dedupe_key string, resolved_at timestamp")
    items = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2), ("c", 3)], "dedupe_key string, position int")
    assert sorted((r["dedupe_key"], r["position"]) for r in review.accepted(q, items).collect()) == [("b", 1), ("c", 3)]
    assert review.open_count(review.enqueue(q, items)).first()["n_open"] == 3


def test_findings(spark):
    lib = spark.createDataFrame([(1, "group", 4, "G"), (0, "user", 0, "U")], "library_id long, kind string, number long, name string")
    src = spark.createDataFrame([(n, 0, f"K{n:02d}", None, "T", None, None, "active") for n in range(12)], "id long, library_id long, item_key string, citation_key string, title string, year int, doi string, status string")
    runs = spark.createDataFrame([(1, 0, "ok", dt.datetime(2020, 1, 1), None), (2, 0, "failed", dt.datetime(2020, 1, 2), "down")], "id long, library_id long, status string, finished_at timestamp, error string")
    st = findings.library_status(lib, src, runs, F.lit(dt.datetime(2020, 1, 1, 3)))
    f = findings.library_findings(st).union(findings.source_findings(src, lib))
    text = {(r["severity"], r["code"]): r["message"] for r in f.collect()}
    assert text["info", "library"] == 'user "U" holds 12 active sources as of 3 h before'
    assert text["warning", "library"] == 'user "U": newest sync broke off with down'
    assert text["warning", "never_synced"].startswith("group:4")
    assert text["warning", "missing_citation_key"].startswith("12 sources") and text["warning", "missing_citation_key"].endswith('user:K09 "T", +2 others')
    assert findings.exit_code(f).first()["exit_code"] == 1 and findings.exit_code(f.filter("severity = 'info'")).first()["exit_code"] == 0


def test_records(spark):
    item = '{"key":"A","library":{"name":"L"},"data":{"key":" A ","itemType":"book","title":"T","date":"vol. 12345, 1999","DOI":" ","citationKey":"k","tags":[{"tag":"x"},{}],"collections":["C",null]}}'
    r = records.items(spark.createDataFrame([(item,), ('{"data":[]}',), ('{"data":{}}',)], "value string")).collect()
    assert (r[0]["item_key"], r[0]["year"], r[0]["doi"], r[0]["tags"], r[0]["collections"], r[0]["error"]) == ("A", 1999, None, ["x"], ["C"], None)
    assert r[1]["error"] == "item without data" and r[2]["error"] == "item without key"
    c = records.collections(spark.createDataFrame([('{"data":{"key":"C","name":"n","parentCollection":false}}',)], "value string")).first()
    assert c["parent_key"] is None
    h = [x["h"] for x in spark.createDataFrame([('{"b":1,"a":{"y":1,"x":2},"version":1}',), ('{"version":2,"a":{"x":2,"y":1},"b":1}',)], "d string").select(records.record_hash("d").alias("h")).collect()]
    assert h[0] == h[1] and len(h[0]) == 64


def test_spans(spark):
    df = spark.createDataFrame([([[(0.0, 0.0, 1.0, 0.0, 0.0, 2.0, 1.0, 2.0)[i] for i in range(8)], [5.0, 1.0, 6.0, 1.0, 5.0, 3.0, 6.0, 3.0]],)], "q array<array<double>>")
    assert tuple(df.select(spans.box_of_quads(F.col("q")).alias("b")).first()["b"]) == (0.0, 0.0, 6.0, 3.0)
    pages = spark.sql("SELECT 1 doc_id, 'x' backend, i AS index, cast(null as " + spans.SPAN + ") AS spans, p AS plain FROM VALUES (1, 'b'), (0, 'a') t(i, p)")
    assert spans.document_text(pages).first()["text"] == "a\nb"


def test_conflicts_as_all_pairs(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice([0, 42, 99]), f"k{rng.randrange(60)}", rng.choice(["", "A", "a", "B"]), rng.choice([None, 1, 2]), rng.choice([None, "", "10.1/X", "10.1/x", "10.1/y"]), "active") for n in range(170)]
    same = lambda a, b: bool(a[5]) and bool(b[5]) and a[5].lower() == b[5].lower() or a[3] != "" and a[3].lower() == b[3].lower() and a[4] is not None and a[4] == b[4]
    want = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[2] == b[2] and not same(a, b):
                want[a[2]] = sum(r[2] == a[2] for r in rows)
    got = {r["citation_key"]: r["members"] for r in resolve.conflicts(spark.createDataFrame(rows, SOURCE), order(spark)).collect()}
    assert got == want and 0 < len(got) < 60


def test_wording_search(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["x The quick-\nbrown fox jumps over it", "nothing", None, "", "over \ufb01ne lines over fine lines"]
    texts += [" ".join(rng.choice(["ab", "abc", "bc", "b"]) for _ in range(rng.randint(1, 14))) for _ in range(25)]
    asked = ["QUICKBROWN fox jumps over", "noth", "", None, "er fine li", "b", "c a", "ab bc abc", "bc abc b", "abc b ab bc ab b", "bc ab b abc bc", "ab ab", "z", "lines"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    plain = lambda x: text_functions.normalize(x).text if x is not None else ""
    want = sorted((i, k, plain(t).find(plain(w))) for i, t in enumerate(texts) for k, w in enumerate(asked) if plain(w) and plain(w) in plain(t))
    assert (0, 0, 6) in want and len(want) > 30
    for most in (wording.BROADCAST_BYTES, -1):
        monkeypatch.setattr(wording, "BROADCAST_BYTES", most)
        assert sorted(map(tuple, wording.find_wordings(docs, items).collect())) == want
    assert wording.find_wordings(docs, items.filter("item_id < 0")).count() == 0


def test_anchors(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight")], "doc_id long, text string")
    q = spark.createDataFrame([(1, 1, "two three"), (2, 1, "TWO  three"), (3, 1, "two three four five sixx seven"), (4, 1, "other words"), (5, 9, "two")], "quote_id long, doc_id long, quote string")
    assert [r["state"] for r in wording.anchors(docs, q).orderBy("quote_id").collect()] == ["exact", "normalized", "fuzzy", "unanchored", "unanchored"]
