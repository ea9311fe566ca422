import json

import pytest
from pyspark.sql import functions as F

from foliant import __main__ as command
from foliant import reports
from foliant.functions import records
from foliant.operators import doctor, sync, wording
from foliant.store import Store

FIELDS = ["title"]
ITEMS = "library_id long, item_key string, item_type string, position long, data_hash string, title string, tags array<string>, collections array<string>"


@pytest.fixture
def fetch(spark):
    """Libraries by number; what is no Fetched is raised."""
    state = {}

    def get(library):
        if isinstance(state[library], Exception):
            raise state[library]
        items, collections, files = state[library]
        return sync.Fetched(
            spark.createDataFrame([(library, *r) for r in items], ITEMS),
            spark.createDataFrame([(library, *r) for r in collections], "library_id long, collection_key string, name string, parent_key string"),
            spark.createDataFrame([(library, *r) for r in files], "library_id long, item_key string, parent_key string, path string"),
        )

    get.state = state
    return get


def item(key, position, tags=(), collections=(), kind="book", h="h"):
    return (key, kind, position, h, f"Title {key}", list(tags), list(collections))


def test_sync(spark, tmp_path, fetch):
    store, libraries = Store(spark, f"file://{tmp_path}/s"), [(0, "user"), (7, "group:7")]
    run = lambda now: [tuple(r) for r in sync.sync_all(store, libraries, fetch, now, FIELDS).select("id", "library_id", "status", "error", *sync.COUNTERS).orderBy("id").collect()]
    fetch.state[0] = ([item("A", 0, ["x", "x", "y"], ["C1", "none"]), item("B", 1, (), ["C2"]), item("N", 2, kind="note")], [("C1", "one", None), ("C2", "two", "C1")], [("P", "A", "/p"), ("Q", None, None)])
    fetch.state[7] = OSError("no answer")
    # a library that fails does not keep the others back, and leaves a run of its own
    assert run("t1") == [(1, 0, "ok", None, 2, 0, 0, 0, 2, 1), (2, 7, "failed", "OSError: no answer", 0, 0, 0, 0, 0, 0)]
    read = lambda t, *c: sorted(map(tuple, store.read(t).select(*c).collect()), key=str)
    ids = {k: i for k, i in read("source", "item_key", "id")}
    assert read("source_tag", "source_id", "tag") == [(ids["A"], "x"), (ids["A"], "y")]
    assert len(read("source_collection", "source_id", "collection_id")) == 2
    fetch.state[0] = ([item("B", 0, h="h2")], [("C1", "uno", None)], [("P", "B", "/moved")])
    fetch.state[7] = ([item("A", 0, ["z"])], [], [])
    assert run("t2") == [(3, 0, "ok", None, 0, 1, 1, 0, 1, 0), (4, 7, "ok", None, 1, 0, 0, 0, 0, 0)]
    assert read("source", "library_id", "item_key", "status") == [(0, "A", "retired"), (0, "B", "active"), (7, "A", "active")]
    # the memberships of A are kept as it was not fetched, but its collection C2 is gone with all of its own
    assert read("source_collection", "source_id") == [(ids["A"],)] and read("collection", "collection_key", "name") == [("C1", "uno")]
    assert read("source_tag", "tag") == [("x",), ("y",), ("z",)]
    assert read("attachment", "item_key", "status", "path") == [("P", "active", "/moved"), ("Q", "retired", None)]
    [todo] = store.read("review").collect()
    assert (todo["dedupe_key"], json.loads(todo["details"])) == ("source_retired:user:A", {"library": "user", "item_key": "A"})
    fetch.state[0] = ([item("A", 0), item("B", 1, h="h2")], [], [])
    fetch.state[7] = ValueError("gone")
    assert [r[2:8] for r in run("t3")] == [("ok", None, 0, 0, 0, 1), ("failed", "ValueError: gone", 0, 0, 0, 0)]
    assert read("source", "library_id", "item_key", "id", "status")[:2] == [(0, "A", ids["A"], "active"), (0, "B", ids["B"], "active")]
    fetch.state[0] = ([item("B", 1, h="h2")], [], [])
    run("t4")
    assert store.read("review").count() == 1  # the item about A is still open
    assert [r[0] for r in read("sync_run", "id")] == [1, 2, 3, 4, 5, 6, 7, 8] and store.read("sync_run").filter("status = 'running'").count() == 0


def test_every_library_fails(spark, tmp_path, fetch):
    fetch.state[3] = TimeoutError("slow")
    runs = sync.sync_all(Store(spark, f"file://{tmp_path}/s"), [(3, "group:3")], fetch, "t", FIELDS).collect()
    assert [(r["status"], r["error"], r["finished_at"]) for r in runs] == [("failed", "TimeoutError: slow", "t")]


@pytest.fixture
def subject(spark):
    lib = spark.createDataFrame([(0, "user", 0, "U")], "library_id long, kind string, number long, name string")
    src = spark.createDataFrame([(1, 0, "K1", "a", "T|1", 2000, None, "active"), (2, 0, "K2", "a", "T2", 2001, None, "active"), (3, 0, "K3", "b", "B", 1999, None, "active")], "id long, library_id long, item_key string, citation_key string, title string, year int, doi string, status string")
    runs = spark.createDataFrame([], "id long, library_id long, status string, finished_at timestamp, error string")
    files = spark.createDataFrame([(1, 0, "P", 1, "/gone", "active")], "id long, library_id long, item_key string, source_id long, path string, status string")
    queue = spark.createDataFrame([], "kind string, dedupe_key string, message string, details string, position long, created_at timestamp, resolved_at timestamp")
    return doctor.Subject(lib, src, runs, files, queue, files.select("path").limit(0), "memory", 3, "no route")


def test_doctor(spark, subject):
    entries = spark.createDataFrame([("a", "T", None, None, 0, None), ("b", "b", 2005, None, 1, None), ("c", "C", None, None, 2, None), (None, None, None, None, 0, "no key at 7")], "key string, title string, year int, doi string, position int, error string")
    order = spark.createDataFrame([(0, 0), (9, 1)], "library_id long, position int")
    found, queue = doctor.examine(subject, F.current_timestamp(), doctor.Project("essay", order, entries))
    codes = sorted((r["ord"], r["severity"], r["code"]) for r in found.collect())
    assert codes == [(0, "info", "store"), (1, "warning", "remote_unreachable"), (3, "warning", "never_synced"), (5, "warning", "missing_pdf_file"), (8, "info", "project"), (9, "warning", "library_unknown"), (10, "warning", "key_conflict"), (11, "error", "citation_file"), (12, "warning", "file_only"), (13, "warning", "metadata_drift"), (14, "warning", "review_open")]
    [todo] = queue.collect()
    assert todo["dedupe_key"] == "key_conflict:essay:a" and json.loads(todo["details"]) == {"key": "a", "sources": 2}
    assert "review_open" not in {r["code"] for r in doctor.examine(subject, F.current_timestamp())[0].collect()}


def test_reports(spark, subject):
    found, _ = doctor.examine(subject, F.current_timestamp())
    lines = [r["line"] for r in reports.text_lines(found).orderBy("ord").collect()]
    assert lines[0] == "info    memory holds schema 3" and reports.text_lines(found, True).orderBy("ord").first()["line"].startswith("\x1b[36minfo")
    rows = json.loads("".join(reports.json_document(found)))
    assert len(rows) == len(lines) and rows[0].keys() == {"ord", "severity", "code", "message"}
    table = [r["line"] for r in reports.markdown_lines(subject.sources.select("item_key", "title", "doi"), ["item_key"]).orderBy("position").collect()]
    assert table == ["| item_key | title | doi |", "| - | - | - |", "| K1 | T\\|1 |  |", "| K2 | T2 |  |", "| K3 | B |  |"]


def test_command(spark, subject, tmp_path, capsys):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(SystemExit):
        command.main(["status", store.root])
    store.write_all({"library": subject.libraries, "source": subject.sources, "sync_run": subject.runs, "attachment": subject.attachments, "review": subject.queue})
    capsys.readouterr()
    assert command.main(["status", store.root, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["active_sources"] == 3
    assert command.main(["doctor", store.root]) == 1 and "no sync has ended well" in capsys.readouterr().out


def test_kinds(spark):
    kinds = spark.createDataFrame([("user",), ("group",)], "kind string")
    assert kinds.select(records.known_kind(F.col("kind")).alias("k")).count() == 2
    with pytest.raises(Exception, match="unknown kind of library: feed"):
        kinds.union(spark.createDataFrame([("feed",)], "kind string")).select(records.known_kind(F.col("kind")).alias("k")).collect()


def test_places(spark):
    docs = spark.createDataFrame([(1, "one cat. two cat. (x cat"), (2, "The  END\nof it")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 1, "cat", ""), (2, 1, "cat", "two "), (3, 1, "cat", "nine"), (4, 2, "the end of", ""), (5, 1, "dog", ""), (6, 1, "", ""), (7, 1, "(x", "cat.")], "quote_id long, doc_id long, quote string, before string")
    got = {r["quote_id"]: (r["state"], r["position"], r["n_places"]) for r in wording.anchor_places(docs, quotes).collect()}
    assert got == {1: ("exact", 4, 3), 2: ("exact", 13, 3), 3: ("exact", 4, 3), 4: ("normalized", 0, 1), 7: ("exact", 18, 1)}


def test_benchmark(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    results = spark.createDataFrame([(1, "a", "x y", None), (2, "a", "z", None), (1, "b", None, "broken")], "doc_id long, backend string, text string, error string")
    expected = spark.createDataFrame([(1, ["x", "q"], [("x", "y")], ["x"]), (2, ["z"], [], ["q"])], "doc_id long, sentences array<string>, before array<struct<first:string,second:string>>, chars array<string>")
    details, totals = wording.benchmark(docs, ["a", "b"], results, expected)
    assert {(r["doc_id"], r["backend"]): r["error"] for r in details.collect()} == {(1, "a"): None, (2, "a"): None, (1, "b"): "broken", (2, "b"): "no result"}
    rows = {r["backend"]: (r["sentences_found"], r["sentences_total"], r["order_ok"], r["docs_missing_chars"], r["errors"]) for r in totals.collect()}
    assert rows == {"a": (2, 3, 1, 1, 0), "b": (0, 0, 0, 0, 2)}
    text = "\n".join(reports.markdown(details.select("doc_id", "backend", "error"), totals.select("backend", "errors"), ["doc_id", "backend"]))
    assert "| 2 | b | no result |" in text and "| b | 2 |" in text
