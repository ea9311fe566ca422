import contextlib
import hashlib
import http.server
import json
import sqlite3
import threading
import urllib.parse

import pytest

from foliant import store
from foliant.sources import files
from foliant.sources.paged_json import PagedJson


class Fake(http.server.BaseHTTPRequestHandler):
    rows = [{"key": f"K{n}", "data": {"key": f"K{n}", "itemType": "attachment" if n % 5 == 0 else "book"}} for n in range(250)]
    total = True

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        q = dict(urllib.parse.parse_qsl(url.query))
        if url.path != "/items":
            self.send_error(404)
            return
        rows = [r for r in self.rows if q.get("itemType") in (None, r["data"]["itemType"])]
        at, n = int(q.get("start", 0)), int(q.get("limit", 25))
        body = json.dumps(rows[at : at + n]).encode()
        self.send_response(200)
        if self.total:
            self.send_header("Total-Results", str(len(rows)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


@pytest.mark.parametrize("total", [True, False])
def test_pages(spark, server, total):
    Fake.total = total
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)
    df = spark.read.format("paged_json").option("url", f"{server}/items").load()
    assert sorted(r["position"] for r in df.collect()) == list(range(250))
    assert spark.read.format("paged_json").option("url", f"{server}/items").option("itemtype", "attachment").load().count() == 50
    with pytest.raises(Exception, match="404"):
        spark.read.format("paged_json").option("url", f"{server}/other").load().count()


def test_download_and_lock(spark, server):
    url = f"{server}/items?limit=2"
    wanted = spark.createDataFrame([("a", url), ("b", f"{server}/none"), ("c", "nonsense"), ("d", url)], "id string, url string")
    got = {r["id"]: r for r in files.download(wanted).collect()}
    body = json.dumps(Fake.rows[:2]).encode()
    assert bytes(got["a"]["content"]) == body and got["a"]["hash"] == hashlib.sha256(body).hexdigest()
    assert "404" in got["b"]["error"] and got["c"]["error"].startswith("ValueError") and got["b"]["content"] is None
    locked = spark.createDataFrame([("a", got["a"]["hash"]), ("d", "other")], "id string, hash string")
    fetched = files.download(wanted).filter("error is null").select("id", "hash")
    assert sorted(map(tuple, store.lock_status(locked, fetched).collect())) == [("a", "match"), ("d", "mismatch")]


def test_sqlite_copy(spark, tmp_path):
    path = tmp_path / "lib.sqlite"
    with contextlib.closing(sqlite3.connect(path)) as con:
        con.execute("CREATE TABLE item (key TEXT, year INTEGER)")
        con.executemany("INSERT INTO item VALUES (?, ?)", [(f"K{n}", n if n % 3 else None) for n in range(25)])
        con.commit()
        con.execute("BEGIN EXCLUSIVE")  # its own program holds it
        rows = files.read_sqlite(spark, str(path), "SELECT key, year FROM item WHERE key <> 'K1'", "key string, year long", batch=7).collect()
    assert sorted((r["key"], r["year"]) for r in rows) == sorted((f"K{n}", n if n % 3 else None) for n in range(25) if n != 1)


class Library(http.server.BaseHTTPRequestHandler):
    """A user's library, one group that answers, and one that does not."""

    data = {"itemType": "book", "title": "T", "date": "2001", "tags": [{"tag": "x"}], "collections": ["C"]}
    paths = {
        "/users/0/groups": [{"id": 9, "data": {"name": "Nine"}}, {"id": 4, "data": {"name": "Four"}}],
        "/users/0/items/top": [{"key": "A", "library": {"name": "Me"}, "data": {"key": "A", "version": 3} | data}, {"key": "N", "data": {"key": "N", "itemType": "note"}}],
        "/users/0/collections": [{"key": "C", "data": {"key": "C", "name": "c", "parentCollection": False}}],
        "/users/0/items": [{"key": "P", "data": {"key": "P", "itemType": "attachment", "parentItem": "A", "contentType": "application/pdf"}, "links": {"enclosure": {"href": "file:///a%20b.pdf"}}}, {"key": "H", "data": {"key": "H", "itemType": "attachment", "contentType": "text/html"}}],
        "/groups/4/items/top": [{"key": "G", "data": {"key": "G"} | data}],
        "/groups/4/collections": [],
        "/groups/4/items": [],
    }

    def do_GET(self):
        path = urllib.parse.urlparse(self.path).path
        if path not in self.paths:
            self.send_error(503)
            return
        self.send_response(200)
        self.send_header("Total-Results", str(len(self.paths[path])))
        self.end_headers()
        self.wfile.write(json.dumps(self.paths[path]).encode())

    def log_message(self, *a):
        pass


def test_sync_over_http(spark, tmp_path):
    from foliant.operators.sync import sync_all
    from foliant.sources import library

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Library)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base, own = f"http://127.0.0.1:{s.server_port}", store.Store(spark, f"file://{tmp_path}/s")
    found = library.groups(spark, base)
    assert found == [(4, "Four"), (9, "Nine")]
    places = {0: ("user", 0)} | {n: ("group", n) for n, _ in found}
    runs = sync_all(own, [(0, "user"), *((n, f"group:{n}") for n, _ in found)], lambda n: library.fetch(own, base, n, *places[n]), "now", ["title", "citation_key", "doi"]).orderBy("id").collect()
    s.shutdown()
    assert [(r["library_id"], r["status"], r["n_new"], r["n_attachments"], r["n_skipped"]) for r in runs] == [(0, "ok", 1, 1, 1), (4, "ok", 1, 0, 0), (9, "failed", 0, 0, 0)] and "503" in runs[2]["error"]
    assert sorted((r["library_id"], r["item_key"], r["title"]) for r in own.read("source").collect()) == [(0, "A", "T"), (4, "G", "T")]
    assert [r["path"] for r in own.read("attachment").collect()] == ["/a b.pdf"] and own.read("source_tag").count() == 2 and own.read("source_collection").count() == 1
    with pytest.raises(library.BadRecord):
        library.checked(spark.createDataFrame([("item without key",)], "error string"))


BOOKS = """@string{ann = "Annals"}
@article{dwork2006, title = {Calibrating {Noise} to
  Sensitivity}, year = 2006, doi = {10.1/x}, journal = ann # " of X"}
@comment{no entry}
@book{b, title = "A {B}", date = {2016-03}}
@misc{c, year = {forthcoming}}
"""


def test_citation_file(spark, tmp_path):
    e = files.citation_entries(BOOKS)
    assert [(x["key"], x["title"], x["year"], x["doi"]) for x in e] == [("dwork2006", "Calibrating Noise to Sensitivity", 2006, "10.1/x"), ("b", "A B", 2016, None), ("c", None, None, None)]
    (tmp_path / "a.bib").write_text(BOOKS)
    (tmp_path / "bad.bib").write_text("@article{x, title = {open")
    rows = files.read_citations(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and sum(r["error"] is not None for r in rows) == 1


def test_project(spark, tmp_path):
    p = files.new_project(str(tmp_path), 'A "q"\n')
    assert files.parse_project(p.read_text()).name == 'A "q"\n' and files.find_root(str(tmp_path / ".")) == tmp_path.resolve()
    with pytest.raises(FileExistsError):
        files.new_project(str(tmp_path), "B")
    for bad in ('id = " "', 'id = "x"\n[library]\nlibraries = []', 'id = "x"\n[library]\nlibraries = ["group:0"]'):
        with pytest.raises(ValueError):
            files.parse_project(bad)
    assert [tuple(r) for r in files.parse_project('id = "x"\n[library]\nlibraries = ["group:7", "user"]').order(spark).collect()] == [(0, "group", 7), (1, "user", 0)]
    assert str(files.data_dir({"FOLIANT_DATA_DIR": "", "XDG_DATA_HOME": "/x"})) == "/x/foliant"
    assert files.corpus(spark, '[[document]]\nid = "a"\nexpect = {sentences = ["s"], before = [["a", "b"]]}').first()["before"][0]["second"] == "b"


def test_extract_and_stext(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"one\ftwo")), ("b", bytearray(b"\xff"))], "path string, content binary")
    rows = files.extract(df, files.chosen_backends(["plain"])).collect()
    assert sorted((r["path"], r["index"], r["plain"]) for r in rows if not r["error"]) == [("a", 0, "one"), ("a", 1, "two")] and sum(r["error"] is not None for r in rows) == 1
    with pytest.raises(ValueError):
        files.chosen_backends(["none"])
    (tmp_path / "p.xml").write_text('<document><page width="10" height="20"><block><line><font name="F" size="9"><char c="a" quad="0 0 1 0 0 2 1 2"/><char c="&amp;" quad="1 0 2 0 1 2 2 2"/></font><font name="F" size="9"><char c=" " quad="2 0 3 0 2 2 3 2"/></font></line></block></page></document>')
    p = files.stext_pages(spark, str(tmp_path / "p.xml")).first()
    assert [(s["text"], s["left"], s["bottom"], s["right"]) for s in p["spans"]] == [("a&", 0.0, 2.0, 2.0)]


def test_pages_are_numbered_in_their_file(spark, tmp_path):
    page = '<page width="1" height="2"><block><line><font name="F" size="9"><char c="{}" quad="0 0 1 0 0 2 1 2"/></font></line></block></page>'
    for name, letters in (("a", "xyz"), ("b", "pq")):
        (tmp_path / f"{name}.xml").write_text("<document>" + "\n".join(page.format(c) for c in letters) + '<page width="3" height="4"/></document>')
    rows = files.stext_pages(spark, f"{tmp_path}/*.xml").collect()
    assert sorted((r["path"][-5:], r["index"], "".join(s["text"] for s in r["spans"]), r["width"]) for r in rows) == [("a.xml", 0, "x", 1.0), ("a.xml", 1, "y", 1.0), ("a.xml", 2, "z", 1.0), ("a.xml", 3, "", 3.0), ("b.xml", 0, "p", 1.0), ("b.xml", 1, "q", 1.0), ("b.xml", 2, "", 3.0)]
    script = tmp_path / "tool"
    script.write_text("#!/bin/sh\ncat \"$1\"\n")
    script.chmod(0o755)
    content = spark.createDataFrame([("f", bytearray((tmp_path / "a.xml").read_bytes()))], "path string, content binary")
    spans = files.extract_spans(content, files.StextProcess("tool", [str(script)]))
    assert [r["index"] for r in spans.orderBy("index").collect()] == [0, 1, 2, 3] and spans.filter("index = 1").first()["spans"][0]["text"] == "y"
    assert files.version_of_keys("MAJOR=1\nMINOR=2\nBUILD=33\nPATCH=0\n") == "1.2.33.0"


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    step = lambda st: st.write("t", spark.range(3))
    assert s.open([step], f"file://{tmp_path}/b") == (0, 1, None) and s.migrate([step]) == (1, 1) and s.read("t").count() == 3
    s.write("t", spark.range(5))
    assert s.version("t") == 2 and s.read("t").count() == 5 and s.read("none") is None
    old, new, saved = s.open([step, lambda st: st.write("u", spark.range(1))], f"file://{tmp_path}/b")
    assert (old, new) == (1, 2) and spark.read.parquet(f"{saved}/t").count() == 5 and s.tables == ["t", "u"]
    a, b = s.backup(f"file://{tmp_path}/b", "20290101T000000Z"), s.backup(f"file://{tmp_path}/b", "20290101T000000Z")
    assert a + "-1" == b and spark.read.parquet(f"{b}/t").count() == 5
    with pytest.raises(ValueError):
        s.migrate([])
    store.export_lines(spark.range(4), f"file://{tmp_path}/j")
    assert store.import_lines(spark, f"file://{tmp_path}/j", spark.range(2), "id").count() == 2


def test_writers_do_not_lose_each_others_tables(spark, tmp_path, monkeypatch):
    a, b = (store.Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    a.write("t", spark.range(1))
    read, first = a._numbers, []

    def slow(name):  # another writer comes between reading and writing
        numbers = read(name)
        if not first:
            first.append(b.write("u", spark.range(2)))
        return numbers

    monkeypatch.setattr(a, "_numbers", slow)
    a.write("t", spark.range(3))
    assert (b.version("t"), b.version("u"), b.read("t").count(), b.read("u").count()) == (2, 1, 3, 2)
    for k in range(store.KEPT + 5):
        b._change("_current", lambda now: now)
    assert len(b._numbers("_current")) <= store.KEPT + 2 and b.read("t").count() == 3
    (tmp_path / "s" / f"_current.{b._numbers('_current')[-1] + 1:012d}").write_text('{"t":')  # half written
    monkeypatch.setattr(store, "ABANDONED", 0.2)
    assert b.read("t").count() == 3 and b.write("t", spark.range(7)) == 3 and b.read("u").count() == 2


LANDED = "library_id long, landing long, n_rows long, item_key string, position long, data_hash string, title string"


def test_stream(spark, tmp_path):
    from foliant.streaming.snapshots import sync_stream

    s = store.Store(spark, f"file://{tmp_path}/s")

    def land(rows):
        spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sync_stream(spark.readStream.schema(LANDED).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/c", ["title"]).awaitTermination()
        return s.read("source") and sorted((r["library_id"], r["item_key"], r["status"], r["title"]) for r in s.read("source").collect())

    assert land([(1, 1, 2, "A", 0, "h", "t")]) is None  # half a landing waits, and nothing is stored
    assert land([(1, 1, 2, "Z", 1, "h", "t"), (2, 5, 1, "Z", 0, "h", "t")]) == [(1, "A", "active", "t"), (1, "Z", "active", "t"), (2, "Z", "active", "t")]
    ids = {(r["library_id"], r["item_key"]): r["id"] for r in s.read("source").collect()}
    assert sorted(ids.values()) == [1, 2, 3]
    # two landings of one library at once: the newest counts; half of a third one waits
    rows = [(1, 2, 1, "B", 0, "h", "old"), (1, 3, 1, "A", 0, "h", "new"), (1, 4, 2, "C", 0, "h", "t")]
    assert land(rows) == [(1, "A", "active", "new"), (1, "Z", "retired", "t"), (2, "Z", "active", "t")]
    assert land([(1, 4, 2, "A", 1, "h", "t4"), (3, 1, 2, "D", 0, "h", "one"), (3, 1, 2, "D", 1, "h", "two")])[-1] == (3, "D", "active", "two")
    s.write("source", s.read("source").filter("library_id < 3"))
    assert sorted((r["library_id"], r["item_key"], r["status"], r["title"]) for r in s.read("source").collect()) == [(1, "A", "active", "t4"), (1, "C", "active", "t"), (1, "Z", "retired", "t"), (2, "Z", "active", "t")]
    assert {(r["library_id"], r["item_key"]): r["id"] for r in s.read("source").collect()} == ids | {(1, "C"): 4} and s.read("landed").count() == 0
