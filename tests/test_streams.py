"""A library followed by its versions, and runs that do not end, over restarts."""

import datetime
import http.server
import json
import threading
import urllib.parse

import pytest

from foliant.store import Store


class Versions(http.server.BaseHTTPRequestHandler):
    """A library that knows the version of every record."""

    records: dict[str, tuple[int, str]] = {}
    asked: list[dict] = []

    def do_GET(self):
        q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
        self.asked.append(q)
        rows = [{"key": k, "version": v, "data": {"key": k, "itemType": "note" if k[0] == "n" else "book", "title": t}} for k, (v, t) in self.records.items() if v > int(q.get("since", 0))]
        start, limit = int(q["start"]), int(q["limit"])
        self.send_response(200)
        self.send_header("Total-Results", str(len(rows)))
        self.send_header("Last-Modified-Version", str(max((v for v, _ in self.records.values()), default=0)))
        self.end_headers()
        self.wfile.write(json.dumps(rows[start : start + limit]).encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    Versions.records, Versions.asked = {}, []
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Versions)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/users/0/items"
    s.shutdown()


def test_only_what_is_newer_is_fetched(spark, tmp_path, server):
    from foliant.streaming.changes import change_stream, changes

    store = Store(spark, f"file://{tmp_path}/s")

    def follow():
        Versions.asked.clear()
        q = change_stream(changes(spark, server, limit=3), store, 7, f"{tmp_path}/c")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r["item_key"], r["title"], r["id"], r["status"]) for r in store.read("source").collect()) if store.read("source") is not None else None

    Versions.records = {f"b{k}": (k + 1, f"T{k}") for k in range(7)} | {"n1": (9, "a note")}
    assert follow() == [(f"b{k}", f"T{k}", k + 1, "active") for k in range(7)]
    assert {q.get("since") for q in Versions.asked if q["limit"] == "3"} == {"0"}
    # the stream goes on from the version it has seen, also after a restart
    Versions.records |= {"b2": (11, "new title"), "b9": (12, "T9")}
    got = follow()
    assert got[2] == ("b2", "new title", 3, "active") and got[-1] == ("b9", "T9", 8, "active") and len(got) == 8
    pages = [q for q in Versions.asked if q["limit"] == "3"]
    assert {q["since"] for q in pages} == {"9"} and len(pages) == 1 and all(q["sort"] == "dateAdded" for q in pages)
    version = store.version("source")
    assert follow() == got and store.version("source") == version and not [q for q in Versions.asked if q["limit"] == "3"]
    del Versions.records["b0"]  # what is gone is no change
    assert len(follow()) == 8


def test_newer_than_the_batch_is_left(server):
    from foliant.sources.paged_json import ChangedPage, ChangeReader

    Versions.records = {"a": (5, "x"), "b": (8, "y"), "c": (9, "z")}
    r = ChangeReader({"url": server, "limit": "2"})
    assert r.initialOffset() == {"version": 0} and r.latestOffset() == {"version": 9} and r.partitions({"version": 9}, {"version": 9}) == []
    assert [(p.start, p.since, p.until) for p in r.partitions({"version": 0}, {"version": 8})] == [(0, 0, 8), (2, 0, 8)]
    read = lambda start: [json.loads(v)["key"] for _, _, v in r.read(ChangedPage(start, 0, 8))]
    assert read(0) == ["a", "b"] and read(2) == []


EVENTS = "id long, library_id long, event string, at timestamp"


def test_runs_that_do_not_end(spark, tmp_path):
    from foliant.streaming.runs import run_ends

    t = lambda minutes: datetime.datetime(2029, 1, 1) + datetime.timedelta(minutes=minutes)

    def feed(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        q = run_ends(events, 3600, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.read.schema("id long, library_id long, outcome string, started_at timestamp, ended_at timestamp").parquet(f"{tmp_path}/out")
        return {(r["id"], r["outcome"]): (r["library_id"], r["started_at"], r["ended_at"]) for r in out.collect()}

    first = feed([(1, 4, "started", t(0)), (2, 4, "started", t(1)), (1, 4, "ok", t(20)), (9, 5, "failed", t(2))])
    assert first == {(1, "ok"): (4, t(0), t(20)), (9, "unknown"): (5, None, t(2))}
    # every feed is a restart: what has begun is kept, and the watermark that passes its hour makes it overdue
    later = feed([(3, 6, "started", t(90)), (4, 6, "started", t(91)), (4, 6, "failed", t(91))])
    later = feed([(5, 6, "started", t(120))])
    assert later[2, "overdue"] == (4, t(1), None) and later[4, "failed"] == (6, t(91), t(91)) and (3, "overdue") not in later
    last = feed([(2, 4, "ok", t(121)), (3, 6, "ok", t(125)), (6, 7, "started", t(300))])
    assert last[2, "late"] == (4, t(1), t(121)) and last[3, "ok"] == (6, t(90), t(125)) and last[5, "overdue"] == (6, t(120), None)
    end = feed([(5, 6, "failed", t(301)), (7, 7, "started", t(320))])
    assert end[5, "late"] == (6, t(120), t(301)) and (6, "overdue") not in end and sum(k == 2 for k, _ in end) == 2 and len(end) == 8
