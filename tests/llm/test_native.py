import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from foliant.llm import licenses, mixing, url_filter

URLS = ["http://A.com/x", "https://example.com/en/1", "https://www.Example.com/en/1?q#f", "http://a.net/es/", "http://a.net/es", "http://net/fr/x", "http://m.casino-win.example.net", "http://m.casino-win.example.net/", "nothing", "", None, "x://y://z.com/", "http://com", "http://b.example.com/en/", "http://a.com:80/", "://", "http://?q/", "http://notexample.com/en/\n/x", "http://me:pw@spam-farm.example.org.:8080", "http://x.FREE-bets.example.net:/%41?q", "http://u@net/es/", "http://net./es/"]


def parse(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    low = str.maketrans(url_filter.UPPER, url_filter.LOWER)
    return (m[1].translate(low), m[2]) if m else ("", "")


def judge(u):
    host, path = parse(u)
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max(((len(h + p), len(h), h + p, v) for v, h, p in url_filter.RULES if fits(h, p)), default=None)
    canon = re.sub(r"\.+$", "", re.sub(r":\d*$", "", re.sub(r"(?s)^.*@", "", host))), unquote(path) or "/"
    listed = host != "" and any((canon[0] == h or canon[0].endswith("." + h)) and canon[1].startswith(p) for h, p in url_filter.LISTED)
    return host, path, best and best[2], best[3] if best else ("block" if listed else "allow"), listed


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", most)
    rows = [(n if n != 3 else None, u, 1) for n, u in enumerate([*URLS, URLS[0]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = url_filter.judge_urls(pages, url_filter.entries_of(spark)).collect()
    assert sorted(map(str, [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) for r in got])) == sorted(str((n, *judge(u))) for n, u, _ in rows)
    assert url_filter.judge_urls(pages.limit(0), url_filter.entries_of(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, url_filter.entries_of(spark, (), ())).collect()} == {"allow"}


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_many_entries_and_a_hot_url(spark, monkeypatch, most):
    """A list of 100,000 entries from a table, with paths; a third of the rows has one URL."""
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", most)
    n = 100_000
    path = F.when(F.col("id") % 3 == 0, "/").when(F.col("id") % 3 == 1, "/a%20b/").otherwise("/deep/er/")
    entries = spark.range(n).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.net:80")).alias("host"), path.alias("path"), F.lit(None).cast("string").alias("verdict"))
    entries = entries.union(spark.createDataFrame([("h7.example.net", "/a b/ok", "allow"), (None, "/", "block")], "host string, path string, verdict string"))
    hosts = [f"h{k}.example.net" for k in range(0, 2 * n, 997)]
    urls = [f"http://w{k}.{h}{p}" for k, h in enumerate(hosts) for p in ("", "/a b/x", "/deep/er/y")] + ["https://h7.example.net/a b/ok/1"] * 200
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, entries).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        m = re.match(r"https?://(?:w\d+\.)?h(\d+)\.example\.net(.*)", u)
        number, path = int(m[1]), m[2] or "/"
        listed = number < n and path.startswith(("/", "/a b/", "/deep/er/")[number % 3])
        rule = number == 7 and path.startswith("/a b/ok")
        assert (got[k]["listed"], got[k]["verdict"], got[k]["rule"]) == (listed, "allow" if rule or not listed else "block", "h7.example.net/a b/ok" if rule else None), u


def fill(sizes, budget=1.5, most=2.0):
    """Targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    out, left, free = {}, budget * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if most * sizes[s] <= level * weight[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_mix(spark, documents, nothing):
    rows = mixing.mix(documents).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = documents.collect()
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + words(d["text"])
    targets = fill(sizes)
    taken = {}
    source = {d["doc_id"]: d["source"] for d in docs}
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d["doc_id"]), words(d["text"])) for d in docs)
    for r in rows:
        s = source[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    for s, n in sizes.items():
        assert abs(taken[n] - targets[s]) <= 1
    assert rows == mixing.mix(documents.repartition(3)).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(documents.repartition(3)).collect()))
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents(documents):
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    words = out.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).first()["n"]
    want = mixing.mix(documents).agg(F.sum("taken").alias("n")).first()["n"]
    assert words == want


def test_mixing_of_one_id_and_clashing_names(spark):
    """Most rows have one doc_id, or none; columns are named like what the operator adds."""
    rows = [(7 if n % 3 else None, f"word{n} " * (1 + n % 5), "s", n, n, n, n) for n in range(300)] + [(n, "a b c", "t", n, n, n, n) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, _ord int, _row int, _position int")
    runs = [[tuple(map(str, r)) for r in mixing.mixed_documents(docs.repartition(n)).collect()] for n in (1, 4)]
    assert runs[0] == runs[1] and mixing.mixed_documents(docs).columns == docs.columns
    whole = {(str(r[0]), str(r[1])): str(r[3]) for r in rows}
    assert all(whole.get((r[0], r[1]), r[3]) == r[3] for r in runs[0])
    buckets = mixing.sized(docs.select("doc_id", "source", "text")).groupBy(F.substring("_ord", 1, 1)).count().agg(F.max("count")).first()[0]
    assert buckets < 60


def test_schedule_inverse(spark):
    for knots in mixing.SCHEDULES:
        rows = spark.range(101).select((F.col("id") / 100).alias("y")).select("y", F.expr(mixing.inverse_sql(knots, "y")).alias("t")).collect()
        total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        for r in rows:
            got = 0.0
            for (t, w), (t2, w2) in zip(knots, knots[1:]):
                x = min(max(r["t"] - t, 0), t2 - t)
                got += w * x + (w2 - w) / (t2 - t) * x * x / 2
            assert got / total == pytest.approx(r["y"], abs=1e-9)


TEXTS = ["Released under the MIT License.", "under the mit license under the MIT-license", "Licensed under the Apache License, Version 2.0.", "cc by nc cc-by-nc 4.0", "This work is licensed under the GNU General Public License, version 3.", "the mit license", "redistribution AND use in source and binary forms, with or without changes are permitted", "general public license version 3 gnu", "", None, "mitö under the mit license", "word " * 50_000 + "cc by nc", "permission is hereby granted free of charge to any"]


TEXTS += [f"// Copyright someone\n{t.text}\nint main" for t in licenses.OWN]
TEXTS += [" ".join(w for k, w in enumerate(t.text.split()) if k % 11) for t in licenses.OWN] + ["cc by nc " * 3000]


def segment_places(words, s):
    out = []
    for i in range(-len(s.words), len(words)):
        same = [0 <= i + k < len(words) and words[i + k] == w for k, w in enumerate(s.words)]
        if all(same[k] for k in s.keys) and sum(same) >= s.need:
            out.append((i, i + len(s.words), sum(same)))
    return out


def places(words, t):
    """Every chain of a template's segments; of those with one last segment the one with most words, then the first."""
    chains = [(i, [(i, j)], n) for i, j, n in segment_places(words, t.segments[0])]
    for s in t.segments[1:]:
        here = segment_places(words, s)
        chains = [(i, [*path, (a, b)], n + m) for i, path, n in chains for a, b, m in here if 0 <= a - path[-1][1] <= licenses.GAP]
    best = {}
    for i, path, n in chains:
        best[path[-1]] = max(best.get(path[-1], (0, 0)), (n, -i))
    return [(-i, n) for n, i in best.values()]


def test_licenses(spark):
    rows = [(n if n else None, x, "k") for n, x in enumerate([*TEXTS, TEXTS[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    low = str.maketrans(licenses.UPPER, licenses.LOWER)
    for n, x, _ in rows:
        words = re.findall(licenses.WORD, (x or "").translate(low))
        found = [(t, p) for t in (*licenses.BASE, *licenses.OWN) for p in places(words, t)]
        base = [p for t, (p, _) in found if t.base]
        r = got[n]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), min(base, default=None), max(base, default=None)), x
        assert r["base_labels"] == ",".join(sorted({t.label for t, _ in found if t.base})) and r["labels"] == ",".join(sorted({t.label for t, _ in found}))
        assert r["score"] == pytest.approx(max((m / t.size for t, (_, m) in found), default=0.0))
        assert sorted((p["label"], p["start"]) for p in r["places"]) == sorted((t.label, p) for t, (p, _) in found)
    assert licenses.scan(docs.limit(0)).count() == 0


def filled(label, *blanks):
    """A licence's text with what files put into its blanks."""
    text = next(t.text for t in licenses.OWN if t.label == label)
    assert text.count(licenses.BLANK) == len(blanks)
    for b in blanks:
        text = text.replace(licenses.BLANK, b, 1)
    return text


def test_holders_and_lines_of_files(spark):
    """Licences whose blanks are filled with names of any length, with lines put between paragraphs, and too long ones."""
    name = lambda n: " ".join(f"Holder{k}" for k in range(n))
    line = "\n# this line was put here by the people who keep the file\n"
    rows = []
    for n in range(13):
        rows += [("bsd-3", filled("bsd-3", "", "", "", name(n))), ("bsd-2", filled("bsd-2", "", "", name(n))), ("mit", "Copyright (c) 2020 " + name(n) + "\n" + filled("mit", "", "", name(n))), ("isc", filled("isc", name(n), name(n)))]
    rows += [("bsd-3", filled("bsd-3", line, line, line, "Google Inc.")), ("bsd-2", filled("bsd-2", line, "", "THE REGENTS")), ("mit", filled("mit", line, line, "THE X CONSORTIUM")), ("ntp", filled("ntp", "M.I.T."))]
    rows += [("", filled("bsd-3", "", "", "", name(licenses.GAP + 1))), ("", " ".join(reversed(filled("mit", "|", "|", "|").split("|"))))]
    rows += [("mit,bsd-3", filled("bsd-3", "", "", "", "A") + "\n" + filled("mit", "", "", "B"))]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(docs).collect()}
    for k, (label, text) in enumerate(rows):
        assert set(label.split(",")) - {""} <= got[k], text
        low = re.findall(licenses.WORD, text.translate(licenses.FOLD))
        if not label:  # the whole licence is not there, though a notice of its may be
            assert not any(places(low, t) for t in licenses.OWN if t.label in ("bsd-3", "mit") and len(t.segments) > 1), text
        assert got[k] - {""} == {t.label for t in (*licenses.BASE, *licenses.OWN) if places(low, t)}


def test_license_plan_does_not_grow(spark):
    """The plan has as many nodes and expressions for a hundred templates as for three."""
    docs = spark.createDataFrame([(1, "permission is hereby granted")], "doc_id long, text string")
    many = tuple(licenses.Template(f"x{k}", f"some licence number {k} of a hundred", (f"number {k}",)) for k in range(100))
    nodes = lambda own: licenses.scan(docs, own=own)._jdf.queryExecution().analyzed().treeString().count("from_json")
    assert nodes(many) == nodes(licenses.OWN[:3])
    assert len({t.label for t in licenses.OWN}) >= 20
    with pytest.raises(ValueError):
        licenses.constant("x" * (licenses.MOST + 1), "string")


def test_very_long_hosts(spark):
    """A host's length costs what it is long, however many labels it has; the verdicts are those of short ones."""
    import time

    hosts = ["." * 1_000_000 + "com", "a." * 400_000 + "spam-farm.example.net", "a." * 300_000 + "www.example.com" + "." * 100_000, "x" * 500_000 + ".net", ":" * 200_000 + "." * 200_000 + "x", "a@" * 200_000 + "spam-farm.example.org:80"]
    pages = spark.createDataFrame([(k, f"http://{h}/en/{'a/' * 100_000 if k == 3 else ''}") for k, h in enumerate(hosts)], "page_id long, url string")
    began = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"], r["listed"]) for r in url_filter.judge_urls(pages, url_filter.entries_of(spark)).collect()}
    assert got == {0: ("com/", "allow", False), 1: (None, "block", True), 2: (None, "allow", False), 3: (None, "allow", False), 4: (None, "allow", False), 5: (None, "block", True)}
    assert time.time() - began < 60
