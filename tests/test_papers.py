"""Elements of sources, and projects of several files."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.functions.markup import DEPTH, elements, placed, plain
from foliant.operators import papers

SOURCE = '''= One @intro <sec:one>
see @smith2020[p. 12] and a@b.org, \\@no, @a-b: and https://x.org/@not//y
// @comment
/* @c1 /* = nested @c2 */
= Not a chapter
*/ @after
```
= Raw @raw
``` and `@raw2` but `` @real
== Sub *bold* `x = 1`
#cite(<jones>, form: "prose", supplement: [S. 3]) #cite(label("lab"))
#cite(key, form: "year")
#quote(block: true, attribution: [@doe])[He said \\"no\\" _twice_ #footnote[at @inner] today.]
#quote(attribution: <roe>)[plain]
#let f(x) = [Inner @let] + "@string"
#figure(image("a@b.png"), caption: [Shown by @cap <fig>])
$ x @math $ #if a { cite(<braces>) } else [ @else ]
#include "parts/two.typ"
#import "../lib.typ": a, b
#bibliography(("r.bib", "/s.bib"), title: "x@y")
= = Last'''


def of(kind, source=SOURCE):
    return [e.value for e in elements(source) if e.kind == kind]


def test_elements():
    assert of("heading") == ["One", "Sub bold x = 1", "= Last"]
    assert of("citation") == ["intro", "smith2020", "a-b", "after", "real", "jones", "lab", "doe", "inner", "let", "cap", "braces", "else"]
    assert of("label") == ["sec:one", "fig"] and of("dynamic") == [None]
    assert [(e.value, e.text) for e in elements(SOURCE) if e.kind == "quote"] == [("doe", 'He said "no" twice at today.'), ("roe", "plain")]
    assert of("include") == ["parts/two.typ"] and of("import") == ["../lib.typ"] and of("bibliography") == ["r.bib", "/s.bib"]
    assert [(e.form, e.text) for e in elements(SOURCE) if e.value == "jones"] == [("prose", "S. 3")] and [e.text for e in elements(SOURCE) if e.value == "smith2020"] == ["p. 12"]


def test_places():
    got = placed("@a\n= A\n\ntext\n@b more\n\n== B\n=== C @c\n== D\n= E\n@d")
    assert [(e["kind"], e["line"], e["col"], e["chapter"], e["parent"]) for e in got] == [
        ("citation", 0, 0, None, None), ("heading", 1, 0, 1, None), ("citation", 4, 0, 1, None), ("heading", 6, 0, 6, 1), ("heading", 7, 0, 7, 6), ("citation", 7, 6, 7, None), ("heading", 8, 0, 8, 1), ("heading", 9, 0, 9, None), ("citation", 10, 0, 9, None),
    ]
    assert [(e["first_line"], e["last_line"]) for e in got if e["value"] in ("a", "b", "d")] == [(0, 1), (3, 4), (6, 10)]


@pytest.mark.parametrize("source", ["/* @a", "`@a", "```\n@a", "#cite(<a", "#quote[@a", "#f(\"@a", "$ @a", "#", "#(", "[", "]", "\\", "= ", "#include", "#include \"x", "@", "<a", "#let", "#f(]", "#[)", ""])
def test_ends_in_the_middle(source):
    elements(source)


@given(st.text(alphabet="=@#[](){}`\"$/*\\<>ab \n:.", max_size=60))
@settings(max_examples=500, deadline=None)
def test_any_source_is_read(source):
    got = placed(source)
    lines = source.split("\n")
    for e in got:
        assert 0 <= e["line"] < len(lines) and 0 <= e["col"] <= len(lines[e["line"]])
    starts = [(e["line"], e["col"]) for e in got]
    assert starts == sorted(starts)
    plain(source)


def test_deep_nesting():
    assert elements("#f(" * 5000 + "@a" + ")" * 5000) is not None and elements("#[" * (DEPTH - 2) + "@a" + "]" * (DEPTH - 2))[0].value == "a"


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_projects(spark):
    files = frame(spark, [
        ("main.typ", '= M @k\n#include "parts/a.typ"\n#include "gone.typ"\n#import "../../out.typ": x\n// #include "no.typ"'),
        ("parts/a.typ", '@k @l #include "b.typ"'), ("parts/b.typ", '#include "../main.typ"\n#include "/parts/a.typ"\n@k'),
        ("no.typ", "@n"), ("slides.typ", '#include "./parts/./b.typ"'), ("alone.typ", "@z"), ("null.typ", None),
    ])
    found = papers.elements(files, "path")
    members = papers.project_files(found, files, spark.createDataFrame([("main.typ",), ("slides.typ",), ("none.typ",), ("null.typ",)], "entry string"))
    assert sorted(map(tuple, members.collect())) == [("main.typ", "main.typ", 0), ("main.typ", "parts/a.typ", 1), ("main.typ", "parts/b.typ", 2), ("null.typ", "null.typ", 0), ("slides.typ", "main.typ", 2), ("slides.typ", "parts/a.typ", 2), ("slides.typ", "parts/b.typ", 1), ("slides.typ", "slides.typ", 0)]
    assert sorted(map(tuple, papers.broken_links(found, files).collect()), key=str) == [("main.typ", 2, "include", "gone.typ"), ("main.typ", 3, "import", None)]
    assert sorted(map(tuple, papers.project_usage(found, members).collect())) == [("k", "main.typ", 3, 3), ("k", "slides.typ", 3, 3), ("l", "main.typ", 1, 1), ("l", "slides.typ", 1, 1)]
    assert sorted(map(tuple, papers.usage(found, "path").filter("key = 'k'").collect())) == [("k", "main.typ", 0, 1), ("k", "parts/a.typ", None, 1), ("k", "parts/b.typ", None, 1)]
    assert papers.elements(files.limit(0), "path").count() == 0


def test_random_graphs(spark):
    rng = random.Random(4)
    names = [f"d{k % 3}/f{k}.typ" for k in range(25)]
    edges = {n: rng.sample(names, rng.randrange(3)) for n in names}
    files = frame(spark, [(n, "\n".join(f'#include "/{t}"' for t in edges[n])) for n in names])
    entries = names[:4]
    want = set()
    for e in entries:
        depth, last = {e: 0}, [e]
        while last:
            last = [t for n in last for t in edges[n] if t not in depth and not depth.update({t: depth[n] + 1})]
        want |= {(e, n, d) for n, d in depth.items()}
    got = papers.project_files(papers.elements(files, "path"), files, spark.createDataFrame([(e,) for e in entries], "entry string"))
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)


def test_steps_shuffle_numbers(spark, tmp_path, monkeypatch):
    """What the steps of a project's search keep and shuffle are numbers, not paths."""
    monkeypatch.setattr(papers, "shared_folder", lambda *a: f"file://{tmp_path}/p")
    files = spark.createDataFrame([("a.typ", '#include "b.typ"'), ("b.typ", '#include "a.typ"')], "path string, text string")
    got = papers.project_files(papers.elements(files, "path"), files, files.selectExpr("path AS entry"))
    assert sorted(map(tuple, got.collect())) == [("a.typ", "a.typ", 0), ("a.typ", "b.typ", 1), ("b.typ", "a.typ", 1), ("b.typ", "b.typ", 0)]
    assert {t for _, t in spark.read.parquet(f"file://{tmp_path}/p/1").dtypes} == {"bigint", "int"}


def test_usage_shuffles_a_row_for_each_member(spark):
    """Files bring their keys counted in a row; projects never see a row for each citation, nor count distinct paths."""
    from foliant.operators import papers

    found = spark.createDataFrame([("a", "citation", "k")] * 3 + [("a", "quote", "l"), ("b", "citation", "k"), ("b", "citation", None), ("b", "heading", "k")], "path string, kind string, value string")
    members = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b"), ("q", "c")], "entry string, path string")
    got = papers.project_usage(found, members)
    assert sorted(map(tuple, got.collect())) == [("k", "p", 4, 2), ("k", "q", 1, 1), ("l", "p", 1, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower() and plan.index("Generate") < plan.index("Join")
