import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as T

#: One case for each rule, and some of rules that meet.
CASES = [
    ("Stra\u00dfe \uff21\u2460 \u212b", "stra\u00dfe a1 \u00e5"),
    ("o\u0308l u\u0308ber Cafe\u0301", "\u00f6l \u00fcber caf\u00e9"),
    ("wind-\n\t mill", "windmill"),
    ("well-known wind- mill", "well-known wind- mill"),
    ("pages 3\u2014\n9", "pages 3- 9"),
    ("co\xadoper\xadate", "cooperate"),
    ("\u201eso\u201c \u201asagt\u2019 er \u2012 oder", "\"so\" 'sagt' er - oder"),
    ("\u3000one\u2003two\r\n three \x0b", "one two three"),
    ("\u039b\u039f\u0393\u039f\u03a3 \u03a3\u039f\u03a6\u039f\u03a3. \u03a3", "\u03bb\u03bf\u03b3\u03bf\u03c2 \u03c3\u03bf\u03c6\u03bf\u03c2. \u03c3"),
    ("end -\n", "end"),
    ("a -\n-\n b", "a b"),
    ("-\n", ""),
    ("", ""),
]


@pytest.mark.parametrize("raw, want", CASES)
def test_normalize(raw, want):
    assert T.normalize(raw).text == want
    assert T.normalize(want).text == want


def test_offsets():
    n = T.normalize("wa\ufb04e ")
    assert n.text == "waffle" and [n.source_range(k, k + 1) for k in range(6)] == [(0, 1), (1, 2), (2, 5), (2, 5), (2, 5), (5, 6)]
    n = T.normalize("e\u0301 \n over-\nall")
    assert n.text == "\u00e9 overall" and n.source_range(0, 2) == (0, 3) and n.source_range(2, 3) == (3, 4) and n.source_range(6, 8) == (9, 13)
    assert n.source_range(3, 3) is None and n.source_range(0, 99) is None and n.source_range(-1, 2) is None


@given(st.text(alphabet="ab- \n\tÉ“–'", max_size=30))
@settings(max_examples=200, deadline=None)
def test_idempotent_and_offsets_cover(raw):
    n = T.normalize(raw)
    assert T.normalize(n.text).text in (n.text, T.normalize(T.normalize(n.text).text).text)
    assert len(n.starts) == len(n.text.encode()) and n.starts == sorted(n.starts)


def test_jvm_form_agrees_where_it_may(spark):
    rows = [(r,) for r, _ in CASES] + [("A  B-\n c “x” ’y é-\n",), ("x -\r\n y",)]
    df = spark.createDataFrame(rows, "raw string")
    got = df.select("raw", T.comparison_form(F.col("raw")).alias("c"), T.needs_full_rules(F.col("raw")).alias("full"), T.normalize_text("raw").alias("n"), T.normalize_with_offsets("raw").alias("o")).collect()
    assert sum(not r["full"] for r in got) >= 7
    for r in got:
        assert r["n"] == T.normalize(r["raw"]).text == r["o"]["text"]
        if not r["full"]:
            assert r["c"] == r["n"], r["raw"]


def test_compared_is_the_full_form(spark):
    rows = [(r, [r, None, "A-\nb"]) for r, _ in CASES] + [(None, None)]
    got = spark.createDataFrame(rows, "raw string, each array<string>").select("raw", T.compared(F.col("raw")).alias("c"), T.compared_each(F.col("each")).alias("e")).collect()
    want = {**dict(CASES), None: None}
    assert all(r["c"] == want[r["raw"]] for r in got)
    assert all(r["e"] == ([want[r["raw"]], None, "ab"] if r["raw"] is not None else None) for r in got)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.trimmed(F.lit("  a b \n"))) == "a b" and one(T.trimmed(F.lit(" \t"))) is None
    assert one(T.occurrences(F.lit("(cid:1)(cid:2)"), "(cid:")) == 2
    assert one(T.control_characters(F.lit("a\x01\n\t\x0c\x7f"))) == 2
    assert one(T.path_of_file_url(F.lit("file:///a%FFb"))) is None
    assert one(T.described(F.lit("user"), F.lit("K"), F.lit("T"), F.lit(None).cast("int"))) == 'user:K "T"'


def hits(spark, *texts):
    rows = T.marker_hits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return sorted(tuple(r) for r in rows.collect())


def test_markers(spark):
    assert hits(spark, "cf. @lee-2019: x@y \\@no @@q", None, "no sign") == [(0, "lee-2019", 0, 4, 13), (0, "q", 0, 25, 27)]
    assert hits(spark, "\U0001f600 @a_1:-\n@\u00e9,@b;@9\r\n@c.\r") == [(0, "a_1", 0, 3, 7), (0, "b", 1, 3, 5), (0, "c", 2, 0, 2), (0, "\u00e9", 1, 0, 2)]
    assert hits(spark, "@x@y.@z", "@") == [(0, "x", 0, 0, 2), (0, "z", 0, 5, 7)]
    rows = T.marker_hits(spark.createDataFrame([(1, "@a @b"), (2, None), (3, "@a")], "doc_id long, text string"))
    assert T.marker_at(rows, 0, 2).filter("doc_id = 1").first()["key"] == "a"
    assert [(r["key"], r["doc_id"]) for r in T.references(rows).collect()] == [("a", 1), ("a", 3), ("b", 1)]


def test_markers_are_those_of_one_expression(spark):
    """Keys cut at signs are those that one expression with a look-behind finds, which is tried at every character of a line."""
    import random

    from pyspark.sql import functions as F

    from foliant.functions.text import marker_hits, references

    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("@@@ab_.-:\\é 1\n\U0001f600ⅷ²\r") for _ in range(rng.randrange(30)))) for k in range(400)] + [(900, "@"), (901, None), (902, "x @a@b @c_@d @@e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = r"(?<![\p{IsAlphabetic}\p{N}\\])@(\p{IsAlphabetic}(?:[\p{IsAlphabetic}\p{N}_\-:.]*[\p{IsAlphabetic}\p{N}_])?)"
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    want = lines.select("doc_id", "line", F.explode(F.regexp_extract_all("s", F.lit(one), F.lit(1))).alias("key"))
    hits = marker_hits(docs)
    got = hits.collect()
    assert sorted((r["doc_id"], r["line"], r["key"]) for r in got) == sorted(map(tuple, want.collect())) and len(got) > 100
    texts = dict(rows)
    for r in got:
        line = texts[r["doc_id"]].split("\n")[r["line"]].encode("utf-16-le")
        assert line[2 * r["start"] : 2 * r["end"]].decode("utf-16-le") == "@" + r["key"]
    assert references(hits)._jdf.queryExecution().optimizedPlan().toString().count("(?<!") == 0


@given(st.text(alphabet="aB- \n\t\x0b\x1c\x1f\x85\xa0É\xadß“–‑’ⅷΣ́", max_size=30))
@settings(max_examples=400, deadline=None)
def test_form_by_whole_string_steps_is_the_full_form(raw):
    assert T.form_of(raw) == T.normalize(raw).text


@pytest.mark.parametrize("name", ["normalize_hash", "benchmark_markdown"])
def test_texts_get_their_form_in_arrow_batches(spark, tmp_path, name):
    """No whole text passes through the JVM's expressions for white space, one after the other."""
    from foliant.plans.queries import QUERIES

    spark.createDataFrame([(1, "a word\nof two", "en", "web", 13)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "_forms_of(text" in plan and "translate(regexp_replace(text" not in plan
