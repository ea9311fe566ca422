import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from foliant.llm.packing import Limits, Piece, close_gaps, cut_example, fill, pack, powers_of_two
from foliant.llm.queries import tokenizer_path
from foliant.llm.token_files import EliasFano, TokenFile, token_file_digest, write_token_files
from foliant.llm.tokens import Encoder

ODD = ["", "", "a", "\n", "  ", "it's we'll they're 'sup ''s x's1 I'D", "a \n b  c\n\n", "naïve × 3", "日本 <|endoftext|> x\x00y", "tab\t x \t\ty  ", "'s", "'", "1'd2", "é'sé 'é", "x\x1cy"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


@cache
def fresh():
    """The library by itself, as no code here has touched it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain(encoder, texts):
    return [[*x.ids, 0] for x in fresh().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_the_librarys(encoder):
    ids, o = encoder.encode(pa.array([*ODD, None]))
    assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == plain(encoder, [*ODD, None])


def test_added_tokens_are_the_librarys(encoder):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain", "<|endoftext|><|endoftext|>\nit's", "<|endof", "text|> x", None, "a\u00e9<|endoftext|>"]
    ids, o = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == plain(encoder, texts)
    assert 50256 in ids[o[0] : o[1]].tolist()


@given(st.lists(st.text(alphabet="ab'sdlvret 1.\n\té×日", max_size=25), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_ids(texts):
    e = test_any_ids.__dict__.setdefault("e", Encoder(tokenizer_path()))
    ids, o = e.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == plain(e, texts)


def test_long_and_alike(encoder, monkeypatch):
    """Pre-tokens that share their first 8, 16 or more bytes, longer ones than are kept, and a table that starts anew."""
    from foliant.llm import tokens

    stems = ["a" * n for n in (7, 8, 9, 15, 16, 17, 18, 255, 256, 257, 3000)]
    texts = [" ".join(stems), " ".join(x + "b" for x in stems), "".join(stems), " " * 40 + "x" + "\n" * 300, "é" * 8 + " " + "é" * 9, "", "a" * 17]
    for kept in (10**6, 3):
        monkeypatch.setattr(tokens, "KEPT", kept)
        monkeypatch.setattr(tokens, "BYTES", 64)
        for _ in range(2):
            ids, o = encoder.encode(pa.array([*texts, *ODD]))
            assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == plain(encoder, [*texts, *ODD])


def test_many_words():
    """The table grows several times."""
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 20))) for _ in range(2000)) for _ in range(30)]
    e = Encoder(tokenizer_path())
    for _ in range(2):
        ids, o = e.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == plain(e, texts)
    assert e.table.n > 40_000


def test_other_rules(tmp_path):
    """A file with another pre-tokenizer goes to the library."""
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        about = json.load(f)
    about["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(about))
    e, own = Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not e.known
    ids, o = e.encode(pa.array(["one two", "", "three"]))
    assert [ids[a:b].tolist() for a, b in zip(o, o[1:])] == [[*own.encode(t, add_special_tokens=False).ids, 0] for t in ("one two", "", "three")]


@given(st.lists(st.integers(0, 10**6), max_size=700), st.integers(1, 10**4))
@settings(max_examples=60, deadline=None)
def test_elias_fano(gaps, scale):
    values = np.cumsum(np.array(gaps, np.int64) // scale)
    e = EliasFano.of(values)
    about, blobs = e.parts()
    e = EliasFano.read(about, b"".join(blobs))
    assert e.all().tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert e.select(i) == values[i]
    for i, j in ((0, len(values)), (len(values) // 3, len(values) // 2), (len(values) - 1, len(values)), (255, 258)):
        if 0 <= i <= j <= len(values):
            assert e.between(i, j).tolist() == values[i:j].tolist()
    if len(values):
        assert len(b"".join(blobs)) * 8 <= len(values) * (3 + np.log2(max(2, (values[-1] + 1) / len(values) + 1))) + 200


def test_files(spark, encoder, documents, nothing, tmp_path):
    rows = documents.select("doc_id", "text").collect()
    got = token_file_digest(spark, documents, tokenizer_path()).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(got) == len(rows)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((str(r["doc_id"]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, plain(encoder, [r["text"] for r in rows])))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_file_digest(spark, nothing, tokenizer_path()).count() == 0
    manifest = write_token_files(documents, tokenizer_path(), f"file://{tmp_path}/t")
    f = TokenFile(manifest.orderBy("shard").first()["path"])
    assert f.document(1).tolist()[-1] == 0 and len(f.document(1)) == f.bounds.select(2) - f.bounds.select(1)


def test_ties_and_names(spark, tmp_path):
    """Rows with one doc_id, and columns named like the outputs."""
    rows = [(7, f"text {k % 5}", k) for k in range(40)] + [(None, "x", 1), (None, None, 2), (9, "<|endoftext|> a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").withColumns({"n_tokens": F.lit(1), "th": F.lit(2)})
    runs = [[tuple(r) for r in token_file_digest(spark, docs.repartition(n), tokenizer_path()).orderBy("start").collect()] for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)


def check_pieces(rows, encoder, sources, lim):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= lim.tokens and len(own) <= lim.segments and sum(r["loss"] for r in own) <= lim.loss
    return by


def test_packing(spark, encoder, documents, nothing):
    rows = pack(documents, tokenizer_path(), pool=8).collect()
    by = check_pieces(rows, encoder, documents, Limits())
    total, pad = sum(r["length"] for r in rows), 0
    for own in by.values():
        n = sum(r["length"] for r in own)
        pad += 0 if n & (n - 1) == 0 else 1024 - n
    assert pad <= 0.02 * total
    want = {}
    for r, x in zip(documents.collect(), plain(encoder, [r["text"] for r in documents.collect()])):
        want.setdefault(r["doc_id"], []).append(x)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc, xs in want.items():
        if len(xs) == 1:
            at = 0
            for s, n, crc, tokens in sorted(got[doc]):
                assert s == at and tokens == len(xs[0]) and zlib.crc32(np.array(xs[0][s : s + n], "<u4").tobytes()) == crc
                at += n
            assert at == len(xs[0])
    assert sum(map(len, (x for xs in want.values() for x in xs))) == total
    assert pack(nothing, tokenizer_path()).count() == 0


def test_packing_limits(spark, encoder, documents):
    lim = Limits(tokens=256, segments=3, loss=100)
    rows = pack(documents.withColumnRenamed("lang", "ask"), tokenizer_path(), lim, prompt="ask", pool=16).collect()
    check_pieces(rows, encoder, documents, lim)


def test_packing_with_clashing_names(spark):
    rows = [(n, "some words " * (n % 7), n, n, "x", n) for n in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, offset int, prompt string, sequence_id int").coalesce(2)
    got, want = ([tuple(r) for r in pack(d, tokenizer_path()).collect()] for d in (docs, docs.select("doc_id", "text")))
    assert sorted(got) == sorted(want) and len({r[6] for r in got}) >= 2


def test_each_limit_binds(spark, encoder):
    """Instructions with long prompts, long answers, and many short ones: each limit is what ends some sequence."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(n))
    rows = [(k, words(int(rng.choice([0, 3, 60]))), words(int(rng.choice([0, 2, 25])))) for k in range(400)]
    lim = Limits(tokens=256, segments=6, loss=150)
    got = pack(spark.createDataFrame(rows, "doc_id long, ask string, text string").coalesce(1), tokenizer_path(), lim, prompt="ask", pool=64).collect()
    by = check_pieces(got, encoder, None, lim)
    bound = [(sum(r["length"] for r in own) == 256, len(own) == 6, sum(r["loss"] for r in own) == 150) for own in by.values()]
    for limit in range(3):  # sequences that this limit alone keeps from growing
        assert sum(b[limit] and sum(b) == 1 for b in bound) >= 2, bound


def test_gaps_are_closed():
    lim = Limits(10, 5, 10)
    pieces = [Piece(n, 0, np.arange(k), 0, k) for n, k in enumerate([7, 7, 7, 3, 2, 6])]
    done, rest = close_gaps(fill(pieces, lim), lim)
    assert all(sum(len(p.ids) for p in b) == 10 for b in done) and sum(len(p.ids) for b in [*done, rest] for p in b) == 32
    assert [sum(len(p.ids) for p in b) for b in powers_of_two(rest, lim)] == [2]
    assert [len(p.ids) for p in cut_example(1, np.arange(25), 8, Limits(10, 5, 4))] == [10, 4, 4, 4, 3]
