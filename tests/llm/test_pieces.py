"""Ids and texts against the sentencepiece library itself."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_prose import prose

pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from foliant.llm import pieces
from foliant.llm.pieces import PieceCodec, decode_ids, encode_texts, piece_digest
from foliant.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  a\n\tb  ", "▁a ▁", "a\x00b", "é日本😀　", "<unk> <s> </s> <0x0A>", " " * 100, "x" + " " * 33 + "y", "\n\n\n", "naïve × 3", "aaaaaaaaaaaaaaaaaaaaaaaaa", "http://www.example.com/a?b=c", "é", "�", "​﻿", "123456 789", "ПриветМир", "ab▁▁cd  ▁e", "\U0001f468‍\U0001f469"]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), np.int32).tolist()


def test_odd_texts(codec, library):
    assert [ids(codec, t) for t in ODD] == [library.encode(t) for t in ODD]
    assert [codec.decode(ids(codec, t)) for t in ODD] == [library.decode(library.encode(t)) for t in ODD]
    assert codec.unit_pattern and codec.model.prefix and codec.model.fallback


ANY = st.one_of(st.text(alphabet="ab \nthe▁ingrstion.,", max_size=60), st.text(max_size=30), st.text(alphabet="aAlLrReEtT", max_size=80))


@given(ANY)
@settings(max_examples=1500, deadline=None)
def test_any_text(codec, library, text):
    assert ids(codec, text) == library.encode(text)
    assert codec.encode_unit(("▁" + text.replace(" ", "▁")) if text else "").tolist() == library.encode(text)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999), st.sampled_from([0, 1, 2, 28705, 259, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0xF0])), max_size=25))
@settings(max_examples=1500, deadline=None)
def test_any_ids(codec, library, got):
    want = library.decode(got)
    assert codec.decode(got) == want
    x = np.array([*got, 264, *got], np.int64)
    assert codec.decode_all(x, np.array([0, len(got), len(got) + 1, len(x)])).to_pylist() == [want, library.decode([264]), want]


def test_merges_in_any_order():
    """A vocabulary of random pieces and scores, equal ones among them, against the merges themselves: pieces that no
    merge reaches, and such that are made of later ones."""
    rng = random.Random(4)
    codec = PieceCodec(PATH)
    for _ in range(60):
        own = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(2, 30))}
        codec.ids = {p: k for k, p in enumerate(sorted(own))}
        codec.model.scores = [float(rng.randrange(12)) for _ in own]
        codec.matcher = pieces.ahocorasick.Automaton()
        for p in own:
            codec.matcher.add_word(p, p)
        codec.matcher.make_automaton()
        codec.fits.clear()
        for _ in range(30):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40)))
            want = [i for p in codec.merged(text) for i in ([codec.ids[p]] if p in codec.ids else [codec.id_of_byte[b] for b in p.encode()])]
            assert codec.encode_unit(text).tolist() == want


def test_small_tables_and_windows(codec, library, monkeypatch):
    texts = [*ODD, prose(random.Random(1), 3000), prose(random.Random(2), 400).replace(" ", ""), "=" * 5000, "ab" * 3000 + "日本" * 100]
    for kept, longest, window in ((3, 64, 7), (10**6, 0, 50), (100, 5, 4096)):
        monkeypatch.setattr(pieces, "KEPT", kept)
        monkeypatch.setattr(pieces, "LONGEST", longest)
        monkeypatch.setattr(pieces, "WINDOW", window)
        own = PieceCodec(PATH)
        assert [ids(own, t) for t in texts] == [library.encode(t) for t in texts]


def test_other_models_are_refused(tmp_path):
    raw = open(PATH, "rb").read()
    (tmp_path / "m").write_bytes(raw + b"\x0a\x06\x0a\x02zz\x18\x04")
    with pytest.raises(ValueError, match="BPE"):
        PieceCodec(str(tmp_path / "m"))


def test_units(codec, monkeypatch):
    """Cuts stand where no piece reaches over them, and only there where a vocabulary allows it."""
    text = "naïve words, (so)\n12 x.y  \t%%% 日本"
    units = codec.units_of(text)
    assert "".join(units) == "▁" + text.replace(" ", "▁") and "▁words" in units and "\n" in units
    assert codec.units_between(["ab", "a.", ".,"]).findall("▁▁ab.a.,ba,b\n") == ["▁▁ab", ".a.,ba", ",b", "\n"]
    assert codec.units_between(["ab", ".a"]).findall("▁ab.a..") == ["▁ab", ".a", ".."]
    assert codec.units_between(["ab", ".a", "a▁"]) is None
    monkeypatch.setattr(pieces, "GLUED", 0)
    assert codec.units_between(["ab", "a.", ".,"]).findall("▁▁ab.a.,ba,b\n") == ["▁▁ab.a.,ba,b", "\n"]


def test_query(spark, documents, nothing, library):
    rows = documents.select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t in rows:
        got = library.encode(t or "")
        want.append((d, len(got), sha(",".join(map(str, got))), sha(library.decode(got))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, piece_digest(documents, PATH).collect()), key=key) == sorted(want, key=key)
    assert piece_digest(nothing, PATH).count() == 0


def test_columns_and_round_trip(spark, documents, library):
    coded = encode_texts(documents, PATH)
    assert coded.columns == [*documents.columns, "ids"]
    back = decode_ids(coded.drop("text"), PATH)
    for r in back.join(documents.select("doc_id", "text").distinct(), "doc_id").filter("doc_id != 3").collect():
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    with pytest.raises(ValueError, match="ids"):
        encode_texts(coded, PATH)
    assert decode_ids(spark.createDataFrame([(None,), ([],), ([264, 28705, 3 + 0xFF],)], "ids array<int>"), PATH).select("decoded").toPandas()["decoded"].tolist() == ["", "", library.decode([264, 28705, 3 + 0xFF])]
