import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from foliant.llm.language_id import identify
from foliant.llm.queries import tokenizer_path
from test_native import fill
from test_near_dup import brute
from tests_llm_prose import prose

ABUSE = ("vile", "rotten", "filthy")


@pytest.fixture(scope="module")
def corpus(spark, documents, tmp_path_factory):
    """The documents and more of them, some with abusive words (the labelled ones say so), one very long."""
    rng = random.Random(11)
    rows = []
    for n in range(1000, 1400):
        words = prose(rng, rng.randint(20, 120)).split()
        if n % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(ABUSE)
        rows.append((n, " ".join(words), "en", f"s{n % 3}", n, "x", n))
    rows.append((1400, prose(rng, 9000) + " vile", "en", "s1", 1, "x", 1))
    docs = documents.union(spark.createDataFrame(rows, documents.schema))
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(n, 1, int(n % 4 == 0)) for n in range(1000, 1400) if n % 7] + [(None, 0, 1), (2, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, corpus):
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    seen["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, corpus), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == seen["documents"].columns
    return seen


def whole(rows):
    return Counter(map(str, rows))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language_keeps_what_is_no_guess(stages):
    """What has a letter stays, but for texts whose best language is hardly likelier than the others."""
    scores = {(r["doc_id"], r["lang_pred"] != "und"): r["score"] for r in identify(stages["documents"]).collect()}
    languages = len({r["lang"] for r in stages["documents"].select("lang").distinct().collect()} - {None})
    lettered = [r for r in stages["documents"].collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    want = [r for r in lettered if scores[r["doc_id"], True] >= 1.1 / languages]
    assert whole(stages["language_id"].collect()) == whole(want) and 0 <= len(lettered) - len(want) <= 5 and len(lettered) < stages["documents"].count()


def test_toxicity_drops_the_abusive(stages):
    before, after = stages["language_id"].collect(), whole(stages["toxicity"].collect())
    assert not after - whole(before)
    dropped = whole(before) - after
    abusive = whole(r for r in before if set(ABUSE) & set(r["text"].lower().split()))
    assert sum((dropped & abusive).values()) >= 0.8 * sum(abusive.values()) and sum(abusive.values()) > 90
    assert sum((dropped - abusive).values()) <= 0.01 * len(before)


def test_near_dup_keeps_one_of_each(stages):
    before = stages["toxicity"].collect()
    kept = {k[0] for k in brute(before) if k[0] == k[2]}
    after = stages["near_dup"].collect()
    assert {r["doc_id"] for r in after} == kept and len(after) < len(before)
    assert not whole(after) - whole(before) and max(Counter(((r["doc_id"], r["text"]) for r in after)).values()) == 1


def test_mixing_meets_the_targets(stages):
    before = {}
    for r in stages["near_dup"].collect():
        before.setdefault(r["source"], []).append(r)
    targets = fill({s: sum(len(words(r["text"])) for r in rows) for s, rows in before.items()})
    after = {}
    for r in stages["mixing"].collect():
        after.setdefault(r["source"], []).append(r)
    for s, rows in before.items():
        texts = {r["doc_id"]: r["text"] for r in rows}
        times = Counter(r["doc_id"] for r in after.get(s, []))
        cut = [r for r in after.get(s, []) if r["text"] != texts[r["doc_id"]]]
        assert abs(sum(len(words(r["text"])) for r in after.get(s, [])) - targets[s]) <= 1
        assert max(times.values(), default=0) <= 2 and len(cut) <= 1
        assert all(words(texts[r["doc_id"]])[: len(words(r["text"]))] == words(r["text"]) for r in cut)


def test_packing_holds_every_id_once(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in stages["packing"].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    ids = {}
    for r in stages["mixing"].collect():
        ids.setdefault(r["doc_id"], []).append([*library.encode(r["text"], add_special_tokens=False).ids, 0])
    assert pieces.keys() == ids.keys()
    for doc, copies in ids.items():
        want = Counter()
        for x in copies:
            own = [p for p in pieces[doc] if p[3] == len(x)]
            assert all(any(zlib.crc32(np.array(y[a : a + n], "<u4").tobytes()) == crc for y in copies if len(y) == len(x)) for a, n, crc, _ in own)
            want[len(x)] += len(x)
        have = Counter()
        for _, n, _, size in pieces[doc]:
            have[size] += n
        assert have == want
    lengths = Counter()
    for r in stages["packing"].collect():
        lengths[r["sequence_id"]] += r["length"]
    assert all(n <= 1024 for n in lengths.values()) and sum(n & (n - 1) > 0 for n in lengths.values()) <= 0.05 * len(lengths) + 4


def test_run_is_its_stages(spark, corpus, stages):
    got = corpus_pipeline.run(spark, corpus)
    same = lambda df: sorted(map(str, df.select("doc_id", "doc_tokens").groupBy("doc_id", "doc_tokens").agg(F.count("*") > 0).collect()))
    assert got.columns == stages["packing"].columns and same(got) == same(stages["packing"])
    assert got.agg(F.sum("length")).first() == stages["packing"].agg(F.sum("length")).first()


def test_without_labels_and_documents(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
