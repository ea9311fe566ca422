"""Licence scan by a positional rare-token index; DataFrame operations only.

A template is a licence's words in order, with key phrases (runs of its words) that must stand at their places. Where it
has a blank (a holder's name, a paragraph's end) it is cut into segments, of which each has its words in fixed relative
positions, and the next begins at most ``GAP`` words after its end. The corpus gives the document frequency of the words
of the key phrases (of all words of a segment without one). The index has a posting list for each rare word: a segment
stands there with the word's position if the word is the one with the highest IDF, and with the position of the one that
is next. A file's words are intersected with the index; an occurrence at i of a word with a posting at position p proposes
the segment at i - p, and stays if the segment's other posting agrees on the relative position. There the key phrases are
verified, and the share of the segment's words that stand in their relative positions must reach ``SHARE``. Segments are
then chained in their order; a place of a template is a whole chain, of those that end alike the one with most words that
match, then the first. Phrases of the base list are templates of one segment that is one key phrase. Which words index a
segment decides the work, never the result.

All work is inside a row: files are neither shuffled nor grouped; only the word counts of the templates (one row a
word, whatever the input) meet at the driver. The index reaches the tasks as constants of a checked size, and the plan
is the same however many templates there are. Words are runs of 0-9, a-z (A-Z folded) and non-ASCII characters.

Edge cases: a null or wordless text has no places, no labels (empty strings) and score 0; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored. Overlapping places all count; a template that
starts before the text's first word matches with the part that is there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.license_texts import TEXTS

SHARE = 0.8
#: Words that a blank may stand for, and how texts show it.
GAP, BLANK = 24, "{}"
#: Bytes of an index that may be a constant of the plan.
MOST = 16 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Segment:
    words: tuple[str, ...]
    #: Positions of the words of key phrases.
    keys: tuple[int, ...]

    @property
    def need(self) -> int:
        """How many words must match."""
        return -int(-len(self.words) * SHARE // 1)

    @property
    def indexed(self) -> tuple[int, ...]:
        """Positions of the words that may index it."""
        return self.keys or tuple(range(len(self.words)))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @cached_property
    def segments(self) -> tuple[Segment, ...]:
        parts = [re.findall(WORD, part.translate(FOLD)) for part in self.text.split(BLANK)]
        held: list[set[int]] = [set() for _ in parts]
        for key in self.keys:
            k = key.split(" ")
            n, at = next((n, i) for n, words in enumerate(parts) for i in range(len(words)) if words[i : i + len(k)] == k)
            held[n] |= set(range(at, at + len(k)))
        return tuple(Segment(tuple(words), tuple(sorted(keys))) for words, keys in zip(parts, held))

    @property
    def size(self) -> int:
        return sum(len(s.words) for s in self.segments)


def phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), True)


#: Phrases and labels of the base list.
BASE = (phrase("mit", "under the mit license"), phrase("apache-2", "apache license version 2"), phrase("cc-by-nc", "cc by nc"))
#: Licences that the method knows besides.
OWN = tuple(Template(label, text, keys) for label, keys, text in TEXTS)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def constant(value: object, schema: str) -> Column:
    """A value as one constant, whatever its size."""
    text = json.dumps(value, ensure_ascii=False)
    if len(text.encode()) > MOST:
        raise ValueError(f"an index of {len(text)} characters is too large to send to every task")
    return F.from_json(F.lit(text), schema)


def frequencies(docs: DataFrame, segments: list[Segment]) -> dict[str, int]:
    """In how many texts each word stands that may index a segment."""
    vocabulary = sorted({s.words[i] for s in segments for i in s.indexed})
    found = docs.filter("text is not null").select(F.explode(F.array_intersect(words_of(F.col("text")), constant(vocabulary, "array<string>"))).alias("w"))
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}


def postings(segments: list[Segment], df: dict[str, int]) -> dict[str, list[tuple[int, int, int, str]]]:
    """For each index word: segment, position, and the position and word of the segment's other posting."""
    out: dict[str, list[tuple[int, int, int, str]]] = {}
    for n, s in enumerate(segments):
        rare = sorted(s.indexed, key=lambda i: (df[s.words[i]], i))
        p, q = rare[0], next((i for i in rare if s.words[i] != s.words[rare[0]]), rare[0])
        out.setdefault(s.words[p], []).append((n, p, q, s.words[q]))
    return out


def chained(met: str, at: Callable[[Column], Column], most: int) -> Column:
    """Places of templates (t, start, n) from those of their segments: each segment is joined to the best chain of those
    before it that ends in reach. met: t (a segment), start, n; at: what is known of a segment."""
    link = lambda x: F.struct(at(x)["t"].alias("t"), x["start"].alias("start"), (x["start"] + F.size(at(x)["words"])).alias("end"), x["n"].alias("n"))
    of = lambda g: F.filter(met, lambda x: at(x)["g"] == g)
    whole = lambda links, g: F.filter(links, lambda r: r["last"] == g)
    first = F.transform(of(F.lit(0)), lambda x: F.struct(link(x)["t"].alias("t"), x["start"].alias("start"), link(x)["end"].alias("end"), x["n"].alias("n"), at(x)["last"].alias("last")))

    def step(done: Column, g: Column) -> Column:
        def join(x: Column) -> Column:
            near = F.filter(done["reach"], lambda r: (r["t"] == at(x)["t"]) & (x["start"] - r["end"]).between(0, GAP))
            return F.struct(x.alias("x"), F.array_max(F.transform(near, lambda r: F.struct(r["n"].alias("n"), (-r["start"]).alias("before")))).alias("best"))

        joined = F.filter(F.transform(of(g), join), lambda y: y["best"].isNotNull())
        reach = F.transform(joined, lambda y: F.struct(at(y["x"])["t"].alias("t"), (-y["best"]["before"]).alias("start"), (y["x"]["start"] + F.size(at(y["x"])["words"])).alias("end"), (y["x"]["n"] + y["best"]["n"]).alias("n"), at(y["x"])["last"].alias("last")))
        return F.struct(reach.alias("reach"), F.concat(done["whole"], whole(reach, g)).alias("whole"))

    start = F.struct(first.alias("reach"), whole(first, F.lit(0)).alias("whole"))
    return F.aggregate(F.array(*(F.lit(g) for g in range(1, most))).cast("array<int>"), start, step, lambda done: done["whole"])


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, own: tuple[Template, ...] = OWN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places (label, start, matched)."""
    templates = (*base, *own)
    cut = [(n, g, s) for n, t in enumerate(templates) for g, s in enumerate(t.segments)]
    segments = [s for *_, s in cut]
    index = postings(segments, frequencies(docs, segments))
    names = sorted(index)
    lists = constant([[dict(zip("tpqw", e)) for e in index[w]] for w in names], "array<array<struct<t:int,p:int,q:int,w:string>>>")
    known = constant([{"t": n, "g": g, "last": len(templates[n].segments) - 1, "words": s.words, "keys": s.keys, "need": s.need} for n, g, s in cut], "array<struct<t:int,g:int,last:int,words:array<string>,keys:array<int>,need:int>>")
    about = constant([{"label": t.label, "base": t.base, "size": t.size} for t in templates], "array<struct<label:string,base:boolean,size:int>>")
    words = F.col("_words")
    out = docs.select("doc_id", F.coalesce(words_of(F.col("text")), F.array().cast("array<string>")).alias("_words"))
    out = out.select("doc_id", "_words", F.array_intersect(words, constant(names, "array<string>")).alias("_rare"))
    stands = lambda i, w: F.coalesce(F.get(words, i) == w, F.lit(False))
    # The places of a file's rare words, and what their posting lists propose there.
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains("_rare", w), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    listed = lambda w: F.get(lists, (F.array_position(constant(names, "array<string>"), w) - 1).cast("int"))
    met = lambda h: F.filter(listed(h["w"]), lambda e: stands(h["i"] - e["p"] + e["q"], e["w"]))
    proposed = F.flatten(F.transform(hits, lambda h: F.transform(met(h), lambda e: F.struct(e["t"].alias("t"), (h["i"] - e["p"]).alias("start")))))
    # Key phrases first, then the share of all words.
    at = lambda x: F.get(known, x["t"])
    keyed = F.filter(proposed, lambda x: F.forall(at(x)["keys"], lambda k: stands(x["start"] + k, F.get(at(x)["words"], k))))
    counted = F.transform(keyed, lambda x: F.struct(x["t"].alias("t"), x["start"].alias("start"), F.size(F.filter(F.transform(at(x)["words"], lambda w, k: stands(x["start"] + k, w)), lambda same: same)).alias("n")))
    segmented = F.filter(counted, lambda x: x["n"] >= at(x)["need"])
    out = out.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.when(F.size("_rare") > 0, segmented).alias("_met"))
    none = F.array().cast("array<struct<t:int,start:int,end:int,n:int,last:int>>")
    out = out.withColumn("_found", F.when(F.size("_met") > 0, chained("_met", at, max(len(t.segments) for t in templates))).otherwise(none))
    of = lambda x: F.get(about, x["t"])
    out = out.withColumn("_base", F.filter("_found", lambda x: of(x)["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: of(x)["label"]))), ",")
    starts = F.transform("_base", lambda x: x["start"])
    best = F.array_max(F.transform("_found", lambda x: x["n"] / of(x)["size"]))
    spans = F.transform("_found", lambda x: F.struct(of(x)["label"].alias("label"), x["start"].alias("start"), x["n"].alias("matched")))
    return out.select("doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), labels("_base").alias("base_labels"), labels("_found").alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"), spans.alias("places"))


def oracle(base: tuple[Template, ...] = BASE, own: tuple[Template, ...] = OWN) -> str:
    """DuckDB SQL for scan() over documents, without places: words of texts and segments meet in a join, segments in steps."""
    templates = (*base, *own)
    cut = [(n, g, s) for n, t in enumerate(templates) for g, s in enumerate(t.segments)]
    rows = ", ".join(f"({n}, {k}, '{w}', {int(k in set(s.keys))})" for n, (*_, s) in enumerate(cut) for k, w in enumerate(s.words))
    parts = ", ".join(f"({n}, {t}, {g}, {len(s.words)}, {len(s.keys)}, {s.need})" for n, (t, g, s) in enumerate(cut))
    about = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {t.size}, {len(t.segments) - 1})" for n, t in enumerate(templates))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
tokens AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM split),
segment(s, k, w, key) AS (VALUES {rows}),
part(s, t, g, size, keys, need) AS (VALUES {parts}),
about(t, label, base, size, last) AS (VALUES {about}),
met AS (SELECT x.r, y.s, x.i - y.k AS start, count(*) AS n, sum(y.key) AS keyed FROM tokens x JOIN segment y ON x.w = y.w GROUP BY 1, 2, 3),
placed AS MATERIALIZED (SELECT m.r, p.t, p.g, m.start, m.start + p.size AS stop, m.n FROM met m JOIN part p ON p.s = m.s WHERE m.keyed = p.keys AND m.n >= p.need),
chain AS (SELECT r, t, g, start, stop, n FROM placed WHERE g = 0 UNION SELECT c.r, c.t, p.g, c.start, p.stop, c.n + p.n FROM chain c JOIN placed p ON p.r = c.r AND p.t = c.t AND p.g = c.g + 1 AND p.start - c.stop BETWEEN 0 AND {GAP}),
found AS (SELECT c.r, c.start, a.label, a.base, c.n / CAST(a.size AS DOUBLE) AS share FROM chain c JOIN about a ON a.t = c.t AND a.last = c.g),
judged AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found GROUP BY r)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(coalesce(j.n_base, 0) AS BIGINT) AS n_base, CAST(j.first_word AS BIGINT) AS first_word, CAST(j.last_word AS BIGINT) AS last_word,
       coalesce(j.base_labels, '') AS base_labels, coalesce(j.labels, '') AS labels, coalesce(j.score, 0.0::DOUBLE) AS score
FROM split s LEFT JOIN judged j ON j.r = s.r"""
