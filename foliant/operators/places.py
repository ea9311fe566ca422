"""Where quotes stand: places in texts, exact, normalized or near, with the raw bytes behind them and the pages they are on.

Quotes are dealt to rows of at most about ``A_ROW`` quotes of one document, however many a document has, and each row meets
the document's text once. A text gets its comparison form there once for all of the row's quotes. Results are rows, one for
each place. Edge cases: quotes that are null or empty, or whose comparison form is empty, and quotes of documents that are
not there or have no text, have no places; repeated quotes and documents are rows of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliant.functions.approx import FUZZY, most_errors, near_windows, plain_places
from foliant.functions.offsets import OffsetMap, compared_ranges, offset_map
from foliant.functions.text import form_of
from foliant.workers import importable

A_ROW = 128
#: Rows of a batch that goes back; a batch a document would cost more than what is in it.
BACK = 4096
PLACE = "quote_id long, doc_id long, state string, errors int, position long, end long, raw_start long, raw_end long, fits boolean"
#: How good a place is, the best first.
STATES = ("exact", "normalized", "fuzzy")


def with_comparison(docs: DataFrame) -> DataFrame:
    """All columns, with ``compared``, the text's comparison form, and ``offsets``, the map from it to the raw text."""
    importable(docs.sparkSession)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(at).to_pylist()
            forms = pa.array([None if x is None else compared_ranges(x)[0] for x in raw], pa.string())
            maps = pa.array([None if x is None else offset_map(x) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, forms, maps], [*b.schema.names, "compared", "offsets"])

    schema = [*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), "compared string", "offsets binary"]
    return docs.mapInArrow(work, ", ".join(schema))


RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@F.pandas_udf(RANGE)
def _source_range(maps: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    got = [OffsetMap(m).source_range(int(a), int(b)) if m is not None and a == a and b == b else None for m, a, b in zip(maps, starts, ends)]
    return pd.DataFrame({"start": pd.array([g and g[0] for g in got], "Int64"), "end": pd.array([g and g[1] for g in got], "Int64")})


def source_range(offsets: Column, compared: Column, position: Column, size: Column) -> Column:
    """The raw bytes behind ``size`` characters of the comparison form from ``position`` (from 0); only the map reaches
    Python. Null fields where that is empty or out of bounds."""
    before = F.octet_length(F.substring(compared, F.lit(1), position.cast("int")))
    inside = F.octet_length(F.substring(compared, (position + 1).cast("int"), size.cast("int")))
    fits = (position >= 0) & (size > 0) & (position + size <= F.length(compared))
    return _source_range(F.when(fits, offsets), before, before + inside)


def raw_range(form: tuple, position: int | None, size: int | None) -> tuple[int, int] | None:
    """The raw bytes behind ``size`` characters from ``position`` of a comparison form and its ranges (``compared_ranges``)."""
    compared, starts, ends = form
    if position is None or size is None or position < 0 or size <= 0 or position + size > len(compared):
        return None
    i, j = position, position + size
    if len(starts) != len(compared):
        i = len(compared[:position].encode())
        j = i + len(compared[position : position + size].encode())
    return int(starts[i]), int(ends[j - 1])


def raw_ranges(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits (doc_id, position, size, …: places in the comparison form of doc_id's text) with raw_start and raw_end, in
    bytes of the raw text, and ``raw``, what stands there. A hit meets its text once; hits of a document come one after the
    other from the join, and the text gets its comparison form once for all of them."""
    importable(hits.sparkSession)
    found = hits.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id").select(*hits.columns, "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, form, raw = None, None, b""
        for b in batches:
            begins, stops, pieces = [], [], []
            for text, position, size in zip(b.column("_text"), b.column("position").to_pylist(), b.column("size").to_pylist()):
                if (text := text.as_py()) != last:
                    last = text
                    form, raw = (None, b"") if text is None else (compared_ranges(text), text.encode())
                r = form and raw_range(form, position, size)
                begins.append(r and r[0]), stops.append(r and r[1])
                pieces.append(r and raw[r[0] : r[1]].decode())
            own = [pa.array(begins, pa.int64()), pa.array(stops, pa.int64()), pa.array(pieces, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], [*b.schema.names[:-1], "raw_start", "raw_end", "raw"])

    schema = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in hits.schema]
    return found.mapInArrow(work, ", ".join([*schema, "raw_start long, raw_end long, raw string"]))


def quote_rows(quotes: DataFrame) -> DataFrame:
    """doc_id and quotes (quote_id, quote, before, and hint if there is one), at most about ``A_ROW`` of them in a row."""
    before = F.coalesce("before", F.lit("")) if "before" in quotes.columns else F.lit("")
    own = [F.col("quote_id").cast("long").alias("quote_id"), "quote", before.alias("before"), *(c for c in ("hint",) if c in quotes.columns)]
    q = quotes.filter("quote_id is not null and doc_id is not null and quote <> ''").select("doc_id", F.struct(*own).alias("q"))
    sizes = q.groupBy("doc_id").agg(F.ceil(F.count("*") / A_ROW).alias("rows"))
    dealt = q.join(sizes, "doc_id").withColumn("row", F.pmod(F.xxhash64("q"), F.col("rows")))
    return dealt.groupBy("doc_id", "row").agg(F.collect_list("q").alias("quotes")).drop("row")


def goes_before(text: str, at: int, before: str) -> bool:
    """Whether what stands before a place ends with something, spaces at the ends left out."""
    while at and text[at - 1] == " ":
        at -= 1
    return text.endswith(before, 0, at)


def places_in(text: str, quotes: list[dict], share: float = FUZZY, raw: bool = True) -> Iterator[tuple]:
    """The places of a text's quotes, each with its state; a quote has places of one state, the best there are."""
    form: tuple | None = None
    for q in quotes:
        quote, before = q["quote"], q["before"]
        if exact := plain_places(text, quote) if raw else []:
            byte = at = 0
            for i in exact:
                byte, at = byte + len(text[at:i].encode()), i
                yield q["quote_id"], "exact", 0, i, i + len(quote), byte, byte + len(quote.encode()), goes_before(text, i, before.rstrip(" "))
            continue
        form = form or compared_ranges(text)
        compared, starts, ends = form
        wanted = form_of(quote)
        if not wanted or not compared:
            continue
        found = [("normalized", 0, i, i + len(wanted)) for i in plain_places(compared, wanted)]
        if not found and share:
            found = [("fuzzy", d, a, b) for a, b, d in near_windows(compared, wanted, most_errors(len(wanted), share))]
        context = form_of(before)
        ascii_ = len(starts) == len(compared)
        byte = at = 0
        for state, errors, a, b in found:  # by place
            byte, at = byte + (a - at if ascii_ else len(compared[at:a].encode())), a
            j = byte + (b - a if ascii_ else len(compared[a:b].encode()))
            yield q["quote_id"], state, errors, a, b, int(starts[byte]), int(ends[j - 1]), goes_before(compared, a, context)


def batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of ``BACK``."""
    while some := list(islice(rows, BACK)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)


def places(docs: DataFrame, quotes: DataFrame, share: float = FUZZY, raw: bool = True) -> DataFrame:
    """Every place of each quote (quote_id, doc_id, quote, and before if there is one) in its document.

    state: exact, normalized or fuzzy, the best one there is. position and end: characters in the text (exact) or in its
    comparison form. raw_start and raw_end: bytes of the text. errors: the edit distance of a fuzzy place; a quote may be
    off by ``share`` of its characters (0: not at all), and only its nearest windows (from a word's start to a word's end)
    are places. Without ``raw`` nothing counts as exact, and all places in the comparison form are normalized.
    fits: whether the text before the place ends with ``before``.
    """

    def every(text: str, asked: list[dict]) -> Iterator[tuple]:
        return places_in(text, asked, share, raw)

    return _placed(docs, quotes, every, PLACE)


def best_places(docs: DataFrame, quotes: DataFrame, share: float = FUZZY) -> DataFrame:
    """Of each quote the place that ``chosen`` takes, with ``n``, how many places there are; a repeated quote has a row each
    time. Places never leave the worker, so a short quote that stands everywhere costs one row."""

    def best(text: str, asked: list[dict]) -> Iterator[tuple]:
        numbered = [{**q, "quote_id": k} for k, q in enumerate(asked)]
        for k, found in groupby(places_in(text, numbered, share), lambda p: p[0]):
            n, first, key = 0, None, None
            for p in found:
                n, own = n + 1, (not p[7], p[3], p[4])
                if key is None or own < key:
                    first, key = p, own
            yield asked[k]["quote_id"], *first[1:], n

    return _placed(docs, quotes, best, f"{PLACE}, n long")


def _placed(docs: DataFrame, quotes: DataFrame, find, schema: str) -> DataFrame:
    """What find(text, quotes) gives for each row of quotes, with the doc_id after the quote_id."""
    importable(docs.sparkSession)
    asked = quote_rows(quotes)
    rows = asked.join(docs.select("doc_id", "text").filter("text <> ''"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quotes")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc_id, text, asked in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("quotes")):
                for q, *rest in find(text.as_py(), asked.as_py()):
                    yield q, doc_id, *rest

    return rows.mapInArrow(lambda batches: batched(found(batches), names, types), schema)


def chosen(places: DataFrame) -> DataFrame:
    """The place of each quote: of its places the first whose text before fits, else the first, and how many there are (the
    sum of ``n``, if there is one)."""
    one = F.struct("position", "end", "raw_start", "raw_end", "state", "errors")
    n = F.sum("n") if "n" in places.columns else F.count("*")
    best = places.groupBy("quote_id", "doc_id").agg(F.min_by(one, F.struct((~F.col("fits")).alias("a"), "position", "end")).alias("p"), n.alias("n_places"))
    return best.select("quote_id", "doc_id", "p.state", "p.errors", "p.position", "p.end", "p.raw_start", "p.raw_end", "n_places")


# pages


ON = "quote_id long, doc_id long, state string, errors int, raw_start long, raw_end long, first_page {page}, last_page {page}, named boolean"


def on_pages(pages: DataFrame, quotes: DataFrame, share: float = FUZZY) -> DataFrame:
    """Every place of each quote (quote_id, doc_id, quote, hint) in its document, the pages in a row with a line feed between
    two: state, errors, raw_start, raw_end, first_page, last_page, and named, whether the hint is the label of one of these
    pages. A document's pages come together once and meet its quotes there; a page of no text holds nothing."""
    importable(pages.sparkSession)
    p = pages.select("doc_id", F.struct("page", "label", F.coalesce("text", F.lit("")).alias("text")).alias("p"))
    docs = p.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))  # one document's pages
    rows = quote_rows(quotes).join(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "pages", "quotes")
    names, kinds = [c.split()[0] for c in ON.split(", ")], {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    known = [kinds.get(c.split()[1]) for c in ON.split(", ")]

    def placed(doc_id: int, pages: pa.StructArray, asked: list[dict]) -> Iterator[tuple]:
        numbers, labels, parts = (pages.field(c).to_pylist() for c in ("page", "label", "text"))
        starts = [0]
        for x in parts:
            starts.append(starts[-1] + len(x.encode()) + 1)
        starts.pop()
        text = "\n".join(parts)
        numbered = [{**q, "quote_id": k} for k, q in enumerate(asked)]
        for k, state, errors, _, _, start, end, _ in places_in(text, numbered, share, False) if text else ():
            # Those that begin before the end, from the last that begins at the start or before it.
            on = slice(bisect_right(starts, start) - 1, bisect_left(starts, end))
            hint = asked[k]["hint"]
            named = hint is not None and hint in labels[on]
            yield asked[k]["quote_id"], doc_id, state, errors, start, end, numbers[on][0], numbers[on][-1], named

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc_id, pages, asked in zip(b.column("doc_id").to_pylist(), b.column("pages"), b.column("quotes")):
                yield from placed(doc_id, pages.values, asked.as_py())

    kind = to_arrow_type(pages.schema["page"].dataType)
    return rows.mapInArrow(lambda batches: batched(found(batches), names, [t or kind for t in known]), ON.format(page=pages.schema["page"].dataType.simpleString()))
