"""Text in its comparison form, citation markers, and small string functions.

``normalize`` is the full rule set in Python, with the raw byte range of every output byte; ``form_of`` gives the form alone,
by whole-string steps for text that NFKC leaves alone and that has no capital sigma. ``compared`` is what operators use: it
takes Arrow batches of texts. ``comparison_form`` is the same rules as JVM expressions, for the short texts of arrays.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.workers import importable

RULES_VERSION = 1
#: What stands for another character in the comparison form.
DASHES = "\u2010\u2011\u2012\u2013\u2014"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"
SOFT_HYPHEN = "\xad"
REPLACEMENT = "\ufffd"
#: Characters with the Unicode property White_Space.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_STAND_IN = {**dict.fromkeys(DASHES, DASHES[0]), **dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"'), SOFT_HYPHEN: ""}
SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in SPACES) + "]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Normalized:
    text: str
    starts: list[int]  # raw byte range of each output byte
    ends: list[int]

    def source_range(self, start: int, end: int) -> tuple[int, int] | None:
        """Raw bytes behind output bytes start to end; None if that is empty or out of bounds."""
        return (self.starts[start], self.ends[end - 1]) if 0 <= start < end <= len(self.starts) else None


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """A character with the marks after it; and what is left out (a hyphen at a line's end) or becomes one space."""
    marks = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M")
    spaces = re.escape(SPACES)
    return re.compile(f".[{re.escape(marks)}]*", re.DOTALL), re.compile(f"(-(?=[{spaces}]*\n)[{spaces}]+)|[{spaces}]+")


@lru_cache(1 << 16)
def _mapped(piece: str) -> str:
    """A character with its marks, compatibility-composed and lower-cased. Two are left for later: dashes become U+2010,
    as only real hyphens join lines, and capital sigma stays, as its form depends on its neighbours."""
    form = unicodedata.normalize("NFKC", piece)
    return "".join(c if c == "\u03a3" else _STAND_IN.get(c, c.lower()) for c in form)


def _final_sigmas(text: list[str], owner: np.ndarray, after: list[str]) -> None:
    """Small sigmas for capital ones: the final form after a letter unless the raw text goes on with one."""
    for i in [i for i, c in enumerate(text) if c == "\u03a3"]:
        ends = i > 0 and text[i - 1].isalpha() and not after[owner[i]].isalpha()
        text[i] = "\u03c2" if ends else "\u03c3"


def normalize(raw: str) -> Normalized:
    """The comparison form by steps over the whole string, each of which says which characters stay."""
    piece, gap = _patterns()
    pieces = piece.findall(raw)
    mapped = [_mapped(x) for x in pieces]
    owner = np.repeat(np.arange(len(pieces)), [len(x) for x in mapped])
    joined = "".join(mapped)
    if "\u03a3" in joined:
        letters = list(joined)
        _final_sigmas(letters, owner, [x[0] for x in pieces[1:]] + [""])
        joined = "".join(letters)
    stays = np.ones(len(joined), bool)
    blank = np.zeros(len(joined), bool)
    for m in gap.finditer(joined):
        first = m.start() + (m.lastindex is None)  # a gap keeps its first character, which becomes the space
        stays[first : m.end()] = False
        blank[m.start()] = m.lastindex is None
    solid = np.flatnonzero(stays & ~blank)
    stays[: solid[0] if len(solid) else len(stays)] = False
    stays[solid[-1] + 1 if len(solid) else 0 :] = False
    at = np.flatnonzero(stays)
    text = "".join(" " if blank[i] else joined[i] for i in at.tolist()).replace(DASHES[0], "-")
    bounds = np.concatenate([[0], np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in pieces], dtype=np.int64)])
    widths = [len(c.encode("utf-8", "surrogatepass")) for c in text]
    behind = np.repeat(owner[at], widths) if len(at) else np.zeros(0, np.int64)
    return Normalized(text, bounds[behind].tolist(), bounds[behind + 1].tolist())


#: Characters beyond these are left to ``normalize``, as in the JVM's test.
SIMPLE = re.compile("[\x00-\x7f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff" + DASHES.replace("\u2011", "") + SINGLE_QUOTES + DOUBLE_QUOTES + "]*")
#: What Python takes for white space and Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_HYPHENATED = re.compile(f"-(?=[{re.escape(SPACES)}]*\n)[{re.escape(SPACES)}]+")
_MARKS = [(c, "-") for c in DASHES] + [(c, "'") for c in SINGLE_QUOTES] + [(c, '"') for c in DOUBLE_QUOTES]


def form_of(raw: str) -> str:
    """The text that ``normalize`` gives."""
    if _SEPARATORS.search(raw) or not raw.isascii() and not SIMPLE.fullmatch(raw):
        return normalize(raw).text
    text = raw.replace(SOFT_HYPHEN, "")
    if "-" in text and "\n" in text:
        text = _HYPHENATED.sub("", text)
    if not text.isascii():
        for mark, stand_in in _MARKS:
            text = text.replace(mark, stand_in)
    return " ".join(text.lower().split())


NORMALIZED = T.StructType([T.StructField("text", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(NORMALIZED)
def normalize_with_offsets(raw: pd.Series) -> pd.DataFrame:
    """Struct of the comparison form and the raw byte range of each of its bytes."""
    out = [normalize(x) if x is not None else None for x in raw]
    return pd.DataFrame({"text": [x and x.text for x in out], "starts": [x and x.starts for x in out], "ends": [x and x.ends for x in out]})


@F.pandas_udf(T.StringType())
def normalize_text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else normalize(x).text)


@F.arrow_udf(T.StringType())
def _forms_of(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else form_of(x) for x in raw.to_pylist()], pa.string())


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_texts(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else [None if t is None else normalize(t).text for t in x])


def comparison_form(raw: Column) -> Column:
    """The comparison form as JVM expressions, for text that NFKC leaves alone."""
    joined = F.regexp_replace(raw, f"-(?={SPACE_CLASS}*\\n){SPACE_CLASS}+", "")
    plain = F.translate(joined, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + SOFT_HYPHEN, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return F.trim(F.regexp_replace(F.lower(plain), f"{SPACE_CLASS}+", " "))


#: What only ``normalize`` treats exactly: beyond ASCII, Latin-1 letters and signs that stay, and the stand-ins. ASCII is
#: ruled out first, as it is most of a text.
SPECIAL = r"[[^\x00-\x7F]&&[^\xA1-\xA7\xA9\xAB\xAC\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\xFF\x{2010}\x{2012}-\x{2014}\x{2018}-\x{201F}]]"


def needs_full_rules(raw: Column) -> Column:
    """Whether a text may hold anything that only ``normalize`` treats exactly; a text of single bytes holds nothing."""
    return (F.octet_length(raw) != F.length(raw)) & raw.rlike(SPECIAL)


def compared(raw: Column) -> Column:
    """The comparison form of any text."""
    _workers_know()
    return _forms_of(raw)


def compared_each(raw: Column) -> Column:
    """The comparison forms of an array of texts."""
    _workers_know()
    full = F.exists(raw, lambda x: F.coalesce(needs_full_rules(x), F.lit(False)))
    return F.coalesce(normalize_texts(F.when(full, raw)), F.transform(raw, comparison_form))


def _workers_know() -> None:
    if (spark := SparkSession.getActiveSession()) is not None:
        importable(spark)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def trimmed(x: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(x, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""), F.lit(""))


def occurrences(x: Column, piece: str) -> Column:
    """How often piece stands in x without overlap."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def control_characters(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[\p{Cc}&&[^\n\r\t\f]]")).cast("long")


def year_from_date(x: Column) -> Column:
    """The first run of exactly four digits."""
    return F.nullif(F.regexp_extract(x, r"(?<![0-9])[0-9]{4}(?![0-9])", 0), F.lit("")).try_cast("int")


def path_of_file_url(x: Column) -> Column:
    """The decoded absolute path of a ``file://`` URL; null for anything else, and for what is not UTF-8."""
    decoded = F.try_url_decode(F.replace(F.substring(x, 8, 1 << 30), F.lit("+"), F.lit("%2B")))
    return F.when(F.startswith(x, F.lit("file://")) & F.startswith(decoded, F.lit("/")) & ~F.contains(decoded, F.lit(REPLACEMENT)), decoded)


def library_kind(x: Column) -> Column:
    return F.when(x == "user", "user").when(x.rlike(r"^group:\+?[0-9]+$") & (F.substring(x, 7, 30).try_cast("bigint") > 0), "group")


def library_number(x: Column) -> Column:
    return F.when(library_kind(x) == "user", F.lit(0).cast("long")).when(library_kind(x) == "group", F.substring(x, 7, 30).try_cast("bigint"))


def library_name(kind: Column, number: Column) -> Column:
    return F.when(kind == "user", "user").otherwise(F.concat(F.lit("group:"), number.cast("string")))


def library_path(kind: Column, number: Column) -> Column:
    return F.when(kind == "user", "/users/0").otherwise(F.concat(F.lit("/groups/"), number.cast("string")))


def age_text(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f" {unit}"))
    return F.when(s < 60, part(1, "s")).when(s < 3600, part(60, "min")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def capped_list(first: Column, n: Column, most: int = 10) -> Column:
    """The first items (at most ``most`` of the n there are) as a text, and how many others there are."""
    return F.concat(F.array_join(first, ", "), F.when(n > most, F.concat(F.lit(", +"), (n - most).cast("string"), F.lit(" others"))).otherwise(F.lit("")))


def without_braces(x: Column) -> Column:
    return F.translate(x, "{}", "")


def described(library: Column, key: Column, title: Column, year: Column) -> Column:
    return F.concat(library, F.lit(":"), key, F.lit(' "'), title, F.lit('"'), F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")))


#: A marker's key after the sign: a letter, then letters, digits and ``_-:.``, but no point, colon or hyphen at the end. A
#: letter, digit or backslash before the sign makes it no marker.
KEY = r"^(\p{IsAlphabetic}(?:[\p{IsAlphabetic}\p{N}_\-:.]*[\p{IsAlphabetic}\p{N}_])?)"
JOINED = r"[\p{IsAlphabetic}\p{N}\\]"


def utf16_units(x: Column) -> Column:
    wide = F.regexp_count(x, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(x) + F.when(F.octet_length(x) == F.length(x), F.lit(0)).otherwise(wide)


def marker_hits(docs: DataFrame) -> DataFrame:
    """doc_id, key, line, start and end of every citation marker ``@key``; columns count UTF-16 units.

    A line is cut at its signs: a key stands at the start of a part, and the part before says by its last character whether
    it is one. So only what follows a sign is matched.
    """
    lines = docs.filter(F.contains("text", F.lit("@"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).filter(F.contains("s", F.lit("@")))
    cut = lines.select("doc_id", "line", F.explode(F.array(F.split("s", "@"))).alias("p"))

    def marker(k: Column) -> Column:
        before = F.get("p", k - 1)
        return F.struct(k.alias("k"), F.when(~F.rlike(F.right(before, F.lit(1)), F.lit(JOINED)), F.regexp_extract(F.get("p", k), KEY, 1)).alias("key"))

    # Where each part starts: after those before it and their signs.
    starts = F.aggregate("p", F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + utf16_units(x) + 1)))
    found = cut.select("doc_id", "line", "p", F.explode(F.array(F.filter(F.transform(F.sequence(F.lit(1), F.size("p") - 1), marker), lambda x: x["key"] != ""))).alias("m")).filter(F.size("m") > 0)
    placed = found.select("doc_id", F.col("line").cast("long").alias("line"), "m", F.explode(F.array(starts)).alias("starts")).select("doc_id", "line", "starts", F.explode("m").alias("m"))
    start = F.get("starts", F.col("m.k"))
    return placed.select("doc_id", F.col("m.key").alias("key"), "line", (start - 1).alias("start"), (start + utf16_units(F.col("m.key"))).alias("end"))


def marker_at(hits: DataFrame, line: int, column: int) -> DataFrame:
    """The markers at a place, both edges included."""
    return hits.filter((F.col("line") == line) & (F.col("start") <= column) & (F.col("end") >= column))


def references(hits: DataFrame) -> DataFrame:
    """All places of each key, in order of key, document, line and column; a row each, however many a key has."""
    return hits.select("key", "doc_id", "line", "start", "end").orderBy("key", "doc_id", "line", "start")
