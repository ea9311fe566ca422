"""Citation files, project and corpus descriptions, and page texts of external extractors."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import sqlite3
import subprocess
import tempfile
import tomllib
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.spans import not_blank
from foliant.workers import importable

ENTRIES = "key string, title string, year int, doi string, position int, error string"


class BadFile(ValueError):
    """A citation file that cannot be parsed."""


def _value(text: str, at: int) -> tuple[str, int]:
    """A field's value from ``{...}``, ``"..."`` or a bare word, and where it ends."""
    if text[at : at + 1] in ("{", '"'):
        close, depth, to = ("}" if text[at] == "{" else '"'), 0, at + 1
        while to < len(text) and not (text[to] == close and depth == 0):
            depth += (text[to] == "{") - (text[to] == "}")
            to += 2 if text[to] == "\\" else 1
        if to >= len(text):
            raise BadFile(f"no end of the value at {at}")
        return text[at + 1 : to], to + 1
    m = re.compile(r"[^\s,}#]+").match(text, at)
    if not m:
        raise BadFile(f"no value at {at}")
    return m[0], m.end()


def citation_entries(text: str) -> list[dict]:
    """key, title (without braces), year (of a typed date) and doi of each entry of a BibTeX file."""
    out, at = [], 0
    strings: dict[str, str] = {}
    while m := re.compile(r"@\s*([A-Za-z]+)\s*[{(]").search(text, at):
        kind, at = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            _, at = _value(text, m.end() - 1)
            continue
        key = ""
        if kind != "string":
            k = re.compile(r"\s*([^\s,{}()=\"#%]+)\s*(?=[,})])").match(text, at)
            if not k:
                raise BadFile(f"no key at {at}")
            key, at = k[1], k.end()
        fields: dict[str, str] = {}
        while True:
            gap = re.compile(r"[\s,]*").match(text, at)
            at = gap.end()
            if text[at : at + 1] in ("}", ")"):
                at += 1
                break
            f = re.compile(r"([A-Za-z][\w\-+:.]*)\s*=\s*").match(text, at)
            if not f:
                raise BadFile(f"no field at {at}")
            value, at = "", f.end()
            while True:
                bare = text[at : at + 1] not in ("{", '"')
                part, at = _value(text, at)
                value += strings.get(part.lower(), part) if bare else part
                plus = re.compile(r"\s*#\s*").match(text, at)
                if not plus:
                    break
                at = plus.end()
            fields[f[1].lower()] = value
        if kind == "string":
            strings |= {k: v for k, v in fields.items()}
            continue
        plain = lambda x: None if x is None else re.sub(r"\s+", " ", x.translate({123: None, 125: None})).strip()
        date = (plain(fields.get("date")) or plain(fields.get("year")) or "").lstrip("/").lstrip(".")
        y = re.match(r"(-?\d{4})(?:-\d\d(?:-\d\d)?)?[~?%]?(?:/.*)?$", date)
        doi = plain(fields.get("doi"))
        out.append({"key": key, "title": plain(fields.get("title")), "year": int(y[1]) if y else None, "doi": doi})
    return out


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """Entries of citation files; a file that cannot be parsed gives one row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["value"]:
                try:
                    rows += [{**e, "position": n, "error": None} for n, e in enumerate(citation_entries(text))]
                except BadFile as e:
                    rows.append({"key": None, "title": None, "year": None, "doi": None, "position": 0, "error": str(e)})
            frame = pd.DataFrame(rows, columns=["key", "title", "year", "doi", "position", "error"])
            yield frame.astype({"year": "Int32", "position": "int32"})

    importable(spark)
    return spark.read.text(path, wholetext=True).mapInPandas(parse, ENTRIES)


@dataclass
class Project:
    id: str
    name: str
    documents: list[str] = field(default_factory=list)
    libraries: list[str] = field(default_factory=lambda: ["user"])
    bibliography: dict | None = None
    ai: dict = field(default_factory=dict)

    def order(self, spark: SparkSession) -> DataFrame:
        """(position, kind, number) of the libraries, first first."""
        rows = [(n, "user" if x == "user" else "group", 0 if x == "user" else int(x[6:])) for n, x in enumerate(self.libraries)]
        return spark.createDataFrame(rows, "position int, kind string, number long")


def parse_project(text: str, section: str = "library") -> Project:
    """A project from TOML: id and name, its documents, the libraries of a section, its citation file and AI settings."""
    data = tomllib.loads(text)
    if not str(data.get("id", "")).strip():
        raise ValueError("a project needs an id")
    libraries = data.get(section, {}).get("libraries", ["user"])
    if not libraries or not all(re.fullmatch(r"user|group:0*[1-9][0-9]*", x) for x in libraries):
        raise ValueError("libraries are 'user' or 'group:<number>', at least one")
    book = data.get("bibliography")
    return Project(data["id"], data.get("name", ""), data.get("documents", []), libraries, book and {"managed_by": "library"} | book, {"cloud": False, "logging": "required"} | data.get("ai", {}))


def find_root(start: str, name: str = "project.toml") -> Path | None:
    """The nearest folder above that holds the project file."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / name).is_file()), None)


def toml_text(x: str) -> str:
    """A basic TOML string."""
    return '"' + "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c if c >= " " and c != "\x7f" else f"\\u{ord(c):04X}") for c in x) + '"'


def new_project(root: str, name: str, file: str = "project.toml") -> Path:
    """A project file with a fresh id; an existing one is never overwritten."""
    path = Path(root) / file
    with path.open("x") as f:
        f.write(f'id = "{uuid.uuid4()}"\nname = {toml_text(name)}\ndocuments = []\n\n[library]\nlibraries = ["user"]\n')
    return path


def data_dir(env: dict[str, str] | None = None, own: str = "FOLIANT_DATA_DIR", name: str = "foliant") -> Path:
    """Its own variable, else the XDG data folder, else the home folder; empty values do not count."""
    env = dict(os.environ) if env is None else env
    if env.get(own):
        return Path(env[own])
    if env.get("XDG_DATA_HOME"):
        return Path(env["XDG_DATA_HOME"]) / name
    if env.get("HOME"):
        return Path(env["HOME"]) / ".local/share" / name
    raise ValueError("no data folder: neither a home nor a data folder is set")


def download(wanted: DataFrame, seconds: int = 60) -> DataFrame:
    """id, content, hash (SHA-256) and error of files (id, url), fetched by the tasks; a failure is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, url in zip(batch["id"], batch["url"]):
                try:
                    with urllib.request.urlopen(url, timeout=seconds) as answer:
                        content = answer.read()
                    row = (name, content, hashlib.sha256(content).hexdigest(), None)
                except (OSError, ValueError) as e:
                    row = (name, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["id", "content", "hash", "error"])  # one file at a time in memory

    importable(wanted.sparkSession)
    return wanted.select("id", "url").mapInPandas(run, "id string, content binary, hash string, error string")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, batch: int = 10_000) -> DataFrame:
    """The rows of a query over SQLite files, each read as a copy in a task's memory: the fallback where a library's own
    program, which holds the file, does not answer. The file itself is never opened, let alone locked or changed."""
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                with contextlib.closing(sqlite3.connect(":memory:")) as copy:
                    copy.deserialize(bytes(content))
                    rows = copy.execute(query)
                    while some := rows.fetchmany(batch):
                        yield pd.DataFrame(some, columns=names, dtype=object)

    importable(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def corpus(spark: SparkSession, text: str) -> DataFrame:
    """Expectations (doc_id, sentences, before, chars) of a corpus description in TOML."""
    rows = []
    for d in tomllib.loads(text).get("document", []):
        e = d.get("expect", {})
        rows.append((d["id"], d.get("url"), d.get("category"), e.get("sentences", []), [tuple(p) for p in e.get("before", [])], e.get("chars", [])))
    return spark.createDataFrame(rows, "doc_id string, url string, category string, sentences array<string>, before array<struct<first:string,second:string>>, chars array<string>")


PAGE = "_width double, _height double, block array<struct<line:array<struct<font:array<struct<_name:string,_size:double,char:array<struct<_c:string,_quad:string>>>>>>>>"


def stext_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, index, size and spans of structured-text XML files; index is the page's place in its file."""
    return pages_of_stext(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml")))


def pages_of_stext(files: DataFrame) -> DataFrame:
    """The same of files (path, xml): a span for each font run, its box around its characters."""
    pages = files.select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<page\b[^>]*?(?:/>|>.*?</page>)"), F.lit(0))).alias("index", "x"))
    pages = pages.select("path", "index", F.from_xml("x", PAGE, {"rowTag": "page"}).alias("p"))
    runs = F.flatten(F.transform(F.flatten(F.transform("p.block", lambda b: b["line"])), lambda x: x["font"]))

    def span(run):
        q = F.flatten(F.transform(F.filter(run["char"], lambda c: c["_quad"].isNotNull()), lambda c: F.transform(F.split(c["_quad"], " +"), lambda v: v.cast("double"))))
        x, y = F.filter(q, lambda v, i: i % 2 == 0), F.filter(q, lambda v, i: i % 2 == 1)
        return F.struct(F.array_join(F.transform(run["char"], lambda c: c["_c"]), "").alias("text"), F.array_min(x).alias("left"), F.array_min(y).alias("top"), F.array_max(x).alias("right"), F.array_max(y).alias("bottom"), run["_name"].alias("font"))

    spans = F.filter(not_blank(F.transform(runs, span)), lambda s: s["left"].isNotNull())
    return pages.select("path", "index", F.col("p._width").alias("width"), F.col("p._height").alias("height"), F.coalesce(spans, F.array()).alias("spans"))


def version_of_keys(text: str) -> str:
    """A version from lines like ``MAJOR=1``: the numbers of MAJOR, MINOR, BUILD and PATCH that are there."""
    pairs = dict(line.split("=", 1) for line in text.split() if "=" in line)
    return ".".join(pairs[k] for k in ("MAJOR", "MINOR", "BUILD", "PATCH") if k in pairs)


class Backend(Protocol):
    """Extracts pages from the bytes of a file."""

    name: str

    def version(self) -> str: ...

    def extract(self, content: bytes) -> list[str]: ...


class ProcessBackend:
    """An external program that writes a file's text; pages end with a form feed."""

    def __init__(self, name: str, command: list[str], version_command: list[str] | None = None):
        self.name, self.command, self.version_command = name, command, version_command

    def available(self) -> bool:
        from shutil import which

        return which(self.command[0]) is not None

    def version(self) -> str:
        if not self.version_command:
            return ""
        done = subprocess.run(self.version_command, capture_output=True, text=True, check=False)
        m = re.search(r"version\s+(\S+)", done.stdout + done.stderr)
        return m[1] if m else ""

    def extract(self, content: bytes) -> list[str]:
        with tempfile.NamedTemporaryFile() as f:
            f.write(content)
            f.flush()
            done = subprocess.run([*self.command, f.name], capture_output=True, check=False)
        if done.returncode:
            raise OSError(done.stderr.decode(errors="replace")[:500])
        return done.stdout.decode(errors="replace").removesuffix("\f").split("\f")


class PlainText:
    """Text files, a page for each form feed."""

    name = "plain"

    def version(self) -> str:
        return "1"

    def extract(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


class StextProcess(ProcessBackend):
    """An external program that writes a file's structured text as one XML document, a page here."""

    def extract(self, content: bytes) -> list[str]:
        return ["\f".join(super().extract(content))]


BACKENDS: dict[str, Backend] = {"plain": PlainText(), "pdftotext": ProcessBackend("pdftotext", ["pdftotext", "-layout"], ["pdftotext", "-v"]), "mutool": StextProcess("mutool", ["mutool", "draw", "-q", "-F", "stext"], ["mutool", "-v"])}


def chosen_backends(names: list[str] | None = None) -> list[Backend]:
    """The named backends, or all whose program is there; an unknown name is an error."""
    if names is None:
        return [b for b in BACKENDS.values() if not isinstance(b, ProcessBackend) or b.available()]
    if unknown := [n for n in names if n not in BACKENDS]:
        raise ValueError(f"unknown backend {unknown[0]}; known: {', '.join(BACKENDS)}")
    return [BACKENDS[n] for n in names]


def extract(files: DataFrame, backends: list[Backend]) -> DataFrame:
    """path, backend, version, index, plain and error: files (path, content) through each backend; errors stay rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        versions = {b.name: b.version() for b in backends}
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                for b in backends:
                    try:
                        rows += [(path, b.name, versions[b.name], n, t, None) for n, t in enumerate(b.extract(bytes(content)))]
                    except Exception as e:  # noqa: BLE001  any failure of a backend belongs to its file
                        rows.append((path, b.name, versions[b.name], -1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "backend", "version", "index", "plain", "error"])

    importable(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, backend string, version string, index int, plain string, error string")


def extract_spans(files: DataFrame, backend: Backend) -> DataFrame:
    """path, index, size and spans of files (path, content) by a backend that writes structured text."""
    return pages_of_stext(extract(files, [backend]).filter("error is null").select("path", F.col("plain").alias("xml")))
