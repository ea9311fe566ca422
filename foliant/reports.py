"""Findings, runs and scores as text, JSON and Markdown. Lines are rows, so a report of any length is written by tasks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ANSI colours of severities.
COLOURS = {"info": 36, "warning": 33, "error": 31}


def label(severity: Column, colour: bool = False) -> Column:
    """The severity in a column of its own, coloured for a terminal."""
    text = F.rpad(severity, 8, " ")
    if not colour:
        return text
    code = F.create_map(*(x for k, v in COLOURS.items() for x in (F.lit(k), F.lit(str(v)))))
    return F.concat(F.lit("\x1b["), F.coalesce(F.try_element_at(code, severity), F.lit("0")), F.lit("m"), text, F.lit("\x1b[0m"))


def text_lines(findings: DataFrame, colour: bool = False) -> DataFrame:
    """(ord, line), a line for each finding."""
    return findings.select("ord", F.concat(label(F.col("severity"), colour), "message").alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(line), a JSON object for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def json_document(rows: DataFrame) -> Iterator[str]:
    """One JSON array, piece by piece: the driver holds a partition at a time."""
    yield "["
    for n, r in enumerate(json_lines(rows).toLocalIterator()):
        yield ("," if n else "") + r["line"]
    yield "]"


def markdown_row(cells: list[Column]) -> Column:
    plain = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |"))


def markdown_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """(position, line) of a table; its head has positions -2 and -1."""
    head = rows.sparkSession.createDataFrame([(-2, "| " + " | ".join(rows.columns) + " |"), (-1, "|" + " - |" * len(rows.columns))], "position long, line string")
    body = rows.orderBy(*order).select(F.monotonically_increasing_id().alias("position"), markdown_row([F.col(f"`{c}`") for c in rows.columns]).alias("line"))
    return head.union(body)


def markdown(details: DataFrame, totals: DataFrame, order: list[str]) -> Iterator[str]:
    """A report of an extraction benchmark: what each document got, then the totals."""
    for part in (details, totals):
        for r in markdown_lines(part, [c for c in order if c in part.columns]).orderBy("position").toLocalIterator():
            yield r["line"]
        yield ""
