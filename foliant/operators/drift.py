"""Entries of an exported citation file against the library's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ascii_lower, compared


def last_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key, the last."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("_r = 1").drop("_r")


def compare(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings (key, kind, field, entry_value, source_value): only_in_file, or a field that differs.

    entries: key, title, year, doi, position (the last of a key counts). sources: citation_key, title, year, doi (one a
    key). Years and DOIs differ only where both sides have one; a title counts whenever the entry has one.
    """
    e = last_of_key(entries, "key", "position").alias("e")
    rows = e.join(sources.alias("s"), F.col("e.key") == F.col("s.citation_key"), "left")
    missing = F.col("s.citation_key").isNull()
    text = lambda kind, field, differs, c: F.when(differs, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.col(f"e.{c}").cast("string").alias("entry_value"), F.col(f"s.{c}").cast("string").alias("source_value")))
    title = ~missing & F.col("e.title").isNotNull() & (compared(F.col("e.title")) != compared(F.col("s.title")))
    year = F.coalesce(F.col("e.year") != F.col("s.year"), F.lit(False))
    doi = F.coalesce(ascii_lower(F.col("e.doi")) != ascii_lower(F.col("s.doi")), F.lit(False))
    only = F.when(missing, F.struct(F.lit("only_in_file").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("entry_value"), F.lit(None).cast("string").alias("source_value")))
    found = F.filter(F.array(only, text("differs", "title", title, "title"), text("differs", "year", year, "year"), text("differs", "doi", doi, "doi")), lambda x: x.isNotNull())
    return rows.select(F.col("e.key").alias("key"), F.explode(found).alias("f")).select("key", "f.kind", "f.field", "f.entry_value", "f.source_value")


def in_order(findings: DataFrame) -> DataFrame:
    """Findings by key, missing ones first, then by field."""
    return findings.orderBy("key", F.col("kind") != "only_in_file", "field", "entry_value")


def without(rows: DataFrame, key: str, conflicted: DataFrame) -> DataFrame:
    """Rows whose key is in no conflict."""
    return rows.join(conflicted.select(F.col("citation_key").alias(key)), key, "left_anti")
