"""Typed columns from JSON records of a reference library."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import path_of_file_url, trimmed, year_from_date

#: Item types that are no sources.
NOT_SOURCES = ("attachment", "note", "annotation")
#: A record, with its data as text, and the data of each kind of record.
RECORD = "struct<id:string,library:struct<name:string>,links:struct<enclosure:struct<href:string>>,data:string>"
ITEM = "key string, itemType string, title string, date string, DOI string, citationKey string, dateModified string, tags array<struct<tag:string>>, collections array<string>"
ATTACHMENT = "key string, parentItem string, contentType string, linkMode string"
COLLECTION = "key string, name string, parentCollection string"
GROUP = "id string, name string"


def parsed(raw: DataFrame, column: str, data: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records as ``r``, their data as ``d``: each text is parsed once, and its data once more; keep: other columns."""
    rows = raw.select(*keep, F.from_json(F.col(column), RECORD).alias("r"))
    return rows.select(*keep, "r", F.from_json(F.col("r.data"), data).alias("d"))


def text_at(name: str) -> Column:
    """A field as text; empty if it is missing or null."""
    return F.coalesce(F.col(name), F.lit(""))


def items(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sources of item records; a record without ``data`` or key is an error in the column ``error``."""
    tags = F.filter(F.transform("d.tags", lambda t: t["tag"]), lambda t: t.isNotNull())
    lists = F.filter("d.collections", lambda c: c.isNotNull())
    none = F.array().cast("array<string>")
    return parsed(raw, column, ITEM, keep).select(
        *keep,
        trimmed(F.col("d.key")).alias("item_key"),
        text_at("d.itemType").alias("item_type"),
        trimmed(F.col("d.citationKey")).alias("citation_key"),
        text_at("d.title").alias("title"),
        year_from_date(F.col("d.date")).alias("year"),
        trimmed(F.col("d.DOI")).alias("doi"),
        text_at("d.dateModified").alias("date_modified"),
        F.coalesce(tags, none).alias("tags"),
        F.coalesce(lists, none).alias("collections"),
        text_at("r.library.name").alias("library_name"),
        F.col("r.data").alias("data"),
        record_error("item").alias("error"),
    )


def record_error(what: str) -> Column:
    no_data = F.col("r.data").isNull() | ~F.startswith(F.ltrim("r.data"), F.lit("{"))
    return F.when(no_data, f"{what} without data").when(trimmed(F.col("d.key")).isNull(), f"{what} without key")


def known_kind(kind: Column) -> Column:
    """The kind of a stored library; any but the known ones is an error of the query."""
    return F.when(kind.isin("user", "group"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of library: "), F.coalesce(kind, F.lit("null")))).cast("string"))


def is_source(item_type: Column) -> Column:
    return ~F.coalesce(item_type, F.lit("")).isin(*NOT_SOURCES)


def is_pdf(content_type: Column) -> Column:
    return content_type == "application/pdf"


def attachments(raw: DataFrame, column: str = "value") -> DataFrame:
    return parsed(raw, column, ATTACHMENT).select(trimmed(F.col("d.key")).alias("item_key"), trimmed(F.col("d.parentItem")).alias("parent_key"), text_at("d.contentType").alias("content_type"), text_at("d.linkMode").alias("link_mode"), path_of_file_url(F.col("r.links.enclosure.href")).alias("path"), record_error("attachment").alias("error"))


def collections(raw: DataFrame, column: str = "value") -> DataFrame:
    """A top-level collection has ``false`` for its parent."""
    return parsed(raw, column, COLLECTION).select(trimmed(F.col("d.key")).alias("collection_key"), text_at("d.name").alias("name"), F.nullif(trimmed(F.col("d.parentCollection")), F.lit("false")).alias("parent_key"), record_error("collection").alias("error"))


def groups(raw: DataFrame, column: str = "value") -> DataFrame:
    number = F.coalesce(F.col("r.id").try_cast("bigint"), F.col("d.id").try_cast("bigint"))
    return parsed(raw, column, GROUP).select(number.alias("id"), text_at("d.name").alias("name"), F.when(number.isNull(), "group without id").alias("error"))


@F.pandas_udf(T.StringType())
def record_hash(data: pd.Series) -> pd.Series:
    """SHA-256 of the record without its version: keys sorted at every level, no white space."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        value = json.loads(x)
        if isinstance(value, dict):
            value.pop("version", None)
        return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return data.map(one)
