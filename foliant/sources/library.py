"""A reference library behind its paged HTTP API: its groups, and what a sync fetches of one library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import records
from foliant.operators.sync import Fetched
from foliant.sources.paged_json import PagedJson
from foliant.store import Store
from foliant.workers import importable


class BadRecord(ValueError):
    """A record without what it must have."""


def scan(spark: SparkSession, url: str, item_type: str | None = None) -> DataFrame:
    """(position, item_type, value) of all records; a type is left to the server."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters
    spark.dataSource.register(PagedJson)
    reader = spark.read.format("paged_json").option("url", url)
    return (reader.option("itemtype", item_type) if item_type else reader).load()


def path_of(kind: str, number: int) -> str:
    return "/users/0" if kind == "user" else f"/groups/{number}"


def checked(rows: DataFrame) -> DataFrame:
    """Rows without errors; the first error is raised."""
    bad = rows.filter("error is not null").select("error").first()
    if bad is not None:
        raise BadRecord(bad[0])
    return rows.drop("error")


def groups(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """Number and name of the groups the user is in, by number."""
    rows = checked(records.groups(scan(spark, f"{base}/users/0/groups")))
    return sorted((r["id"], r["name"]) for r in rows.collect())  # one row a group


def fetch(store: Store, base: str, library_id: int, kind: str, number: int) -> Fetched:
    """What a library holds now, landed in the store, so that every later step reads the same answer."""
    spark, root, own = store.spark, f"{base}{path_of(kind, number)}", F.lit(library_id).cast("long").alias("library_id")

    def landed(name: str, rows: DataFrame) -> DataFrame:
        store.write(f"landed_{name}_{library_id}", rows)
        return store.read(f"landed_{name}_{library_id}")

    raw = {name: landed(name, scan(spark, f"{root}/{path}", kind)) for name, path, kind in (("items", "items/top", None), ("collections", "collections", None), ("attachments", "items", "attachment"))}
    items = checked(records.items(raw["items"], keep=("position",)).withColumn("data_hash", records.record_hash("data")))
    items = items.withColumn("r", F.row_number().over(Window.partitionBy("item_key").orderBy("position"))).filter("r = 1")
    collections = checked(records.collections(raw["collections"]))
    files = checked(records.attachments(raw["attachments"])).filter(records.is_pdf(F.col("content_type")))
    return Fetched(
        items.select(own, "item_key", "item_type", F.col("position").cast("long").alias("position"), "data_hash", "title", "citation_key", "doi", "tags", "collections"),
        collections.select(own, "collection_key", "name", "parent_key"),
        files.select(own, "item_key", "parent_key", "path"),
    )
