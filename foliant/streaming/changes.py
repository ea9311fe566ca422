"""A library followed by its changes: every batch fetches what is newer than the last one and brings the store up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.functions import records
from foliant.operators.snapshot import changed_sources
from foliant.operators.sync import SOURCE
from foliant.sources.library import checked
from foliant.sources.paged_json import PagedJson
from foliant.store import Snapshot, Store
from foliant.workers import importable

FIELDS = ["title", "citation_key", "doi"]


def changes(spark: SparkSession, url: str, limit: int = 100) -> DataFrame:
    """(position, item_type, value) of a library's records as they change."""
    importable(spark)
    spark.dataSource.register(PagedJson)
    return spark.readStream.format("paged_json").option("url", url).option("limit", limit).load()


def change_stream(changed: DataFrame, store: Store, library_id: int, checkpoint: str) -> StreamingQuery:
    """Apply changed records to the stored sources of a library.

    Changes say nothing of records that are gone; a sync of the whole library retires those. Records that are no sources are
    passed over. A batch that is repeated after a failure changes nothing more, as its records are the same or newer.
    """

    name = f"changed_{library_id}"

    def apply(batch: DataFrame, epoch: int) -> None:
        store.write(name, batch)  # asked for once; every later step reads the same answer
        raw = store.read(name)
        if raw.isEmpty():
            return
        items = checked(records.items(raw, keep=("position",)).withColumn("data_hash", records.record_hash("data")))
        items = items.filter(records.is_source(F.col("item_type"))).withColumn("_r", F.row_number().over(Window.partitionBy("item_key").orderBy(F.col("position").desc()))).filter("_r = 1")
        rows = items.select(F.lit(library_id).cast("long").alias("library_id"), "item_key", F.col("position").cast("long").alias("position"), "data_hash", *FIELDS)

        def work(at: Snapshot) -> dict[str, DataFrame]:
            stored = at.read("source")
            if stored is None:
                stored = batch.sparkSession.createDataFrame([], SOURCE.format(fields=", ".join(f"{f} string" for f in FIELDS)))
            return {"source": changed_sources(stored, rows, F.lit(str(epoch)), FIELDS)}

        store.transact(work)

    return changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
