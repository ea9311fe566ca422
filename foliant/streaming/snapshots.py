"""Landed snapshots and review items as streams; the batch operators do the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.snapshot import next_sources
from foliant.store import Snapshot, Store

LANDING = ["library_id", "landing"]


def whole_landings(rows: DataFrame) -> DataFrame:
    """(library_id, landing) of landings of which all rows are there, the newest of each library."""
    counts = rows.groupBy(*LANDING).agg(F.count("*").alias("n"), F.max("n_rows").alias("n_rows")).filter("n >= n_rows")
    return counts.groupBy("library_id").agg(F.max("landing").alias("landing"))


def last_of(rows: DataFrame) -> DataFrame:
    """Of each item of a library, the row with the last position."""
    last = F.row_number().over(Window.partitionBy("library_id", "item_key").orderBy(F.col("position").desc()))
    return rows.withColumn("_r", last).filter("_r = 1").drop("_r")


def sync_stream(landed: DataFrame, store: Store, checkpoint: str, fields: list[str]) -> StreamingQuery:
    """Bring the sources up to date with landed snapshots (library_id, landing, n_rows, item_key, position, data_hash,
    fields).

    A landing is a whole snapshot of a library, in n_rows rows (each at a position of its own) that may come in several
    batches. Rows wait in the store until their landing is whole; of several whole ones of a library the newest counts.
    The store remembers the last landing that was applied to each library, in the same commit as the sources: what is no
    newer is dropped, also when it comes late, so sources never go back. Of rows with one item key the last position
    counts. A batch that is repeated after a failure changes nothing more. Without a stored table all sources are new.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        empty = batch.sparkSession.createDataFrame
        types = dict(batch.dtypes)

        def work(at: Snapshot) -> dict[str, DataFrame]:
            waiting, applied, stored = (at.read(t) for t in ("landed", "applied", "source"))
            if applied is None:
                applied = empty([], "library_id long, landing long")
            rows = (batch if waiting is None else waiting.unionByName(batch)).dropDuplicates([*LANDING, "position"])
            last = applied.select("library_id", F.col("landing").alias("_last"))
            rows = rows.join(last, "library_id", "left").filter("_last is null or landing > _last").drop("_last")
            newest = whole_landings(rows)
            done = newest.withColumnRenamed("landing", "_done")
            tables = {"landed": rows.join(done, "library_id", "left").filter("_done is null or landing > _done").drop("_done")}
            if not newest.isEmpty():
                if stored is None:
                    schema = ", ".join(["library_id long, item_key string, id long, data_hash string", *(f"{f} {types[f]}" for f in fields), "status string, first_seen string, last_seen string"])
                    stored = empty([], schema)
                ready = last_of(rows.join(newest, LANDING, "left_semi").drop("landing", "n_rows"))
                tables["source"] = next_sources(stored, ready, F.lit(str(epoch)), fields, newest.select("library_id"))
                tables["applied"] = applied.join(newest, "library_id", "left_anti").unionByName(newest.select(F.col("library_id").cast("long").alias("library_id"), F.col("landing").cast("long").alias("landing")))
            return tables

        store.transact(work)

    return landed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_items(items: DataFrame, late: str = "1 day") -> DataFrame:
    """Review items with a dedupe key that has not come within the watermark (column created_at)."""
    return items.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["dedupe_key"])
