"""The queue of items that somebody has to look at: one open item per dedupe key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def open_items(queue: DataFrame) -> DataFrame:
    return queue.filter("resolved_at is null")


def open_count(queue: DataFrame) -> DataFrame:
    return open_items(queue).agg(F.count("*").alias("n_open"))


def accepted(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Items to add: none whose key is open already, and of several with one key the first (by ``position``)."""
    fresh = items.join(open_items(queue).select("dedupe_key").distinct(), "dedupe_key", "left_anti")
    first = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("position"))
    return fresh.withColumn("_r", first).filter("_r = 1").drop("_r")


def enqueue(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with what is accepted."""
    return queue.unionByName(accepted(queue, items), allowMissingColumns=True)
