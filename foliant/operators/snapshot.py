"""Successive snapshots of a reference library: differences, upserts and the run log.

Tables are replaced as a whole by the next version, so every change is a join of the stored rows with the fetched
ones. Keys are (library, item key); a source that is no longer fetched is retired, never deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["library_id", "item_key"]


def classify(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Every key of either side with is_new, is_changed, is_reactivated, is_retired and is_seen.

    stored: library_id, item_key, data_hash, status. fetched: library_id, item_key, data_hash.
    """
    o, n = stored.alias("o"), fetched.alias("n")
    rows = o.join(n, KEY, "full_outer")
    old, new = F.col("o.data_hash").isNotNull(), F.col("n.data_hash").isNotNull()
    return rows.select(
        *KEY,
        (new & ~old).alias("is_new"),
        (new & old & (F.col("o.data_hash") != F.col("n.data_hash"))).alias("is_changed"),
        (new & old & (F.col("o.status") == "retired")).alias("is_reactivated"),
        (old & ~new & (F.col("o.status") != "retired")).alias("is_retired"),
        new.alias("is_seen"),
    )


def counters(classified: DataFrame) -> DataFrame:
    """One row for each library: how many rows are seen, new, changed, reactivated and retired."""
    count = lambda c: F.count_if(F.col(c)).alias(c.replace("is_", "n_"))
    return classified.groupBy("library_id").agg(*(count(c) for c in ("is_seen", "is_new", "is_changed", "is_reactivated", "is_retired")))


def next_sources(stored: DataFrame, fetched: DataFrame, now: Column, fields: list[str], libraries: DataFrame | None = None) -> DataFrame:
    """The next version of the sources: fetched values win, vanished rows are retired, new rows get the next ids.

    Ids follow the largest stored one in the order of library and the ordinal ``position`` of the fetch. libraries:
    library_id of those that were fetched, if not all; the others' sources stay as they are.
    """
    if libraries is not None:
        own = stored.join(libraries, "library_id", "left_semi")
        columns = [*KEY, "id", "data_hash", *fields, "status", "first_seen", "last_seen"]
        # Ids go on after the largest of all libraries.
        after = next_sources(own, fetched, now, fields)
        top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_all")).join(F.broadcast(own.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_own"))))
        moved = after.join(F.broadcast(top)).withColumn("id", F.when(F.col("id") > F.col("_own"), F.col("id") - F.col("_own") + F.col("_all")).otherwise(F.col("id")))
        return stored.join(libraries, "library_id", "left_anti").select(*columns).unionByName(moved.select(*columns))
    o, n = stored.alias("o"), fetched.alias("n")
    rows = o.join(n, KEY, "full_outer")
    seen = F.col("n.data_hash").isNotNull()
    values = [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("data_hash", *fields)]
    kept = rows.select(*KEY, F.col("o.id").alias("id"), *values, F.when(seen, "active").otherwise("retired").alias("status"), F.coalesce("o.first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("o.last_seen")).alias("last_seen"), F.col("n.position").alias("_position"))
    fresh = kept.filter("id is null")
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    numbered = numbered_by(fresh, "library_id", "_position", "item_key").join(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_number"))
    columns = [c for c in kept.columns if c != "_position"]
    return kept.filter("id is not null").select(*columns).union(numbered.select(*columns))


def changed_sources(stored: DataFrame, changed: DataFrame, now: Column, fields: list[str]) -> DataFrame:
    """The next version of the sources after some of them changed: changed values win, new rows get the next ids, all others
    stay as they are; nothing is retired, as what did not change is not fetched."""
    columns = [*KEY, "id", "data_hash", *fields, "status", "first_seen", "last_seen"]
    others = stored.join(changed.select(*KEY), KEY, "left_anti").select(*columns)
    mine = stored.join(changed.select(*KEY), KEY, "left_semi")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_all")).join(F.broadcast(mine.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_own"))))
    after = next_sources(mine, changed, now, fields).join(F.broadcast(top))
    moved = after.withColumn("id", F.when(F.col("id") > F.col("_own"), F.col("id") - F.col("_own") + F.col("_all")).otherwise(F.col("id")))
    return others.unionByName(moved.select(*columns))


#: Parts in which the rows of one group are numbered side by side.
RANGES = 256


def numbered_by(rows: DataFrame, group: str, position: str, tie: str) -> DataFrame:
    """Rows with ``_number``, from 1 in the order of group, position (a number) and tie.

    The rows of a group are cut into ranges of position of about equal size, so that no group is numbered in one task:
    rows are counted by range, ranges before are summed (a row each), and each range is numbered by itself. Only rows that
    share one position are never parted.
    """
    at = F.array(*(F.lit(k / RANGES) for k in range(1, RANGES)))
    bounds = rows.groupBy(F.col(group).alias("_g")).agg(F.array_distinct(F.percentile_approx(position, at, F.lit(10 * RANGES))).alias("_bounds"))
    dealt = rows.join(bounds, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_range", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(position))), F.lit(-1))).drop("_bounds", "_g")
    counts = dealt.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_k")).agg(F.count("*").alias("_n"))
    # A row a group, then a row a range.
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(inner), F.lit(0))).drop("_n").join(groups.select(F.col("_g").alias("_h"), "_before"), F.col("_g").eqNullSafe(F.col("_h")))
    order = F.row_number().over(Window.partitionBy(group, "_range").orderBy(position, tie))
    found = dealt.withColumn("_r", order).join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_k")))
    return found.withColumn("_number", F.col("_before") + F.col("_base") + F.col("_r")).drop("_range", "_r", "_g", "_h", "_k", "_base", "_before")


def upsert_libraries(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """(kind, number, name): a fetched name wins unless it is empty."""
    o, n = stored.alias("o"), fetched.alias("n")
    name = F.coalesce(F.nullif(F.col("n.name"), F.lit("")), F.col("o.name"), F.lit(""))
    return o.join(n, ["kind", "number"], "full_outer").select("kind", "number", name.alias("name"))


def next_libraries(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """(library_id, kind, number, name): names as in ``upsert_libraries``, and new libraries get the next ids in the order
    of kind and number."""
    names = upsert_libraries(stored, fetched).join(stored.select("library_id", "kind", "number"), ["kind", "number"], "left")
    last = stored.agg(F.coalesce(F.max("library_id"), F.lit(-1)).alias("_last"))
    fresh = numbered_by(names.filter("library_id is null"), "kind", "number", "name").join(F.broadcast(last)).withColumn("library_id", F.col("_last") + F.col("_number"))
    columns = ["library_id", "kind", "number", "name"]
    return names.filter("library_id is not null").select(*columns).unionByName(fresh.select(*columns))


def replace_collections(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """The fetched collections, each with its stored id if it had one; vanished ones are gone."""
    o, n = stored.alias("o"), fetched.alias("n")
    return n.join(o, ["library_id", "collection_key"], "left").select("library_id", "collection_key", F.col("o.id").alias("id"), F.col("n.name").alias("name"), F.col("n.parent_key").alias("parent_key"))


def memberships(fetched: DataFrame, collections: DataFrame) -> DataFrame:
    """(source_id, collection_id) of fetched sources; unknown collection keys are ignored."""
    keys = fetched.select("source_id", "library_id", F.explode("collections").alias("collection_key"))
    return keys.join(collections.select("library_id", "collection_key", F.col("id").alias("collection_id")), ["library_id", "collection_key"]).select("source_id", "collection_id").dropDuplicates()


def next_memberships(stored: DataFrame, fetched: DataFrame, old: DataFrame, new: DataFrame, libraries: DataFrame) -> DataFrame:
    """The next (source_id, collection_id): of fetched sources what is fetched; what is stored of sources that were not
    fetched stays, unless its collection vanished from a fetched library."""
    gone = old.join(libraries, "library_id", "left_semi").join(new.select("id"), "id", "left_anti").select(F.col("id").alias("collection_id"))
    kept = stored.join(fetched.select("source_id").distinct(), "source_id", "left_anti").join(gone, "collection_id", "left_anti")
    return kept.select("source_id", "collection_id").unionByName(memberships(fetched, new))


def replace_tags(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """(source_id, tag): the tags of fetched sources are replaced, those of others stay."""
    untouched = stored.join(fetched.select("source_id").distinct(), "source_id", "left_anti")
    return untouched.select("source_id", "tag").union(fetched.select("source_id", F.explode("tags").alias("tag")).dropDuplicates())


def next_attachments(stored: DataFrame, fetched: DataFrame, sources: DataFrame) -> DataFrame:
    """Fetched attachments active, others retired; checksum and pages stay only with an unchanged path (null-safe)."""
    parents = sources.select("library_id", F.col("item_key").alias("parent_key"), F.col("id").alias("source_id"))
    n = fetched.join(parents, ["library_id", "parent_key"], "left").alias("n")
    o = stored.alias("o")
    seen, same = F.col("n.seen").isNotNull(), F.col("o.path").eqNullSafe(F.col("n.path"))
    pick = lambda c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.when(~seen | same, F.col(f"o.{c}")).alias(c)
    rows = o.join(n.withColumn("seen", F.lit(True)).alias("n"), KEY, "full_outer")
    return rows.select(*KEY, pick("source_id"), pick("path"), keep("checksum"), keep("page_count"), F.when(seen, "active").otherwise("retired").alias("status"))


def last_ok_age(runs: DataFrame, now: Column) -> DataFrame:
    """Seconds since the last run that ended well; null if there is none."""
    return runs.filter("status = 'ok'").agg((F.unix_timestamp(now) - F.unix_timestamp(F.max("finished_at"))).alias("age"))


def begin_runs(runs: DataFrame, libraries: DataFrame, now: Column) -> DataFrame:
    """The run log with a running row for each library_id, numbered after the last in the order of library."""
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    number = F.row_number().over(Window.orderBy("library_id"))  # one row a library
    rows = libraries.select("library_id").withColumn("_r", number).join(F.broadcast(last)).select((F.col("_last") + F.col("_r")).alias("id"), "library_id", F.lit("running").alias("status"), now.alias("started_at"))
    return runs.unionByName(rows, allowMissingColumns=True)


def finish_run(runs: DataFrame, run_id: int, status: str, error: str | None, now: Column) -> DataFrame:
    """The run log with one run brought to its end."""
    own = F.col("id") == run_id
    return runs.withColumn("status", F.when(own, status).otherwise(F.col("status"))).withColumn("error", F.when(own, F.lit(error)).otherwise(F.col("error"))).withColumn("finished_at", F.when(own, now).otherwise(F.col("finished_at")))


def stale_runs(runs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Runs that began long ago and never ended."""
    return runs.filter((F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("started_at") > seconds))
