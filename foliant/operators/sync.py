"""A sync of several libraries as one operation: one pass over all that was fetched, and a log of every attempt.

Libraries are fetched one by one, as each may fail by itself; what arrived is applied to the stored tables together.
Tables are DataFrames by name, before and after, so the same code serves the store, queries and tests:

    source            library_id, item_key, id, data_hash, fields..., status, first_seen, last_seen
    collection        library_id, collection_key, id, name, parent_key
    source_collection source_id, collection_id
    source_tag        source_id, tag
    attachment        library_id, item_key, source_id, path, checksum, page_count, status
    sync_run          id, library_id, status, error, started_at, finished_at, counters
    review            kind, dedupe_key, message, details, position, created_at, resolved_at
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.records import is_source
from foliant.operators import review, snapshot
from foliant.store import Snapshot, Store

COUNTERS = ("n_new", "n_changed", "n_retired", "n_reactivated", "n_attachments", "n_skipped")
RUN = "id long, library_id long, status string, error string, started_at string, finished_at string, " + ", ".join(f"{c} long" for c in COUNTERS)
REVIEW = "kind string, dedupe_key string, message string, details string, position long, created_at string, resolved_at string"
TABLES = {
    "collection": "library_id long, collection_key string, id long, name string, parent_key string",
    "source_collection": "source_id long, collection_id long",
    "source_tag": "source_id long, tag string",
    "attachment": "library_id long, item_key string, source_id long, path string, checksum string, page_count int, status string",
    "sync_run": RUN,
    "review": REVIEW,
}
SOURCE = "library_id long, item_key string, id long, data_hash string, {fields}, status string, first_seen string, last_seen string"


@dataclass
class Fetched:
    """What arrived of some libraries: items (library_id, item_key, item_type, position, data_hash, fields, tags,
    collections), collections (library_id, collection_key, name, parent_key), attachments (library_id, item_key,
    parent_key, path)."""

    items: DataFrame
    collections: DataFrame
    attachments: DataFrame

    def union(self, other: Fetched) -> Fetched:
        return Fetched(*(a.unionByName(b) for a, b in zip(vars(self).values(), vars(other).values())))


def number_collections(stored: DataFrame, fetched: DataFrame, libraries: DataFrame) -> DataFrame:
    """The next collections: those of other libraries, and the fetched ones, new ones with the next ids."""
    kept = stored.join(libraries, "library_id", "left_anti")
    rows = snapshot.replace_collections(stored, fetched)
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    fresh = rows.filter("id is null")
    sizes = fresh.groupBy("library_id").agg(F.count("*").alias("_n"))  # a row a library
    before = sizes.select(F.col("library_id").alias("_l"), F.coalesce(F.sum("_n").over(snapshot.Window.orderBy("library_id").rowsBetween(snapshot.Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = F.row_number().over(snapshot.Window.partitionBy("library_id").orderBy("collection_key"))
    fresh = fresh.withColumn("_r", order).join(before, F.col("library_id") == F.col("_l")).join(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_before") + F.col("_r"))
    columns = ["library_id", "collection_key", "id", "name", "parent_key"]
    return kept.select(*columns).unionByName(rows.filter("id is not null").select(*columns)).unionByName(fresh.select(*columns))


def retired_items(before: DataFrame, after: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """A review item for each source that this sync retired. names: library_id, name."""
    gone = after.filter("status = 'retired'").join(before.filter("status <> 'retired'").select("id"), "id", "left_semi").join(names, "library_id")
    ref = F.concat("name", F.lit(":"), "item_key")
    return gone.select(F.lit("source_retired").alias("kind"), F.concat(F.lit("source_retired:"), ref).alias("dedupe_key"), F.concat(ref, F.lit(" vanished from its library; look at what builds on it")).alias("message"), F.to_json(F.struct(F.col("name").alias("library"), "item_key")).alias("details"), F.col("id").alias("position"), now.alias("created_at"), F.lit(None).cast("string").alias("resolved_at"))


def counted(before: DataFrame, fetched: Fetched, sources: DataFrame, libraries: DataFrame) -> DataFrame:
    """The six counters of each fetched library: (library_id, COUNTERS)."""
    own = before.join(libraries, "library_id", "left_semi")
    changes = snapshot.counters(snapshot.classify(own, sources)).select("library_id", *COUNTERS[:4])
    files = fetched.attachments.groupBy("library_id").agg(F.count("*").alias("n_attachments"))
    skipped = fetched.items.filter(~is_source(F.col("item_type"))).groupBy("library_id").agg(F.count("*").alias("n_skipped"))
    rows = libraries
    for part in (changes, files, skipped):
        rows = rows.join(part, "library_id", "left")
    return rows.select("library_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS))


def synced(tables: dict[str, DataFrame], fetched: Fetched, names: DataFrame, failures: DataFrame, now: Column, fields: list[str], own_runs: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """The tables after a sync. names: library_id and name of the libraries that were attempted; failures: library_id and
    error of those that failed, whose rows stay as they are. Runs that are running are finished; own_runs: the first and
    last id of this sync's, if others may be running."""
    libraries = names.select("library_id").join(failures, "library_id", "left_anti")
    sources = fetched.items.filter(is_source(F.col("item_type")))
    after = snapshot.next_sources(tables["source"], sources, now, fields, libraries)
    ids = after.select("library_id", "item_key", F.col("id").alias("source_id"))
    named = sources.select("library_id", "item_key", "tags", "collections").join(ids, ["library_id", "item_key"])
    collections = number_collections(tables["collection"], fetched.collections, libraries)
    files = tables["attachment"]
    own = snapshot.next_attachments(files.join(libraries, "library_id", "left_semi"), fetched.attachments, after)
    counts = counted(tables["source"], fetched, sources, libraries)
    runs = tables["sync_run"].drop(*COUNTERS).join(failures.withColumnRenamed("error", "_error"), "library_id", "left").join(counts, "library_id", "left")
    mine = (F.col("status") == "running") & F.col("library_id").isin([r[0] for r in names.select("library_id").collect()])
    if own_runs is not None:
        mine = mine & F.col("id").between(*own_runs)
    old = tables["sync_run"].select("id", *(F.col(c).alias(f"_{c}") for c in COUNTERS))
    runs = runs.join(old, "id")
    failed = F.col("_error").isNotNull()
    log = runs.select("id", "library_id", F.when(mine, F.when(failed, "failed").otherwise("ok")).otherwise(F.col("status")).alias("status"), F.when(mine, F.col("_error")).otherwise(F.col("error")).alias("error"), "started_at", F.when(mine, now).otherwise(F.col("finished_at")).alias("finished_at"), *(F.when(mine, F.coalesce(c, F.lit(0))).otherwise(F.col(f"_{c}")).cast("long").alias(c) for c in COUNTERS))
    return {
        "source": after,
        "collection": collections,
        "source_collection": snapshot.next_memberships(tables["source_collection"], named, tables["collection"], collections, libraries),
        "source_tag": snapshot.replace_tags(tables["source_tag"], named),
        "attachment": files.join(libraries, "library_id", "left_anti").select(*own.columns).unionByName(own),
        "sync_run": log,
        "review": review.enqueue(tables["review"], retired_items(tables["source"], after, names, now)),
    }


def sync_all(store: Store, libraries: list[tuple[int, str]], fetch: Callable[[int], Fetched], now: str, fields: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Fetch every (library_id, name), apply what arrived, and return the runs of this sync; every library is attempted.
    Another sync may commit meanwhile: what was fetched is then applied to the tables that it left.

    fetch: raises what it will for a library that does not answer. fields: what sources keep of items; kinds: their types.
    """
    spark = store.spark
    schemas = TABLES | {"source": SOURCE.format(fields=", ".join(f"{f} {(kinds or {}).get(f, 'string')}" for f in fields))}
    def read(at: Snapshot, t: str) -> DataFrame:
        stored = at.read(t)
        return spark.createDataFrame([], schemas[t]) if stored is None else stored

    names = spark.createDataFrame(libraries, "library_id long, name string")
    own = (1, 0)

    def begin(at: Snapshot) -> dict[str, DataFrame]:
        nonlocal own
        runs = read(at, "sync_run")
        last = runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        own = last + 1, last + len({x for x, _ in libraries})
        return {"sync_run": snapshot.begin_runs(runs, names.dropDuplicates(["library_id"]), F.lit(now))}

    store.transact(begin)
    arrived, failures = None, []
    for library, _ in libraries:
        try:
            one = fetch(library)
            arrived = one if arrived is None else arrived.union(one)
        except Exception as e:  # noqa: BLE001  whatever failed belongs to the run of its library
            failures.append((library, f"{type(e).__name__}: {e}"))
    if arrived is None:
        empty = lambda schema: spark.createDataFrame([], schema)
        items = ", ".join(["library_id long, item_key string, item_type string, position long, data_hash string", *(f"{f} {(kinds or {}).get(f, 'string')}" for f in fields), "tags array<string>, collections array<string>"])
        arrived = Fetched(empty(items), empty("library_id long, collection_key string, name string, parent_key string"), empty("library_id long, item_key string, parent_key string, path string"))
    failed = spark.createDataFrame(failures, "library_id long, error string")
    store.transact(lambda at: synced({t: read(at, t) for t in schemas}, arrived, names, failed, F.lit(now), fields, own))
    return store.read("sync_run").filter(F.col("id").between(*own))


def upsert_libraries(store: Store, fetched: DataFrame) -> list[tuple[int, str]]:
    """Bring the stored libraries up to date with fetched ones (kind, number, name), and return library_id and name of
    these, as ``sync_all`` takes them."""
    empty = "library_id long, kind string, number long, name string"

    def work(at: Snapshot) -> dict[str, DataFrame]:
        stored = at.read("library")
        return {"library": snapshot.next_libraries(store.spark.createDataFrame([], empty) if stored is None else stored, fetched)}

    store.transact(work)
    rows = store.read("library").join(fetched.select("kind", "number").distinct(), ["kind", "number"], "left_semi")
    return [(r["library_id"], r["name"]) for r in rows.orderBy("library_id").collect()]  # a row a library
