"""Data-quality findings with severities, each check a DataFrame (ord, severity, code, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import age_text, capped_list, described, library_name

#: From the least to the most severe.
SEVERITIES = ("info", "warning", "error")
#: Items of a list inside one message, and how many of them are gathered for it.
LISTED = 10


def finding(rows: DataFrame, order: int, severity: str | Column, code: str | Column, message: Column) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(F.lit(order).alias("ord"), col(severity).alias("severity"), col(code).alias("code"), message.alias("message"))


def library_status(libraries: DataFrame, sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """library_id, kind, number, name, active_sources, age and latest_error of each library.

    The latest error is that of the newest run, null if that run has none, whatever came before.
    """
    active = sources.filter("status = 'active'").groupBy("library_id").agg(F.count("*").alias("active_sources"))
    run = runs.groupBy("library_id").agg(F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("ok_at"), F.max_by("error", "id").alias("latest_error"))
    age = F.unix_timestamp(now) - F.unix_timestamp("ok_at")
    rows = libraries.join(active, "library_id", "left").join(run, "library_id", "left")
    return rows.select("library_id", "kind", "number", "name", F.coalesce("active_sources", F.lit(0)).alias("active_sources"), age.alias("age"), "latest_error")


def listed(rows: DataFrame, item: Column, order: list[Column]) -> DataFrame:
    """n, and the first items in order as a list with the number of others; no row if there is none.

    Only the first items are ever gathered: tasks hand on theirs, and the first of those stay.
    """
    first = rows.select(item.alias("item"), *(c.alias(f"o{k}") for k, c in enumerate(order))).orderBy(*(f"o{k}" for k in range(len(order))), "item").limit(LISTED)
    keys = [f"o{k}" for k in range(len(order))]
    items = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "item"))), lambda x: x["item"]).alias("items"))
    n = rows.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(items)).filter("n > 0").select("n", capped_list(F.col("items"), F.col("n"), LISTED).alias("items"))


def store_finding(spark, place: str, version: int, error: str | None) -> DataFrame:
    """The store and its version, and whether the remote library answers."""
    rows = [(0, "info", "store", f"{place} holds schema {version}")]
    rows.append((1, "info", "remote", "the remote library answers") if error is None else (1, "warning", "remote_unreachable", f"{error}: results are as of the latest sync"))
    return spark.createDataFrame(rows, "ord int, severity string, code string, message string")


def library_findings(status: DataFrame) -> DataFrame:
    name = library_name(F.col("kind"), F.col("number"))
    quoted = F.concat(name, F.lit(' "'), F.col("name"), F.lit('"'))
    ages = finding(status.filter("age is not null"), 3, "info", "library", F.concat(quoted, F.lit(" holds "), F.col("active_sources").cast("string"), F.lit(" active sources as of "), age_text(F.col("age")), F.lit(" before")))
    never = finding(status.filter("age is null"), 3, "warning", "never_synced", F.concat(name, F.lit(": no sync has ended well so far")))
    failed = finding(status.filter("latest_error is not null"), 3, "warning", "library", F.concat(quoted, F.lit(": newest sync broke off with "), F.col("latest_error")))
    none = finding(status.agg(F.count("*").alias("n")).filter("n = 0"), 2, "warning", "never_synced", F.lit("the store has no library"))
    return reduce(DataFrame.union, (none, ages, never, failed))


def source_findings(sources: DataFrame, libraries: DataFrame) -> DataFrame:
    """Sources that cannot be cited, and how many are retired."""
    s = sources.filter("status = 'active' and citation_key is null").join(libraries, "library_id")
    item = F.concat(library_name(F.col("kind"), F.col("number")), F.lit(":"), F.col("item_key"), F.lit(' "'), F.col("title"), F.lit('"'))
    keyless = listed(s, item, [F.col("library_id"), F.col("item_key")])
    missing = finding(keyless, 4, "warning", "missing_citation_key", F.concat(F.col("n").cast("string"), F.lit(" sources cannot be cited for lack of a key: "), F.col("items")))
    retired = sources.agg(F.count_if(F.col("status") == "retired").alias("n")).filter("n > 0")
    return missing.union(finding(retired, 7, "info", "retired_sources", F.concat(F.col("n").cast("string"), F.lit(" retired sources remain in the store"))))


def attachment_findings(attachments: DataFrame, sources: DataFrame, libraries: DataFrame, files: DataFrame) -> DataFrame:
    """Attachments whose file is missing (not among files, by path), and those without a path."""
    active = attachments.filter("status = 'active'")
    gone = listed(active.filter("path is not null").join(files.select("path").distinct(), "path", "left_anti"), F.col("path"), [F.col("path")])
    bare = without_file(active, sources, libraries)
    none = listed(bare, F.col("described"), [F.col("kind") == "group", F.col("number"), F.col("item_key")])
    a = finding(gone, 5, "warning", "missing_pdf_file", F.concat(F.col("n").cast("string"), F.lit(" attached files are not where their paths say: "), F.col("items")))
    return a.union(finding(none, 6, "info", "pdf_without_file", F.concat(F.col("n").cast("string"), F.lit(" attachments exist on the server alone: "), F.col("items"))))


def without_file(attachments: DataFrame, sources: DataFrame, libraries: DataFrame) -> DataFrame:
    """Active attachments without a path, described, with their library's kind and number."""
    s = sources.select(F.col("id").alias("source_id"), F.col("item_key").alias("source_key"), F.col("title").alias("source_title"))
    rows = attachments.filter("status = 'active' and path is null").join(libraries, "library_id").join(s, "source_id", "left")
    tail = F.coalesce(F.concat(F.lit(" of "), F.col("source_key"), F.lit(' "'), F.coalesce("source_title", F.lit("")), F.lit('"')), F.lit(""))
    text = F.concat(library_name(F.col("kind"), F.col("number")), F.lit(' "'), F.col("name"), F.lit('" / '), F.col("item_key"), tail)
    return rows.select("kind", "number", "item_key", text.alias("described"))


def project_findings(order: DataFrame, libraries: DataFrame, ranked: DataFrame, conflicts: DataFrame, drift: DataFrame) -> DataFrame:
    """Libraries a project lists in vain, keys that name different works, and what its citation file says otherwise."""
    unknown = finding(order.join(libraries, "library_id", "left_anti"), 9, "warning", "library_unknown", F.concat(F.lit("the project lists library "), F.col("library_id").cast("string"), F.lit(", which the store lacks")))
    text = described(library_name(F.col("kind"), F.col("number")), F.col("item_key"), F.col("title"), F.col("year"))
    members = ranked.join(conflicts, "citation_key").filter(F.col("rank") <= LISTED).join(libraries, "library_id").withColumn("_d", text)
    each = members.groupBy("citation_key").agg(F.max("members").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "_d"))), lambda x: x["_d"]).alias("d"))
    clash = finding(each, 10, "warning", "key_conflict", F.concat(F.lit("several works share "), F.col("citation_key"), F.lit(": "), capped_list(F.col("d"), F.col("n"), LISTED)))
    only = finding(drift.filter("kind = 'only_in_file'"), 12, "warning", "file_only", F.concat(F.lit("no source for entry "), F.col("key")))
    differs = finding(drift.filter("kind = 'differs'"), 13, "warning", "metadata_drift", F.concat(F.col("field"), F.lit(" of "), F.col("key"), F.lit(" is "), F.col("entry_value"), F.lit(" in the file and "), F.col("source_value"), F.lit(" in the store")))
    return reduce(DataFrame.union, (unknown, clash, only, differs))


def project_finding(spark, name: str, libraries: int) -> DataFrame:
    return spark.createDataFrame([(8, "info", "project", f"project {name} cites from {libraries} libraries")], "ord int, severity string, code string, message string")


def unreadable(entries: DataFrame) -> DataFrame:
    """Citation files that cannot be parsed, from the error rows among their entries."""
    return finding(entries.filter("error is not null"), 11, "error", "citation_file", F.concat(F.lit("no citations could be read: "), F.col("error")))


def conflict_items(conflicts: DataFrame, project: str, now: Column) -> DataFrame:
    """A review item for each key that names different works."""
    key = F.col("citation_key")
    return conflicts.select(F.lit("key_conflict").alias("kind"), F.concat(F.lit(f"key_conflict:{project}:"), key).alias("dedupe_key"), F.concat(key, F.lit(" stands for "), F.col("members").cast("string"), F.lit(" sources that are not one work")).alias("message"), F.to_json(F.struct(key.alias("key"), F.col("members").alias("sources"))).alias("details"), F.xxhash64(key).alias("position"), now.alias("created_at"))


def review_finding(open_count: DataFrame) -> DataFrame:
    return finding(open_count.filter("n_open > 0"), 14, "warning", "review_open", F.concat(F.col("n_open").cast("string"), F.lit(" items await review")))


def rank_of(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def exit_code(findings: DataFrame) -> DataFrame:
    """1 if any finding is a warning or worse, else 0."""
    return findings.agg(F.coalesce(F.max((rank_of(F.col("severity")) >= 1).cast("int")), F.lit(0)).alias("exit_code"))
