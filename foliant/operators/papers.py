"""Papers in files: their elements, chapters and citations, and the files that belong to a project.

A file's source is read by itself, in one row; what is said across files is joins. Edge cases: null sources have no elements;
paths that lead out of the project, or to files that are not there, are reported and not followed; cycles end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.markup import placed
from foliant.workers import importable, shared_folder

ELEMENT = "kind string, line long, col long, value string, level int, form string, text string, chapter long, parent long, first_line long, last_line long"


def elements(sources: DataFrame, id: str = "doc_id") -> DataFrame:
    """id and ELEMENT of every element of sources (id, text)."""
    importable(sources.sparkSession)
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in ELEMENT.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column("text")):
                if text.is_valid and (found := placed(text.as_py())):
                    own = pa.array([0] * len(found))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1).take(own), *(pa.array([e[n] for e in found], t) for n, t in fields)], [id, *(n for n, _ in fields)])

    return sources.select(id, "text").mapInArrow(read, f"`{id}` {sources.schema[id].dataType.simpleString()}, {ELEMENT}")


def chapters(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Headings with the line of their parent: id, line, level, title, parent."""
    return found.filter("kind = 'heading'").select(id, "line", "level", F.col("value").alias("title"), "parent")


def usage(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """key, id, chapter (null before the first heading) and n of citations, quotes' attributions among them."""
    return found.filter("kind in ('citation', 'quote') and value is not null").groupBy(F.col("value").alias("key"), id, "chapter").agg(F.count("*").alias("n"))


def resolved(path: Column, base: Column) -> Column:
    """A path as it is written in the file ``base``, from the project's root; null if it leads out of the project."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))).otherwise(F.concat(done, F.array(p))))
    return F.array_join(kept, "/")


def links(found: DataFrame) -> DataFrame:
    """path, line, kind and target of what files (path) include or import."""
    return found.filter("kind in ('include', 'import')").select("path", "line", "kind", resolved(F.col("value"), F.col("path")).alias("target"))


def project_files(found: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """entry, path and depth of all files (path) that the entries (entry: a path) lead to, each once, at its least depth.

    Every step joins the files that the last one found with the links, until one finds nothing new; so cycles end, and the
    steps are as many as inclusions are nested. Found files lie in the shared folder, a table a step.
    """
    spark = files.sparkSession
    root = shared_folder(spark, "project")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    # Files are numbered, so that steps shuffle numbers and not paths.
    there = kept(files.select("path").distinct().filter("path is not null").withColumn("n", F.monotonically_increasing_id()), "files")
    targets = links(found).select("path", F.col("target").alias("to")).filter("to is not null").distinct()
    edges = kept(targets.join(there.toDF("path", "a"), "path").join(there.toDF("to", "b"), "to").select("a", "b"), "links")
    last = kept(entries.select(F.col("entry").alias("path")).distinct().join(there, "path").select(F.col("n").alias("entry"), F.col("n").alias("a"), F.lit(0).alias("depth")), "0")
    paths, depth = [f"{root}/0"], 0
    while not last.isEmpty():
        depth += 1
        seen = spark.read.schema(last.schema).parquet(*paths)
        new = last.join(edges, "a").select("entry", F.col("b").alias("a"), F.lit(depth).alias("depth")).distinct()
        last = kept(new.join(seen.select("entry", "a"), ["entry", "a"], "left_anti"), str(depth))
        paths.append(f"{root}/{depth}")
    rows = spark.read.schema(last.schema).parquet(*paths).join(there.toDF("path", "a"), "a").select(F.col("entry").alias("n"), "path", "depth")
    return rows.join(there.toDF("entry", "n"), "n").select("entry", "path", "depth")


def broken_links(found: DataFrame, files: DataFrame) -> DataFrame:
    """path, line, kind and target of links to files that are not there; target is null where a path leads out."""
    there = files.select(F.col("path").alias("target")).distinct()
    return links(found).join(there, "target", "left_anti").select("path", "line", "kind", "target")


def project_usage(found: DataFrame, members: DataFrame) -> DataFrame:
    """key, entry, n and n_files: how often each project cites a key, over all its files. members: entry and path, each once.

    A file's keys are counted once, in a row, however many projects it belongs to; what is shuffled by project is a row for
    each member.
    """
    cited = found.filter("kind in ('citation', 'quote') and value is not null").groupBy("path", F.col("value").alias("key")).agg(F.count("*").alias("n"))
    files = cited.groupBy("path").agg(F.collect_list(F.struct("key", "n")).alias("cited"))  # one file's keys
    rows = members.select("entry", "path").join(files, "path").select("entry", "cited").repartition("entry")
    return rows.select("entry", F.explode("cited").alias("c")).groupBy("c.key", "entry").agg(F.sum("c.n").alias("n"), F.count("*").alias("n_files"))
