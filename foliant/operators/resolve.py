"""Citation keys across several libraries in a given order, with pairwise agreement of what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ascii_lower, compared


def same_work(a_doi: Column, b_doi: Column, a_title: Column, b_title: Column, a_year: Column, b_year: Column) -> Column:
    """Whether two sources are one work: the same DOI (ASCII case aside), or the same normalized title and year."""
    doi = F.coalesce((a_doi != "") & (ascii_lower(a_doi) == ascii_lower(b_doi)), F.lit(False))
    title = F.coalesce((a_title != "") & (a_title == b_title) & (a_year == b_year), F.lit(False))
    return doi | title


def ranked(sources: DataFrame, order: DataFrame, key: str | None = None) -> DataFrame:
    """Active keyed sources of the listed libraries with title_norm and rank, by library position and then id.

    sources: id, library_id, citation_key, title, year, doi, status. order: library_id, position.
    """
    s = sources.filter("status = 'active' and citation_key is not null")
    if key is not None:
        s = s.filter(F.col("citation_key") == key)
    s = s.join(order, "library_id").withColumn("title_norm", compared(F.col("title")))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("citation_key").orderBy("position", "id")))


def winners(sources: DataFrame, order: DataFrame) -> DataFrame:
    """The first source of each key, conflicts included."""
    return ranked(sources, order).filter("rank = 1")


def conflicts(sources: DataFrame, order: DataFrame) -> DataFrame:
    """citation_key of each group in which not every pair agrees, with its size."""
    return conflicts_of(ranked(sources, order))


def conflicts_of(r: DataFrame) -> DataFrame:
    """The same of ranked() sources.

    Each pair must share its DOI or its title and year. Both are equivalences between sources, and if two equivalences
    together relate all pairs, one of them does so alone. So a group agrees exactly if all its sources share one DOI, or
    all share one title and year; no pairs are made, however many sources a key has.
    """
    one = lambda c: (F.count(c) == F.count("*")) & F.min(c).eqNullSafe(F.max(c))
    doi, title = ascii_lower(F.nullif("doi", F.lit(""))), F.nullif("title_norm", F.lit(""))
    rows = r.select("citation_key", doi.alias("d"), title.alias("t"), "year")
    groups = rows.groupBy("citation_key").agg(F.count("*").alias("members"), (one("d") | (one("t") & one("year"))).alias("agree"))
    return groups.filter("members > 1 and not agree").select("citation_key", "members")


def resolve(sources: DataFrame, order: DataFrame, keys: DataFrame) -> DataFrame:
    """For each asked key: status (not_found, found, conflict), the winner's id, and how many others there are."""
    r = ranked(sources, order).join(keys.select("citation_key").distinct(), "citation_key", "left_semi")
    members = r.groupBy("citation_key").agg(F.count("*").cast("int").alias("n"), F.min_by("id", "rank").alias("first"))
    bad = conflicts_of(r).select("citation_key", F.lit(True).alias("bad"))
    out = keys.select("citation_key").distinct().join(members, "citation_key", "left").join(bad, "citation_key", "left")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("bad"), "conflict").otherwise("found")
    return out.select("citation_key", status.alias("status"), F.when(status == "found", F.col("first")).alias("winner"), F.when(status == "found", F.col("n") - 1).otherwise(F.col("n")).alias("n_others"))


def others(sources: DataFrame, order: DataFrame, keys: DataFrame) -> DataFrame:
    """citation_key, rank and id of the sources of asked keys that are not the winner, in order; of a conflict all."""
    r = ranked(sources, order).join(keys.select("citation_key").distinct(), "citation_key", "left_semi")
    rows = r.join(conflicts_of(r).select("citation_key", F.lit(True).alias("bad")), "citation_key", "left")
    return rows.filter(F.col("bad") | (F.col("rank") > 1)).select("citation_key", "rank", "id").orderBy("citation_key", "rank")
