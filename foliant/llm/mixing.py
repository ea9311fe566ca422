"""Mixing sources to target weights along a time-varying curriculum; DataFrame operations only.

Sources get words by weight from a budget, none more than ``most`` times its size; what is above is shared anew among
the others by weight (solved at once: in ascending order of cap / weight the capped sources are a prefix). A source's
documents, in a fixed pseudo-random order and repeated as often as needed, form a line of words, and the mix takes the
line up to the source's target; only the document at the end of it is taken in part. Each source has a weight
schedule over training time: the share of its target that is due by time u is the schedule's integral up to u, and a
copy is placed where that integral reaches the copy's start. Documents are then range-sorted by position.

Running sums are made in two steps, over buckets of each source and within each bucket, so that a source with most of
the rows is spread over as many tasks as there are buckets (the square root of the rows); one task sees a source's
buckets, never its documents. One task sees the list of sources.

Edge cases: a null text has size 0 and is never taken; a null source is a source, the last; sources of size 0 have
target 0; a null doc_id orders as the empty text; rows of one doc_id are ordered by their texts, so neither a doc_id
that many rows share nor a null one meets in one bucket; repeated rows are documents of their own; an empty table gives
an empty result; other columns pass through ``mixed_documents`` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import written

WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2.0
#: Weight over training time as (time, weight) knots, by the source's rank, repeating: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.2), (0.5, 0.8), (1.0, 2.2)))
WORD = r"[^\x20\x09-\x0D]+"


def inverse_sql(knots: tuple[tuple[float, float], ...], share: str) -> str:
    """SQL for the time at which the integral of a piecewise linear schedule reaches a share of its total."""
    num = lambda x: f"CAST({x!r} AS DOUBLE)"
    sums = [0.0]
    for (t, w), (t2, w2) in zip(knots, knots[1:]):
        sums.append(sums[-1] + (t2 - t) * (w + w2) / 2)
    out = ""
    for k, ((t, w), (t2, w2)) in enumerate(zip(knots, knots[1:])):
        r, a = f"({share} * {num(sums[-1])} - {num(sums[k])})", (w2 - w) / (t2 - t)
        step = f"CASE WHEN {r} <= 0 THEN {num(0.0)} ELSE 2 * {r} / ({num(w)} + sqrt(greatest({num(w * w)} + {num(2 * a)} * {r}, {num(0.0)}))) END"
        value = f"{num(t)} + {step}"
        out += f"WHEN {share} * {num(sums[-1])} < {num(sums[k + 1])} THEN {value} " if k + 2 < len(knots) else f"ELSE {value} END"
    return f"CASE {out}" if len(knots) > 2 else out.removeprefix("ELSE ").removesuffix(" END")


def position_sql(share: str, schedules: tuple = SCHEDULES, rank: str = "_rank") -> str:
    """The same of the schedule that belongs to a source's rank (from 0)."""
    arms = " ".join(f"WHEN {k} THEN {inverse_sql(s, share)}" for k, s in enumerate(schedules))
    return f"CASE {rank} % {len(schedules)} {arms} END"


def weight_of(rank: Column, weights: tuple[float, ...]) -> Column:
    out = F.lit(None).cast("double")
    for k, w in enumerate(weights):
        out = F.when(rank % len(weights) == k, F.lit(float(w))).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Of each source (source, _sk, _total): its rank and target. One row a source, so the windows have no key."""
    s = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("_weight", weight_of(F.col("_rank"), weights)).withColumn("_cap", F.col("_total") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    s = s.withColumn("_budget", F.sum("_total").over(Window.partitionBy()) * F.lit(float(budget)))
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    capped = F.col("_cap") <= F.col("_level") * F.col("_weight")
    s = s.withColumn("_free", F.max(F.when(~capped, F.col("_level"))).over(Window.partitionBy()))
    return s.withColumn("target", F.when(capped | F.col("_free").isNull(), F.col("_cap")).otherwise(F.col("_free") * F.col("_weight")))


def sized(docs: DataFrame) -> DataFrame:
    """Documents with size, source key and the place in their source's order."""
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    return docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_sk", key).withColumn("_ord", order)


def placed(rows: DataFrame, narrow: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """rows of sized() with their source's figures and how many of its words come before; narrow: the same rows, cheaply."""
    buckets = max(1, math.isqrt(narrow.count()))
    bucket = F.floor(F.conv(F.substring("_ord", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(float(1 << 32))).cast("long")
    sums = written(narrow.withColumn("_bucket", bucket).groupBy("_sk", "_bucket").agg(F.sum("_size").alias("_words"), F.first("source").alias("source")), "buckets")
    sources = targets(sums.groupBy("_sk").agg(F.sum("_words").alias("_total"), F.first("source").alias("source")), weights, budget, most)
    before = Window.partitionBy("_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0))).select("_sk", "_bucket", "_base").join(sources.select("_sk", "_total", "_rank", "target"), "_sk")
    inside = Window.partitionBy("_sk", "_bucket").orderBy("_ord", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_bucket", bucket).join(written(offsets, "offsets"), ["_sk", "_bucket"])
    out = out.withColumn("_start", F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return out.withColumn("_due", F.floor(F.col("target") + 0.5).cast("long"))


def taken_of(copy: Column) -> Column:
    """Words that the mix takes of a copy (from 0) of a document."""
    start = copy * F.col("_total") + F.col("_start")
    return F.greatest(F.lit(0), F.least(F.col("_due"), start + F.col("_size")) - start)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken and the first copy's position, range-sorted; one row per document."""
    narrow = written(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_sk", "_ord", "_size"), "sized")
    rows = placed(narrow, narrow, weights, budget, most)
    taken = sum((taken_of(F.lit(e)) for e in range(math.ceil(most))), F.lit(0))
    share = "CAST(_start AS DOUBLE) / CAST(_due AS DOUBLE)"
    position = F.when(taken_of(F.lit(0)) > 0, F.round(F.expr(position_sql(share)), 9))
    out = rows.withColumn("position", position).withColumn("_late", F.coalesce("position", 1 + F.col("_start") / F.greatest("_total", F.lit(1))))
    out = out.select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), "target", taken.cast("long").alias("taken"), "position", "_late")
    return out.orderBy("_late", "doc_id").drop("_late")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """The training order itself: a row with all columns for each copy taken, its text cut where the target ends it."""
    # All columns travel as one, so that none of theirs is taken for one of ours.
    rows = sized(docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))).drop("text")
    placed_rows = placed(rows, rows.select("doc_id", "source", "_sk", "_ord", "_size"), weights, budget, most)
    copies = placed_rows.withColumn("_copy", F.explode(F.array(*(F.lit(e) for e in range(math.ceil(most)))))).withColumn("_taken", taken_of(F.col("_copy"))).filter("_taken > 0")
    share = "CAST(_copy * _total + _start AS DOUBLE) / CAST(_due AS DOUBLE)"
    copies = copies.withColumn("_position", F.expr(position_sql(share)))
    text = F.col("_row.text")
    cut = F.when(F.col("_taken") < F.col("_size"), first_words(text, F.col("_taken"))).otherwise(text)
    kept = [F.col("_row").getField(c).alias(c) if c != "text" else cut.alias(c) for c in docs.columns]
    return copies.orderBy("_position", "_ord", "_copy").select(*kept)


def first_words(text: Column, n: Column) -> Column:
    """The text's first n words, joined as they stood up to white space, which becomes a space."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " "), F.lit(1), n.cast("int")), " ")


def oracle() -> str:
    """DuckDB SQL for mix() over documents."""
    share = "CAST(_start AS DOUBLE) / CAST(_due AS DOUBLE)"
    return f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS sk,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS ord
  FROM documents),
sources AS (SELECT sk, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY sk),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS _rank FROM sources),
weighed AS (
  SELECT *, CASE _rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CAST(total AS DOUBLE) * 2.0::DOUBLE AS cap, CAST(sum(total) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget
  FROM ranked),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, _rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY cap / w, _rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
freed AS (SELECT *, max(CASE WHEN cap > level * w THEN level END) OVER () AS free FROM levels),
targets AS (SELECT *, CASE WHEN cap <= level * w OR free IS NULL THEN cap ELSE free * w END AS target FROM freed),
placed AS (
  SELECT d.doc_id, d.size, t.total, t.target, t._rank, CAST(floor(t.target + 0.5) AS BIGINT) AS _due,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.sk ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS _start
  FROM sized d JOIN targets t ON d.sk = t.sk),
parts AS (
  SELECT *, greatest(0, least(_due, _start + size) - _start) AS one,
         greatest(0, least(_due, total + _start + size) - total - _start) AS two
  FROM placed)
SELECT doc_id, size, total AS source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one > 0 THEN round({position_sql(share)}, 9) END AS position
FROM parts"""
