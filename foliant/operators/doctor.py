"""All findings about a store and a project as one operation, and what they put into the review queue."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import drift, findings, resolve, review


@dataclass
class Subject:
    """libraries, sources, runs, attachments and the review queue of a store; files: paths that exist; where the store is,
    its schema version, and why the remote library does not answer (None if it does)."""

    libraries: DataFrame
    sources: DataFrame
    runs: DataFrame
    attachments: DataFrame
    queue: DataFrame
    files: DataFrame
    place: str
    version: int
    remote_error: str | None = None


@dataclass
class Project:
    """Its name, the order of its libraries (library_id, position), and the entries of its citation file with errors."""

    name: str
    order: DataFrame
    entries: DataFrame


def examine(subject: Subject, now: Column, project: Project | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings (ord, severity, code, message), and the review queue with what they add. What was added is counted."""
    s = subject
    spark = s.sources.sparkSession
    queue = s.queue
    parts = [
        findings.store_finding(spark, s.place, s.version, s.remote_error),
        findings.library_findings(findings.library_status(s.libraries, s.sources, s.runs, now)),
        findings.source_findings(s.sources, s.libraries),
        findings.attachment_findings(s.attachments, s.sources, s.libraries, s.files),
    ]
    if project is not None:
        ranked = resolve.ranked(s.sources, project.order)
        conflicts = resolve.conflicts_of(ranked)
        queue = review.enqueue(queue, findings.conflict_items(conflicts, project.name, now))
        readable = drift.without(project.entries.filter("error is null"), "key", conflicts)
        differences = drift.compare(readable, drift.without(ranked.filter("rank = 1"), "citation_key", conflicts))
        parts.append(findings.project_finding(spark, project.name, project.order.count()))
        parts.append(findings.project_findings(project.order, s.libraries, ranked, conflicts, differences))
        parts.append(findings.unreadable(project.entries))
    parts.append(findings.review_finding(review.open_count(queue)))
    return reduce(DataFrame.unionByName, parts), queue
