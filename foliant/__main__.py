"""``python -m foliant status|doctor STORE [--json]``: the state of a store as text or JSON. Exits 1 on warnings."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant import reports
from foliant.operators import doctor, findings
from foliant.store import Store


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliant")
    parser.add_argument("what", choices=("status", "doctor"))
    parser.add_argument("store")
    parser.add_argument("--json", action="store_true")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    store, now = Store(spark, a.store), F.current_timestamp()
    missing = [t for t in ("library", "source", "sync_run", "attachment", "review") if store.read(t) is None]
    if missing:
        parser.error(f"{a.store} has no table {missing[0]}")
    libraries, sources, runs, files, queue = (store.read(t) for t in ("library", "source", "sync_run", "attachment", "review"))
    if a.what == "status":
        rows, found = findings.library_status(libraries, sources, runs, now).orderBy("library_id"), None
    else:
        subject = doctor.Subject(libraries, sources, runs, files, queue, files.select("path").filter("path is not null"), a.store, store.schema_version)
        found, _ = doctor.examine(subject, now)
        rows = found.orderBy("ord", "message")
    if a.json:
        print("".join(reports.json_document(rows)))
    else:
        lines = reports.json_lines(rows) if found is None else reports.text_lines(rows, sys.stdout.isatty())
        for r in lines.toLocalIterator():
            print(r["line"])
    return int(found is not None and findings.exit_code(found).first()["exit_code"])


if __name__ == "__main__":
    sys.exit(main())
