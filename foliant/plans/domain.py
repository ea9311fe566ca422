"""The library's tables, derived from the generated tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '2030-01-01 00:00:00'"

VIEWS = {
    "library": "SELECT CAST(v AS BIGINT) AS library_id, CASE WHEN v = 0 THEN 'user' ELSE 'group' END AS kind, CAST(v AS BIGINT) AS number, 'Library ' || CAST(v AS STRING) AS name FROM (VALUES (0), (1), (2), (3), (4)) AS t(v)",
    "source": "SELECT doc_id AS id, doc_id % 5 AS library_id, 'D' || CAST(doc_id AS STRING) AS item_key, CASE WHEN doc_id % 17 <> 0 THEN substr(lower(text), 1, 12) END AS citation_key, split_part(text, chr(10), 1) AS title, CAST(1990 + n_chars % 30 AS INT) AS year, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || CAST(n_chars AS STRING) END AS doi, CASE WHEN doc_id % 19 = 0 THEN 'retired' ELSE 'active' END AS status FROM {documents}",
    "stored": "SELECT doc_id % 5 AS library_id, 'D' || CAST(doc_id AS STRING) AS item_key, doc_id AS id, CAST(n_chars AS STRING) AS data_hash, CASE WHEN doc_id % 13 = 0 THEN 'retired' ELSE 'active' END AS status, CAST(n_chars AS STRING) AS title, 'early' AS first_seen, 'early' AS last_seen FROM {documents} WHERE doc_id % 10 <> 0",
    "fetched": "SELECT doc_id % 5 AS library_id, 'D' || CAST(doc_id AS STRING) AS item_key, doc_id AS position, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END || CAST(n_chars AS STRING) AS data_hash, 'T' || CAST(n_chars AS STRING) AS title FROM {documents} WHERE doc_id % 11 <> 0",
    "sync_run": "SELECT event_id AS id, user_id % 5 AS library_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, CAST(ts AS TIMESTAMP) AS finished_at, CASE WHEN event_type = 'error' THEN props END AS error FROM {events}",
    "attachment": "SELECT page_id AS id, page_id % 5 AS library_id, 'A' || CAST(page_id AS STRING) AS item_key, CASE WHEN page_id % 6 <> 0 THEN page_id END AS source_id, CASE WHEN page_id % 4 <> 0 THEN '/files/' || CAST(page_id AS STRING) || '.pdf' END AS path, CASE WHEN page_id % 9 = 0 THEN 'retired' ELSE 'active' END AS status FROM {pages}",
    "old_attachment": "SELECT page_id % 5 AS library_id, 'A' || CAST(page_id AS STRING) AS item_key, page_id AS source_id, CASE WHEN page_id % 4 <> 0 THEN '/files/' || CAST(page_id AS STRING) END AS path, 'c' || CAST(page_id AS STRING) AS checksum, page_id % 30 AS page_count FROM {pages} WHERE page_id % 8 <> 0",
    "new_attachment": "SELECT page_id % 5 AS library_id, 'A' || CAST(page_id AS STRING) AS item_key, 'D' || CAST(page_id AS STRING) AS parent_key, CASE WHEN page_id % 4 <> 0 THEN '/files/' || CASE WHEN page_id % 3 = 0 THEN 'moved/' ELSE '' END || CAST(page_id AS STRING) END AS path FROM {pages} WHERE page_id % 7 <> 0",
    "queue": "SELECT doc_id AS id, 'item' AS kind, 'k' || CAST(doc_id % 100 AS STRING) AS dedupe_key, CASE WHEN quality = 1 THEN TIMESTAMP '2029-01-01 00:00:00' END AS resolved_at FROM {labels}",
    "new_item": "SELECT doc_id AS position, 'k' || CAST(doc_id % 250 AS STRING) AS dedupe_key, 'new' AS kind FROM {labels} WHERE doc_id % 2 = 0",
    "entry": "SELECT substr(lower(text), 1, 12) || CASE WHEN doc_id % 23 = 0 THEN '?' ELSE '' END AS key, split_part(text, chr(10), 1) || CASE WHEN doc_id % 5 = 0 THEN ' II' ELSE '' END AS title, CASE WHEN doc_id % 4 <> 0 THEN CAST(1990 + (n_chars + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) % 30 AS INT) END AS year, CASE WHEN doc_id % 6 = 0 THEN '10.1/' || CAST(n_chars + doc_id % 2 AS STRING) END AS doi, doc_id AS position FROM {documents}",
    "quote": "SELECT item_id AS quote_id, item_id * 7 % (SELECT count(*) FROM {documents}) AS doc_id, text AS quote FROM {benchmark}",
    "extraction": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a' END AS backend, text, doc_id AS position FROM {documents}",
    "tagged": "SELECT doc_id AS source_id, doc_id % 5 AS library_id, lang AS tag, source AS tag2 FROM {documents} WHERE doc_id % 11 <> 0",
    "record": "SELECT doc_id, '{{\"key\":\"D' || CAST(doc_id AS STRING) || '\",\"version\":' || CAST(doc_id AS STRING) || ',\"library\":{{\"name\":\"L' || CAST(doc_id % 5 AS STRING) || '\"}},\"data\":{{\"key\":\"D' || CAST(doc_id AS STRING) || '\",\"itemType\":\"' || CASE WHEN doc_id % 4 = 0 THEN 'note' ELSE 'book' END || '\",\"title\":\"' || lang || '\",\"date\":\"March ' || CAST(1990 + n_chars % 30 AS STRING) || '\",\"DOI\":\" ' || CASE WHEN doc_id % 3 = 0 THEN '10.1/' || CAST(n_chars AS STRING) ELSE '' END || ' \",\"citationKey\":null,\"tags\":[{{\"tag\":\"' || source || '\"}}],\"collections\":[\"C1\"]}}}}' AS value FROM {documents}",
}
TABLES = ("documents", "events", "pages", "labels", "benchmark", "conversations", "orders", "lineitem", "customer", "part")


def sql_of(name: str) -> str:
    """The view for DuckDB."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view for Spark."""
    used = [t for t in TABLES if f"{{{t}}}" in VIEWS[name]]
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
