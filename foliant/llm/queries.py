"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.url_filter import entries_of, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), entries_of(spark))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), 20, 20)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.token_files import token_file_digest

    return token_file_digest(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from foliant.llm.topk import top_k, vector_entries

    entries = vector_entries(table(spark, sf_dir, "embeddings"))
    return top_k(entries, entries.filter(F.col("id") % 20 == 0), 20).withColumnRenamed("id", "vec_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("places")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.periodic import run_digest_of

    return run_digest_of(spark, table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.pieces import piece_digest

    return piece_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.vector_codes import code_digest

    return code_digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from foliant.llm import licenses, mixing, near_dup, periodic, topk, url_filter, vector_codes

    return {"op1_url_filter": url_filter.oracle(), "op3_mixing": mixing.oracle(), "op5_near_dup": near_dup.oracle(), "op8_top_k": topk.oracle(), "op9_licenses": licenses.oracle(), "op11_periodic_runs": periodic.oracle(), "op13_vector_codes": vector_codes.oracle()}
