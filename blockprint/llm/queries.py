"""The queries opN_<name> and `pipeline`: thin uses of the operators, whose results the contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprint.llm import sql
from blockprint.llm.common import fresh_folder

#: Where the vocabulary files are; a parameter of the operators, never copied.
BPE_FILE = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.jaccard import join

    return join(table(spark, sf_dir, "documents")).drop("key")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.records import written_and_read

    return written_and_read(spark, table(spark, sf_dir, "documents"), fresh_folder(spark, "token-records"), tokenizer_path(), end=0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.tiff import media_digests, store_documents

    return media_digests(store_documents(table(spark, sf_dir, "documents")))


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.suffixes import drop_repeated_strings

    return drop_repeated_strings(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True, ids=False)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op8_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.superkmers import drop_repeated_windows

    return drop_repeated_windows(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"), fresh_folder(spark, "archives"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockprint.llm.mixing import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_token_records, op3_quality, op4_tiff_pages, op5_suffix_arrays, op6_bpe, op7_rules, op8_superkmers, op9_warc, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    """The other results depend on models, seeded hashes or encoders; tests hold them against plain versions."""
    return {"op1_jaccard_join": sql.JACCARD, "op5_suffix_arrays": sql.STRINGS, "op8_superkmers": sql.WINDOWS, "op9_warc": sql.ARCHIVES, "op10_mixing": sql.MIX}
