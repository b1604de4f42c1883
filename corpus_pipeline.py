"""From raw documents to token ids in five stages, each an operator of blockprint.llm.

A stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns token ids.
The stages' results are defined for nulls, repeated rows and empty tables as their operators say: a null text counts as
empty, rows that are equal in doc_id and text are one document after the Jaccard stage, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprint.llm import bpe, jaccard, mixing, quality, suffixes
from blockprint.llm.common import fresh_folder, remove_folder, text_key
from blockprint.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of linked documents; documents without an id all stay."""
    first = jaccard.join(docs).where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    return kept.dropDuplicates(["id", "key"]).select("row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings that a document with a smaller doc_id has; documents of which nothing is left go."""
    out = suffixes.drop_repeated_strings(docs, keep_text=True).where("n_removed = 0 or length(text) > 0")
    others = {c: F.col(f"rest.{c}") for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in others:
        others["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[others.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources asks for."""
    return mixing.mixture(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit integers) of each row."""
    return bpe.encode_documents(docs, tokenizer_path(), digests=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL cannot express the classifier, the links' components, the mix's seeded order or BPE; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage has written is deleted when the next one has; the last one's input stays,
    as its result reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = fresh_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
