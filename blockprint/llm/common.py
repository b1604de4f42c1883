"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprint.plans.checkpoints import cut, shared_folder

__all__ = ["WORD", "WORD_PATTERN", "binary", "bytes_and_bounds", "column", "cut", "fresh_folder", "in_small_batches", "pieces", "remove_folder", "shared_folder", "shuffle_partitions", "text_key"]

#: A word: a maximal run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: Text bytes that one numpy pass of a map task holds; about 10 arrays of 8 bytes each stand beside it.
CHUNK_BYTES = 3 << 19


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A URI below the shared folder that nothing else uses."""
    base = shared_folder(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, uri: str) -> None:
    """Deletes a folder through the file systems that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SMALL_BATCH = 1000


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs, after lowering Spark's default of 10,000 rows to an Arrow batch, as texts are long; a setting of the user's
    own below that stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(docs.sparkSession.conf.get(name)) > SMALL_BATCH:
        docs.sparkSession.conf.set(name, str(SMALL_BATCH))
    return docs


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> Column:
    """64 bits of a text; rows are told apart by this and their id, so repeated rows get the same results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def binary(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column of strings or bytes as one array with 64-bit offsets, nulls as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else pa.large_binary()).fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")


def bytes_and_bounds(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and the len + 1 bounds of the values in them."""
    col = binary(col)
    bounds = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices whose texts have about `most` bytes; a longer text has a slice of its own."""
    if not batch.num_rows:
        return
    _, bounds = bytes_and_bounds(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
