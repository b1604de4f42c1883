"""Reading files to digest and lists of digests; writing such lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprint.functions import hashes
from blockprint.functions.digests import digest_checked
from blockprint.functions.incremental import StreamDigest
from blockprint.plans.checkpoints import cut

LARGE = pa.schema([("path", pa.string()), ("length", pa.int64()), ("digest", pa.struct([("log_block_size", pa.int32()), ("bh1", pa.string()), ("bh2", pa.string())])), ("error", pa.string())])


def hash_files(spark: SparkSession, path: str | list[str], long: bool = False) -> DataFrame:
    """path, length, digest, error for each file (2 GiB at most; larger ones go through chunks). A file whose content is
    not as long as it was when it was listed gives an error and no digest. Spark's scan leaves out empty files; they come
    from its listing, which the driver has anyway."""
    files = spark.read.format("binaryFile").load(path)
    checked = digest_checked("content", "length", truncate=not long, long=long)
    full = files.select("path", "length", checked.alias("_d")).select("path", "length", F.col("_d.hash").alias("digest"), F.col("_d.error").alias("error"))
    listed = spark.createDataFrame([(re.sub(r"^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()], "path string")
    none = listed.join(files.select("path"), "path", "left_anti")
    return full.unionByName(none.select("path", F.lit(0).cast("long").alias("length"), hashes.empty().alias("digest"), F.lit(None).cast("string").alias("error")))


def hash_large_files(paths: DataFrame, path: str = "path", long: bool = False, buffer: int = 4 << 20) -> DataFrame:
    """path, length, digest, error of each file named in a column, of any size: a task reads a file in pieces and keeps a few
    kilobytes of state. A file of more bytes than digests are for has an error and no digest. Paths are opened with pyarrow's file systems (local, s3, gs, hdfs with its native library); for
    stores that only Spark reads use hash_files() or chunk rows. A missing file fails the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", name))
                state = StreamDigest()
                with store.open_input_stream(inner) as stream:
                    while piece := stream.read(buffer):
                        state.update(piece)
                h = None if state.error else dict(zip(("log_block_size", "bh1", "bh2"), state.digest(long), strict=True))
                yield pa.RecordBatch.from_pylist([{"path": name, "length": state.size, "digest": h, "error": state.error}], LARGE)

    rows = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("path"))
    return rows.repartition("path").mapInArrow(run, f"path string, length long, digest {hashes.HASH}, error string")


def write_files(df: DataFrame, folder: str, name: str, data: str) -> DataFrame:
    """path of a file for each row, with the row's text or bytes; a null is an empty file. A task that is run again writes the
    same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))
        store.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{n}") as out:
                    out.write(v or b"")
                paths.append(f"{folder}/{n}")
            yield pa.record_batch({"path": pa.array(paths, pa.string())})

    return cut(df.select(F.col(name).cast("string").alias("name"), F.col(data).cast("binary").alias("data")).mapInArrow(run, "path string"))


def read_hashes(spark: SparkSession, path: str | list[str], long: bool = True, normalized: bool = False, strict: bool = False) -> DataFrame:
    """text, digest, file_name, error of each line of a list; blank lines and comments (#) are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parsed = lines.select(F.col("value").alias("text"), hashes.parse("value", long, normalized, strict).alias("_p"))
    return parsed.select("text", F.col("_p.hash").alias("digest"), F.col("_p.file_name").alias("file_name"), F.col("_p.error").alias("error"))


def hash_line(digest: Column | str, file_name: Column | str | None = None) -> Column:
    text = hashes.to_string(digest)
    return text if file_name is None else F.concat(text, F.coalesce(F.concat(F.lit(',"'), F.col(file_name) if isinstance(file_name, str) else file_name, F.lit('"')), F.lit("")))


def write_hashes(df: DataFrame, path: str, digest: str = "digest", file_name: str | None = None) -> None:
    """One line per digest; null digests are left out."""
    df.where(F.col(digest).isNotNull()).select(hash_line(digest, file_name).alias("value")).write.text(path)
