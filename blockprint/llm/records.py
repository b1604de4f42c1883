"""Token ids as files of length-delimited binary records.

A file is a sequence of frames: length (8 bytes, little-endian), masked CRC of those 8 bytes (4), payload, masked CRC of
the payload (4); the CRC is CRC-32C with the mask of the record format that training frameworks read. A payload has the
document id (8 bytes, signed; flag 0 for a null id), a flag byte (bit 0: id present, bits 1-2: bytes of an id less one)
and the ids. Beside each file stands an index: for each record its offset, for reads in shuffled order.

Records stand in ascending order of doc_id (null first; repeated rows side by side) across files, which are numbered. A
task writes under a name of its own and reports it; only reported files count, so a task that is run again does no harm.
Files are written and read through pyarrow's file systems, below the folder given as a URI. Null texts are empty; a
document without ids is a record with the end id alone; texts of any length are one record. An empty table gives no files
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprint.llm.bpe import PreTokens, byte_of_char, vocabulary
from blockprint.llm.common import column, cut, shuffle_partitions

#: Fixed values of the record format: the polynomial of CRC-32C (reflected), and the mask's rotation and constant.
POLYNOMIAL, ROTATION, MASK = 0x82F63B78, 15, 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qB")
#: Pre-tokens whose ids a worker keeps, in each of two generations; the library's model is slow to ask.
CACHE = 480_000
#: Bytes whose CRCs numpy takes side by side.
LANES = 256


@functools.lru_cache(maxsize=2)
def crc_table(bits: int = 8) -> np.ndarray:
    """How each value of that many bits, as the low bits of a state, changes it."""
    table = np.arange(1 << bits, dtype=np.uint32)
    for _ in range(bits):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


@functools.lru_cache(maxsize=64)
def zeros_operator(power: int) -> tuple[tuple[int, ...], ...]:
    """How 2**power zero bytes change a CRC state, as four tables of 256 values for its bytes."""
    if power == 0:
        table = crc_table().tolist()
        step = lambda s: table[s & 255] ^ s >> 8
    else:
        half = zeros_operator(power - 1)
        step = lambda s: advance(advance(s, half), half)
    bits = [step(1 << b) for b in range(32)]
    out = []
    for k in range(4):
        table = [0] * 256
        for v in range(1, 256):
            low = v & -v
            table[v] = table[v ^ low] ^ bits[8 * k + low.bit_length() - 1]
        out.append(tuple(table))
    return tuple(out)


def advance(state: int, tables: tuple[tuple[int, ...], ...]) -> int:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


def masked(crc: int) -> int:
    return ((crc >> ROTATION | crc << (32 - ROTATION)) + MASK) & 0xFFFFFFFF


def crc32c_many(values: list[bytes]) -> list[int]:
    """CRC-32C of each value. Values are cut into lanes of 256 bytes (aligned to their ends), which numpy takes in step;
    the lanes' states are joined by the zero operators of CRC arithmetic."""
    if not values:
        return []
    lengths = np.array([len(v) for v in values])
    lanes = np.maximum(1, -(-lengths // LANES))
    ends = np.cumsum(lanes) * LANES
    data = np.zeros(int(ends[-1]), np.uint8)
    flat = np.frombuffer(b"".join(values), np.uint8)
    where = np.repeat(ends - np.cumsum(lengths), lengths) + np.arange(len(flat))
    data[where] = flat
    grid, table, state = np.ascontiguousarray(data.view("<u2").reshape(-1, LANES // 2).T), crc_table(16), np.zeros(len(data) // LANES, np.uint32)
    for row in grid:  # two bytes at a time; leading zeros leave a zero state as it is
        state = table[(state ^ row) & 0xFFFF] ^ (state >> 16)
    states, joined, at = state.tolist(), zeros_operator(LANES.bit_length() - 1), 0
    out = []
    for n, length in zip(lanes.tolist(), lengths.tolist(), strict=True):
        s = 0
        for x in states[at : at + n]:
            s = advance(s, joined) ^ x
        at += n
        start, k = 0xFFFFFFFF, 0  # the initial value, moved over the whole length
        while length >> k:
            if length >> k & 1:
                start = advance(start, zeros_operator(k))
            k += 1
        out.append(s ^ start ^ 0xFFFFFFFF)
    return out


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    return [h + struct.pack("<I", masked(a)) + p + struct.pack("<I", masked(b)) for h, p, a, b in zip(heads, payloads, crc32c_many(heads), crc32c_many(payloads), strict=True)]


def unframed(data: bytes, offsets: list[int]) -> list[bytes]:
    """The payloads of the frames at offsets; raises ValueError where a length or checksum is wrong."""
    heads, payloads, sums = [], [], []
    for at in offsets:
        if at + HEAD.size > len(data):
            raise ValueError(f"record at {at}: cut off")
        length, crc = HEAD.unpack_from(data, at)
        heads.append((data[at : at + 8], crc))
        end = at + HEAD.size + length
        if end + 4 > len(data):
            raise ValueError(f"record at {at}: cut off")
        payloads.append(data[at + HEAD.size : end])
        sums.append(struct.unpack_from("<I", data, end)[0])
    for kind, parts, told in (("length", [h for h, _ in heads], [c for _, c in heads]), ("payload", payloads, sums)):
        for at, got, want in zip(offsets, crc32c_many(parts), told, strict=True):
            if masked(got) != want:
                raise ValueError(f"record at {at}: wrong checksum of its {kind}")
    return payloads


def packed(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return BODY.pack(doc_id or 0, (doc_id is not None) | width - 1 << 1) + ids.astype(f"<u{width}").tobytes()


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flag = BODY.unpack_from(payload)
    return doc_id if flag & 1 else None, np.frombuffer(payload, f"<u{(flag >> 1) + 1}", offset=BODY.size).astype("<u4")


class LibraryEncoder:
    """Ids by the tokenizers library. Where the vocabulary is byte-level with the usual pattern, the library's model is
    asked for each pre-token once and the ids are kept; other vocabularies, and texts with the string of a special token,
    go to the library whole."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec, special, _ = vocabulary(path)
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None
        self.special = list(special) if plain else [""]
        self.end = np.array([end], "<u4").tobytes()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
        self.tokenize = self.tokenizer.model.tokenize
        self.visible = {b: c for c, b in byte_of_char().items()}
        self.plain = PreTokens(self.piece, CACHE)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        if text.isascii() and text.lstrip(" ").isalnum():  # such characters stand for themselves
            shown = text.replace(" ", self.visible[ord(" ")])
        else:
            shown = text.encode().decode("latin-1").translate(self.visible)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.frombuffer(self.whole(text) + self.end, "<u4")
        return np.frombuffer(self.plain(text) + self.end, "<u4")


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, end: int) -> LibraryEncoder:
    return LibraryEncoder(path, end)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("file:///", "/") if uri.startswith("file:///") else uri)


def writer(folder: str, encoder: Callable[[], Callable]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder()
        store, base = file_system(folder)
        name, at, ids_in, offsets = f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0, []
        out = None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                rows = [(d, encode(t or "")) for d, t in zip(column(piece, "doc_id").to_pylist(), column(piece, "text").to_pylist(), strict=True)]
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}.records")
                for f in frames([packed(d, ids, encode.width) for d, ids in rows]):
                    offsets.append(at)
                    at += len(f)
                    out.write(f)
                ids_in += sum(len(ids) for _, ids in rows)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{base}/{name}.index") as index:
            index.write(np.array(offsets, "<u8").tobytes())
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_records": pa.array([len(offsets)], pa.int64()), "n_ids": pa.array([ids_in], pa.int64()), "n_bytes": pa.array([at], pa.int64())})

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int = 0) -> DataFrame:
    """Writes doc_id, text below folder in ascending doc_id order; one row per file: part, file, n_records, n_ids, n_bytes.

    Rows are dealt by ranges of (doc_id, hash of the text), so a repeated id does not fill one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    written = rows.select("doc_id", "text").mapInArrow(writer(folder, lambda: library_encoder(tokenizer, end)), "part int, file string, n_records long, n_ids long, n_bytes long")
    return cut(written)


def read_ids(files: DataFrame, digests: bool = False) -> DataFrame:
    """The records of write_ids()' files, by their index: part, place (in the file), doc_id, ids (32-bit, little-endian);
    or, instead of the ids, their number and CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(column(batch, "part").to_pylist(), column(batch, "file").to_pylist(), strict=True):
                store, path = file_system(file)
                with store.open_input_stream(f"{path}.index") as f:
                    offsets = np.frombuffer(f.read(), "<u8").tolist()
                with store.open_input_file(f"{path}.records") as f:
                    ends = [*offsets[1:], f.size()]
                    for i in range(0, len(offsets), 500):
                        base = offsets[i]
                        data = f.read_at(ends[min(i + 500, len(offsets)) - 1] - base, base)
                        rows = [unpacked(p) for p in unframed(data, [o - base for o in offsets[i : i + 500]])]
                        raw = [ids.tobytes() for _, ids in rows]
                        what = {"n_tokens": pa.array([len(x) // 4 for x in raw], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64())} if digests else {"ids": pa.array(raw, pa.binary())}
                        yield pa.record_batch({"part": pa.array([part] * len(rows), pa.int32()), "place": pa.array(range(i, i + len(rows)), pa.int64()), "doc_id": pa.array([d for d, _ in rows], pa.int64())} | what)

    # One file for a task: the list has a row for each file.
    spread = files.select("part", "file").repartition(max(1, shuffle_partitions(files.sparkSession)), "part")
    return spread.mapInArrow(run, "part int, place long, doc_id long, " + ("n_tokens long, ids_crc32 long" if digests else "ids binary"))


def placed(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record that the files hold. The sums before each file come from the
    list of files (one row a file), and those inside a file from a window over its records."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = read_ids(files, digests=True).withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(starts, "part").select("doc_id", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end: int = 0) -> DataFrame:
    return placed(write_ids(docs, folder, tokenizer, end))
