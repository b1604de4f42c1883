"""WARC archives in Zstandard: a leading skippable frame with the dictionary, then one frame per record.

write_archives() stores pages as response and revisit records; read_archives() reads such files back: it loads the
dictionary, finds each frame by its block headers, decodes it alone and checks version, header lines, lengths and payload
digests. A file that is wrong raises ValueError with the place, which fails the task.

Nulls: a null html is an empty payload, a null url has no WARC-Target-URI, a null page_id the id "none" and is never the
page referred to while another has the payload. Repeated rows of a page_id that is the largest are all responses.
page_id may be a number or text. An empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprint.llm.common import column, cut, shuffle_partitions
from blockprint.llm.records import file_system

#: Fixed values of the format: the dictionary frame's magic number, those of a dictionary and of a frame.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"
SAMPLES, DICTIONARY_BYTES, READ_BYTES = 300, 16 << 10, 4 << 20


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on a file's first records; empty where they are too few or too alike for that."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 50 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(raw: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(raw) if raw else b""
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def record(kind: str, page: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(lines: list[bytes], what: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{what}: a header line without a name")
        out[name.lower()] = value.strip()
    return out


def number(fields: dict[str, str], name: str, what: str) -> int:
    if not (value := fields.get(name, "")).isascii() or not value.isdigit():
        raise ValueError(f"{what}: {name} is missing or no number")
    return int(value)


def parse_record(data: bytes, what: str) -> dict:
    """The fields of one decoded record; raises ValueError where version, headers, lengths or digest are wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"{what}: no WARC header")
    f = header_fields(lines, what)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(f):
        raise ValueError(f"{what}: without {sorted(missing)}")
    size = number(f, "content-length", what)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{what}: Content-Length is {size}, the record has {len(rest) - 4}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError(f"{what}: no HTTP header")
    told = number(header_fields(lines, what), "content-length", what)
    digest = f.get("warc-payload-digest", "")
    if not digest.startswith("sha1:"):
        raise ValueError(f"{what}: no payload digest")
    digest = base64.b32decode(digest[5:]).hex()
    if f["warc-type"] == "response":
        if told != len(payload) or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{what}: the payload is not the one that was digested")
    elif f["warc-type"] != "revisit" or payload or "warc-refers-to" not in f:
        raise ValueError(f"{what}: neither a response nor a revisit")
    return {"record_type": f["warc-type"], "record_id": f["warc-record-id"], "url": f.get("warc-target-uri"), "payload": payload, "payload_bytes": told, "payload_digest": digest, "refers_to": f.get("warc-refers-to")}


def frame_length(data: bytes | memoryview, at: int) -> int | None:
    """Bytes of the frame at a place, from its block headers; None if data end before it does."""
    head = bytes(data[at : at + 18])
    try:
        end = at + zstandard.frame_header_size(head)
        checked = zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        if len(head) < 18:
            return None
        raise ValueError(f"no frame at {at}: {e}") from e
    while True:
        if end + 3 > len(data):
            return None
        block = int.from_bytes(data[end : end + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError(f"a block of a reserved kind at {end}")
        end += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            end += 4 * checked
            return end - at if end <= len(data) else None


def read_archive(stream, name: str) -> Iterator[dict]:
    """The records of an open file, read in pieces."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise ValueError(f"{name}: no dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError(f"{name}: the dictionary frame is cut off")
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    if raw and raw[:4] != struct.pack("<I", DICTIONARY):
        raise ValueError(f"{name}: the leading frame holds no dictionary")
    decode = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    data, at, place, ended = b"", 0, 8 + size, False
    while True:
        length = frame_length(data, at) if at < len(data) else None
        if length is None:
            if ended and at < len(data):
                raise ValueError(f"{name}: the frame at {place} is cut off")
            if ended:
                return
            more = stream.read(READ_BYTES)
            ended = len(more) == 0
            data, at = data[at:] + more, 0
            continue
        try:
            text = decode.decompress(data[at : at + length])
        except zstandard.ZstdError as e:
            raise ValueError(f"{name}: the frame at {place}: {e}") from e
        yield parse_record(text, f"{name}, frame at {place}")
        at += length
        place += length


def record_kinds(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with payload_digest, payload_bytes, record_type and refers_to.

    Groups are counted by (digest, length) with partial sums; only groups of two and more are joined back, by a sort merge
    join that may split a hot group (its other side has one row), or by a broadcast if Spark finds them small.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"payload_digest": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long"), "_check": F.xxhash64("html")})
    key = ["payload_digest", "payload_bytes", "_check"]
    groups = base.where(F.col("payload_bytes") >= least).groupBy(*key).agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    out = base.join(groups, key, "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def write_archives(kinds: DataFrame, folder: str) -> DataFrame:
    """Writes record_kinds()' rows below folder, a file for each partition: file, n_records, n_bytes. Names are a task
    attempt's own and only files in this list count, so a task that is run again does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(0, batch.num_rows, 200):
                    for r in batch.slice(i, 200).to_pylist():
                        yield record(r["record_type"], named(r["page_id"]), r["url"], r["html"].encode(), r["payload_bytes"], r["payload_digest"], named(r["refers_to"]))

        rest = records()
        first = list(itertools.islice(rest, SAMPLES))
        if not first:
            return
        raw = dictionary(first)
        press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
        with store.open_output_stream(f"{base}/{name}") as out:
            size += out.write(dictionary_frame(raw)) or 0
            for part in (first, rest):
                for r in part:
                    frame = press.compress(r)
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
        yield pa.record_batch({"file": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    return cut(kinds.mapInArrow(run, "file string, n_records long, n_bytes long"))


READ = {"record_type": pa.string(), "record_id": pa.string(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string()}


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files listed in column file; without payloads, these are checked but not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [k for k in READ if payloads or k != "payload"]
        for batch in batches:
            for file in column(batch, "file").to_pylist():
                store, path = file_system(file)
                with store.open_input_stream(path) as stream:
                    rows = []
                    for r in read_archive(stream, file):
                        rows.append(r if payloads else {k: r[k] for k in keys})
                        if len(rows) == 200:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, READ[k]) for k in keys]))
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, READ[k]) for k in keys]))

    schema = "record_type string, record_id string, url string, " + "payload binary, " * payloads + "payload_bytes long, payload_digest string, refers_to string"
    return files.select("file").repartition(shuffle_partitions(files.sparkSession), "file").mapInArrow(run, schema)


def named(page) -> str:
    """A page_id as it stands in a record's id: "none" for null; characters that have no place there are escaped."""
    return "none" if page is None else "%6Eone" if page == "none" else quote(str(page), safe="")


def page_of(urn: str, kind: str):
    """The page_id, of a type, in a record's id."""
    name = F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)
    return F.when(F.col(urn).isNotNull() & (name != "none"), F.url_decode(name).try_cast(kind))


def archived_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages to archives and returns, from what is read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    read = read_archives(write_archives(record_kinds(pages), folder), payloads=False)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read.select(page_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to", kind).alias("refers_to"))
