"""TIFF pages: image directories, strips and tiles, PackBits, LZW and deflate, horizontal predictors.

decode_pages() walks the chain of image directories of a file (either byte order) and yields a row for each page with its
samples; encode_pages() writes files that it, or any TIFF reader, can read. 8-bit samples, any number of them a pixel.
A file that breaks off, loops or lies about sizes raises ValueError; the DataFrame form gives a row with `error` instead.

Nulls and empty bytes have no pages (one row with the error "empty"). Equal bytes give equal rows, repeated rows rows of
their own. An empty table gives an empty result; other columns are ignored, and the key keeps its name and type. Texts of
any length are stored, in pages of 1,024 rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockprint.llm.common import binary, column, in_small_batches

#: Fixed values of the format: tags, field types' sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
PLANES = 284
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_MOST = 256, 257, 258, 4094

#: More bytes than this from one byte of data come from no compression that is read.
MOST_EXPANSION = 4096


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more equal bytes as such, the rest as literals. The rows of a strip are taken as one."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    lengths = np.diff(np.append(starts, len(a)))
    long = np.flatnonzero(lengths >= 3)
    out, at = [], 0
    for s, n in zip([*starts[long].tolist(), len(a)], [*lengths[long].tolist(), 0], strict=True):
        for i in range(at, s, 128):
            piece = data[i : min(i + 128, s)]
            out += [bytes([len(piece) - 1]), piece]
        for i in range(0, n, 128):
            k = min(128, n - i)
            out.append(bytes([257 - k if k > 1 else 0, data[s]]))
        at = s + n
    return b"".join(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, got = [], 0, 0
    while got < size:
        if at >= len(data):
            raise ValueError("PackBits data are cut off")
        n = data[at]
        if n < 128:
            piece = data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            piece = data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 1 if n == 128 else 2
        out.append(piece)
        got += len(piece)
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early, and the table is cleared when full."""
    single = {bytes([i]): i for i in range(256)}
    table, codes, widths = dict(single), [LZW_CLEAR], [9]
    nxt, width, cur = LZW_FIRST, 9, b""
    for i in range(len(data)):
        longer = cur + data[i : i + 1]
        if longer in table:
            cur = longer
            continue
        codes.append(table[cur])
        widths.append(width)
        table[longer] = nxt
        nxt += 1
        cur = data[i : i + 1]
        if nxt > LZW_MOST:
            codes.append(LZW_CLEAR)
            widths.append(12)
            table, nxt, width = dict(single), LZW_FIRST, 9
        elif nxt + 1 > 1 << width:
            width += 1
    if cur:
        codes.append(table[cur])
        widths.append(width)
        nxt += 1
        if nxt + 1 > 1 << width and width < 12:
            width += 1
    codes.append(LZW_END)
    widths.append(width)
    w, c = np.array(widths), np.array(codes)
    group, place = np.repeat(np.arange(len(w)), w), np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    return np.packbits((c[group] >> (w[group] - 1 - place)) & 1).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, got, acc, bits, width, prev, at = [], 0, 0, 0, 9, None, 0
    while got < size:
        while bits < width:
            if at >= len(data):
                raise ValueError("LZW data are cut off")
            chunk = data[at : at + 8]
            acc, bits, at = (acc & (1 << bits) - 1) << 8 * len(chunk) | int.from_bytes(chunk, "big"), bits + 8 * len(chunk), at + 8
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            del table[LZW_FIRST:]
            width, prev = 9, None
            continue
        if prev is None:
            if code >= len(table):
                raise ValueError("LZW code out of order")
            piece = table[code]
        else:
            if code < len(table):
                piece = table[code]
            elif code == len(table):
                piece = prev + prev[:1]
            else:
                raise ValueError("LZW code out of order")
            table.append(prev + piece[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(piece)
        got += len(piece)
        prev = piece
    if got < size:
        raise ValueError("LZW data are cut off")
    return b"".join(out)[:size]


def inflate(data: bytes, size: int) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, size)
    except zlib.error as e:
        raise ValueError(f"deflate data: {e}") from e
    if len(out) < size:
        raise ValueError("deflate data are cut off")
    return out


def compress(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 3)}[compression](data)


def decompress(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        if len(data) < size:
            raise ValueError("data are cut off")
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return inflate(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {compression} is not read")


def difference(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def encode_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int | None = None, strip_rows: int = 256, order: str = "<") -> bytes:
    """A file with a page for each array (height, width, samples) of bytes, in tiles of tile x tile or in strips."""
    out = [b"II*\0" if order == "<" else b"MM\0*", b""]
    at, links = 8, []
    for page in pages:
        h, w, n = page.shape
        if tile:
            blocks = []
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    b = np.zeros((tile, tile, n), np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    b[: part.shape[0], : part.shape[1]] = part
                    blocks.append(b)
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, h, strip_rows)]
        stored = [compress((difference(b) if predictor == 2 else b).tobytes(), compression) for b in blocks]
        offsets = []
        for s in stored:
            offsets.append(at)
            out.append(s + b"\0" * (len(s) % 2))
            at += len(out[-1])
        counts = [len(s) for s in stored]
        tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * n), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1 if n < 3 else 2]), SAMPLES: (3, [n]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, counts)} if tile else {ROWS_PER_STRIP: (4, [strip_rows]), STRIP_OFFSETS: (4, offsets), STRIP_BYTES: (4, counts)}
        entries, extra, base = [], b"", at + 2 + 12 * len(tags) + 4
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                entries.append(struct.pack(f"{order}HHII", tag, kind, len(values), base + len(extra)))
                extra += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        links.append((len(out), at))
        out.append(struct.pack(f"{order}H", len(entries)) + b"".join(entries))
        out += [b"", extra]
        at = base + len(extra)
    following = [a for _, a in links] + [0]
    out[1] = struct.pack(f"{order}I", following[0])
    for (k, _), nxt in zip(links, following[1:], strict=True):
        out[k + 1] = struct.pack(f"{order}I", nxt)
    return b"".join(out)


def directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The fields of each image directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        try:
            fields = {}
            for i in range(struct.unpack_from(f"{order}H", data, at)[0]):
                tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
                size = TYPE_SIZE.get(kind, 1) * count
                where = at + 10 + 12 * i
                if size > 4:
                    where = struct.unpack_from(f"{order}I", data, where)[0]
                if code := {1: "B", 3: "H", 4: "I"}.get(kind):
                    if where + size > len(data):
                        raise ValueError("a field lies outside the file")
                    fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
            at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * struct.unpack_from(f"{order}H", data, at)[0])[0]
        except struct.error as e:
            raise ValueError("an image directory lies outside the file") from e
        yield fields


def decode_page(data: bytes, number: int, f: dict[int, tuple[int, ...]]) -> Page:
    """The page of a directory. Read are samples of 8 bits that stand together, without a predictor or with predictor 2."""
    one = lambda tag, default=None: (f.get(tag) or (default,))[0]
    w, h, n = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if not w or not h or not n or set(f.get(BITS, (1,))) != {8} or one(PLANES, 1) != 1 or predictor not in (1, 2):
        raise ValueError(f"page {number}: no size, or samples that are not read")
    tiled = TILE_OFFSETS in f
    th, tw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
    offsets, counts = (f.get(TILE_OFFSETS), f.get(TILE_BYTES)) if tiled else (f.get(STRIP_OFFSETS), f.get(STRIP_BYTES))
    if not th or not tw:
        raise ValueError(f"page {number}: blocks without a size")
    across, down = -(-w // tw), -(-h // th)
    if not offsets or not counts or len(offsets) != across * down or len(counts) != len(offsets):
        raise ValueError(f"page {number}: its blocks do not cover it")
    if across * tw * (down * th if tiled else h) * n > MOST_EXPANSION * sum(counts):
        raise ValueError(f"page {number}: it is larger than its data can be")
    image = np.zeros((down * th if tiled else h, across * tw, n), np.uint8)
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - y)
        if at + size > len(data):
            raise ValueError(f"page {number}: a block lies outside the file")
        block = np.frombuffer(decompress(data[at : at + size], compression, rows * tw * n), np.uint8).reshape(rows, tw, n)
        image[y : y + rows, x : x + tw] = np.cumsum(block, axis=1, dtype=np.uint8) if predictor == 2 else block
    return Page(number, w, h, n, compression, predictor, tiled, image[:h, :w].tobytes())


def decode_pages(data: bytes) -> Iterator[Page]:
    for number, f in enumerate(directories(data)):
        yield decode_page(data, number, f)


def read_pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row per page of the TIFF files in a binary column: key, page, width, height, samples, compression, data, error. A
    page that is not read has its number and an error, and the next ones follow; a file whose directories can not be
    followed further ends with an error without a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(column(batch, content).to_pylist()):
                rows, error = [], "empty" if not raw else None
                try:
                    for number, f in enumerate(directories(raw)) if raw else []:
                        try:
                            p = decode_page(raw, number, f)
                            rows.append((p.number, p.width, p.height, p.samples, p.compression, p.data, None))
                        except ValueError as e:
                            rows.append((number, None, None, None, None, None, str(e)))
                except ValueError as e:
                    error = str(e)
                if error:
                    rows.append((None, None, None, None, None, None, error))
                if not rows:
                    rows.append((None, None, None, None, None, None, "no pages"))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                key_array = column(batch, key).take(pa.array([i] * len(rows)))
                yield pa.record_batch([key_array, *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[key, "page", "width", "height", "samples", "compression", "data", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"{key} {kind}, page int, width int, height int, samples int, compression int, data binary, error string")


# ---- documents as images -------------------------------------------------------------------------------------------

UNIT = 64
PAGE_ROWS = 1024


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def store_payload(payload: bytes) -> bytes:
    """The payload as pages 64 samples wide. Its checksum chooses the compression (PackBits, LZW, or deflate with and
    without the predictor) and strips or tiles, so equal payloads are stored alike and all kinds occur."""
    kind = zlib.crc32(payload) & 7
    compression, predictor = ((PACKBITS, 1), (LZW, 1), (DEFLATE, 2), (DEFLATE, 1))[kind & 3]
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT, 1)
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    return encode_pages(pages, compression, predictor, tile=64 if kind & 4 else None)


def load_payload(media: bytes) -> tuple[bytes, list[Page]]:
    pages = list(decode_pages(media))
    return b"".join(p.data for p in pages), pages


def feature(payload: bytes, pages: list[Page]) -> str:
    """Pages and size, mean and deviation of the samples, and their mean by 8 bands of columns, in hundredths."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, 8, UNIT // 8)
    counts = np.bincount(a.ravel(), minlength=256)
    total, values = int(a.size), np.arange(256)
    first, second = int((counts * values).sum()), int((counts * values * values).sum())
    bands = a.sum(axis=(0, 2), dtype=np.int64) * 100 // (a.shape[0] * a.shape[2])
    spread = (second * total - first * first) * 100 // (total * total)
    return f"{len(pages)}x{UNIT}x{total // UNIT};{first * 100 // total};{spread};" + ",".join(map(str, bands.tolist()))


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the TIFF file that holds the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                raw = binary(column(part, "text")).cast(pa.large_binary()).to_pylist()
                yield pa.record_batch({"doc_id": column(part, "doc_id"), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "media": pa.array([store_payload(padded(r)) for r in raw], pa.binary())})

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_digests(stored: DataFrame) -> DataFrame:
    """What the stored files hold, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = column(batch, "media").to_pylist()
            rows = [(*load_payload(m), m) for m in media]
            yield pa.record_batch(
                {
                    "doc_id": column(batch, "doc_id"),
                    "n_bytes": column(batch, "n_bytes"),
                    "payload_bytes": pa.array([len(p) for p, _, _ in rows], pa.int64()),
                    "payload_sha256": [hashlib.sha256(p).hexdigest() for p, _, _ in rows],
                    "tail_crc32": pa.array([zlib.crc32(p[-UNIT:]) for p, _, _ in rows], pa.int64()),
                    "media_bytes": pa.array([len(m) for _, _, m in rows], pa.int64()),
                    "media_sha256": [hashlib.sha256(m).hexdigest() for _, _, m in rows],
                    "feature": [feature(p, pages) for p, pages, _ in rows],
                }
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
