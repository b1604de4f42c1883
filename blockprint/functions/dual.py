"""Dual digests: the normal form with run lengths from which the raw form comes back.

A dual is STRUCT<norm, rle1 BINARY, rle2 BINARY>. A run of more than three characters is cut to three; what was cut is
bytes of a position (6 bits: the last character kept) and a number less one (2 bits), as many fours as fit and one rest.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from blockprint.constants import FULL_SIZE, HALF_SIZE, MAX_RUN
from blockprint.functions import hashes
from blockprint.functions.blocksize import col
from blockprint.functions.hashes import HASH

DUAL = f"struct<norm:{HASH},rle1:binary,rle2:binary>"
RUN = re.compile(r"(.)\1*", re.S)
MOST = 4


def encode_byte(position: int, number: int) -> int:
    return position | (number - 1) << 6


def decode_byte(byte: int) -> tuple[int, int]:
    return byte & 63, (byte >> 6) + 1


def compress_block_hash(raw: str, size: int) -> tuple[str, bytes]:
    out, rle = [], bytearray()
    kept = 0
    for m in RUN.finditer(raw):
        n = len(m[0])
        out.append(m[0][:MAX_RUN])
        kept += min(n, MAX_RUN)
        if extra := max(0, n - MAX_RUN):
            fours, rest = divmod(extra - 1, MOST)
            rle += bytes([encode_byte(kept - 1, MOST)]) * fours + bytes([encode_byte(kept - 1, rest + 1)])
    return "".join(out), bytes(rle).ljust(size // 4, b"\0")


def expand_block_hash(norm: str, rle: bytes) -> str:
    extra: dict[int, int] = {}
    for byte in rle:
        if byte:
            at, n = decode_byte(byte)
            extra[at] = extra.get(at, 0) + n
    return "".join(c * (1 + extra.get(i, 0)) for i, c in enumerate(norm))


def valid_rle(norm: str, rle: bytes, size: int) -> bool:
    """Positions ascend and stand at ends of runs of three, only fours are continued, nothing follows a zero, and the
    raw form fits."""
    used = rle.rstrip(b"\0")
    if 0 in used or len(rle) != size // 4:
        return False
    steps = [decode_byte(b) for b in used]
    previous = (0, 0)
    for at, n in steps:
        if at < MAX_RUN - 1 or at >= len(norm) or at < previous[0]:
            return False
        if at == previous[0]:
            if previous[1] != MOST:
                return False
        elif len(set(norm[at - MAX_RUN + 1 : at + 1])) > 1:
            return False
        previous = (at, n)
    return len(norm) + sum(n for _, n in steps) <= size


@functools.cache
def _compress(long: bool):
    @F.arrow_udf("struct<bh1:string,rle1:binary,bh2:string,rle2:binary>")
    def ctph_dual(bh1: pa.Array, bh2: pa.Array) -> pa.Array:
        one = [compress_block_hash(x or "", FULL_SIZE) for x in bh1.to_pylist()]
        two = [compress_block_hash(x or "", FULL_SIZE if long else HALF_SIZE) for x in bh2.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in xs], t) for xs in (one, two) for k, t in ((0, pa.string()), (1, pa.binary()))], names=["bh1", "rle1", "bh2", "rle2"])

    return ctph_dual


def compress(raw: Column | str, long: bool = False) -> Column:
    """The dual of a raw digest."""
    h = col(raw)
    c = _compress(long)(h["bh1"], h["bh2"])
    norm = F.struct(h["log_block_size"].alias("log_block_size"), c["bh1"].alias("bh1"), c["bh2"].alias("bh2"))
    return F.when(h.isNotNull(), F.struct(norm.alias("norm"), c["rle1"].alias("rle1"), c["rle2"].alias("rle2")))


@functools.cache
def _expand():
    @F.arrow_udf("string")
    def ctph_expand(norm: pa.Array, rle: pa.Array) -> pa.Array:
        return pa.array([None if n is None else expand_block_hash(n, r or b"") for n, r in zip(norm.to_pylist(), rle.to_pylist(), strict=True)], pa.string())

    return ctph_expand


def expand(dual: Column | str) -> Column:
    """The raw digest of a dual."""
    d = col(dual)
    return F.when(d.isNotNull(), F.struct(d["norm"]["log_block_size"].alias("log_block_size"), _expand()(d["norm"]["bh1"], d["rle1"]).alias("bh1"), _expand()(d["norm"]["bh2"], d["rle2"]).alias("bh2")))


def from_normalized(norm: Column | str, long: bool = False) -> Column:
    zeros = lambda n: F.lit(bytes(n // 4))
    return F.struct(col(norm).alias("norm"), zeros(FULL_SIZE).alias("rle1"), zeros(FULL_SIZE if long else HALF_SIZE).alias("rle2"))


def normalize(dual: Column | str, long: bool = False) -> Column:
    """The dual without its run lengths."""
    return from_normalized(col(dual)["norm"], long)


def is_normalized(dual: Column | str) -> Column:
    """Whether there are no run lengths."""
    empty = lambda rle: F.hex(rle).rlike("^0*$")
    return empty(col(dual)["rle1"]) & empty(col(dual)["rle2"])


@functools.cache
def _valid(long: bool):
    @F.arrow_udf("boolean")
    def ctph_dual_valid(a: pa.Array, r1: pa.Array, b: pa.Array, r2: pa.Array) -> pa.Array:
        second = FULL_SIZE if long else HALF_SIZE
        return pa.array([None not in x and valid_rle(x[0], x[1], FULL_SIZE) and valid_rle(x[2], x[3], second) for x in zip(a.to_pylist(), r1.to_pylist(), b.to_pylist(), r2.to_pylist(), strict=True)], pa.bool_())

    return ctph_dual_valid


def is_valid(dual: Column | str, long: bool = False) -> Column:
    d = col(dual)
    return hashes.is_valid(d["norm"], long, normalized=True) & _valid(long)(d["norm"]["bh1"], d["rle1"], d["norm"]["bh2"], d["rle2"])


def parse(text: Column | str, long: bool = False, strict: bool = False) -> Column:
    """STRUCT<dual, error> of a digest string."""
    p = hashes.parse(text, long, normalized=False, strict=strict)
    return F.struct(F.when(p["error"].isNull(), compress(p["hash"], long)).alias("dual"), p["error"].alias("error"))


def to_raw_string(dual: Column | str) -> Column:
    return hashes.to_string(expand(dual))


def to_normalized_string(dual: Column | str) -> Column:
    return hashes.to_string(col(dual)["norm"])
