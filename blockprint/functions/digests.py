"""Digests and scores as column functions; the kernels run on Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from blockprint.constants import ALPHABET, FULL_SIZE, GENERATOR_ERRORS, HALF_SIZE, MAX_INPUT_SIZE
from blockprint.functions import hashes, kernels
from blockprint.functions.blocksize import col
from blockprint.functions.hashes import HASH

#: Bytes that one pass of the kernel holds; about 12 arrays of up to 8 bytes each stand beside it.
PASS_BYTES = 1 << 20


def passes(values: list[bytes | None]) -> Iterator[list[bytes]]:
    """The values in runs of some PASS_BYTES; nulls are empty."""
    some, size = [], 0
    for v in values:
        some.append(v or b"")
        size += len(some[-1])
        if size > PASS_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def digest_array(values: pa.Array, truncate: bool) -> pa.Array:
    raw = values.to_pylist()
    out = [d for some in passes(raw) for d in kernels.digests(some, truncate)]
    mask = pa.array([v is None for v in raw], pa.bool_())
    log = pa.array([d[0] for d in out], pa.int32())
    bh1, bh2 = (pa.array([d[k].decode() for d in out], pa.string()) for k in (1, 2))
    return pa.StructArray.from_arrays([log, bh1, bh2], names=["log_block_size", "bh1", "bh2"], mask=mask)


@functools.cache
def _digest(truncate: bool):
    @F.arrow_udf(HASH)
    def ctph_digest(v: pa.Array) -> pa.Array:
        return digest_array(v, truncate)

    return ctph_digest


def digest(data: Column | str, long: bool = False) -> Column:
    """The raw digest of a text (its UTF-8 bytes) or binary column; null for null. long: bh2 is not truncated."""
    return _digest(not long)(col(data).cast("binary"))


@functools.cache
def _piece_counts():
    @F.arrow_udf("array<long>")
    def ctph_piece_counts(v: pa.Array) -> pa.Array:
        counts = [kernels.piece_counts(some) for some in passes(v.to_pylist())]
        return pa.array([row[row > 0] for some in counts for row in some], pa.list_(pa.int64()))

    return ctph_piece_counts


def piece_counts(data: Column | str) -> Column:
    """How many pieces a text or binary has at each level, from level 0 to the last one that ends any."""
    return _piece_counts()(col(data).cast("binary"))


def digest_checked(data: Column | str, expected_size: Column | str | None = None, truncate: bool = True, long: bool = False) -> Column:
    """STRUCT<hash, error>: digest() with the generator's errors.

    expected_size is a size set beforehand: FixedSizeTooLarge, FixedSizeMismatch. truncate = False into a short digest
    gives OutputOverflow where bh2 does not fit.
    """
    d, size = col(data).cast("binary"), F.octet_length(col(data).cast("binary")).cast("long")
    h = _digest(truncate)(d)
    error = F.when(size > MAX_INPUT_SIZE, "InputSizeTooLarge")
    if expected_size is not None:
        told = col(expected_size).cast("long")
        error = F.when(told > MAX_INPUT_SIZE, "FixedSizeTooLarge").when(told != size, "FixedSizeMismatch").otherwise(error)
    if not truncate and not long:
        error = F.coalesce(error, F.when(F.length(h["bh2"]) > HALF_SIZE, "OutputOverflow"))
    return F.when(d.isNotNull(), F.struct(F.when(error.isNull(), h).alias("hash"), error.alias("error")))


def generator_error_message(error: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for pair in GENERATOR_ERRORS.items() for x in pair])[col(error)]


def is_size_too_large_error(error: Column | str) -> Column:
    return col(error).isin("FixedSizeTooLarge", "InputSizeTooLarge")


# ---- comparison ----------------------------------------------------------------------------------------------------


@functools.cache
def _scores():
    @F.arrow_udf("int")
    def ctph_scores(la: pa.Array, a1: pa.Array, a2: pa.Array, lb: pa.Array, b1: pa.Array, b2: pa.Array) -> pa.Array:
        some = la.is_valid().to_numpy(zero_copy_only=False) & lb.is_valid().to_numpy(zero_copy_only=False)
        n = [x.fill_null(0).to_numpy().astype(np.int64) for x in (la, lb)]
        out = np.zeros(len(la), np.int64)
        lists = [x.to_pylist() for x in (a1, a2, b1, b2)]
        for i in range(0, len(out), 4096):
            p = slice(i, i + 4096)
            out[p] = kernels.scores(n[0][p], lists[0][p], lists[1][p], n[1][p], lists[2][p], lists[3][p])
        return pa.array(out, pa.int32(), mask=~some)

    return ctph_scores


def score(a: Column | str, b: Column | str, normalized: bool = False) -> Column:
    """0 to 100 for two digests; they are normalized first unless they are said to be."""
    a, b = (col(x) if normalized else hashes.normalize(x) for x in (a, b))
    return _scores()(a["log_block_size"], a["bh1"], a["bh2"], b["log_block_size"], b["bh1"], b["bh2"])


@functools.cache
def _string_scores(capped: bool):
    @F.arrow_udf("int")
    def ctph_string_scores(a: pa.Array, b: pa.Array, log: pa.Array) -> pa.Array:
        n = log.fill_null(0).to_numpy().astype(np.int64)
        return pa.array(kernels.string_scores(a.to_pylist(), b.to_pylist(), n if capped else None), pa.int32())

    return ctph_string_scores


def string_score(a: Column | str, b: Column | str, effective_log: Column | str | int | None = None) -> Column:
    """The score of two block hashes; capped if an effective log block size (0 to 31) is given."""
    log = F.lit(effective_log or 0) if not isinstance(effective_log, (Column, str)) else col(effective_log)
    return _string_scores(effective_log is not None)(col(a), col(b), log.cast("int"))


@functools.cache
def _distances():
    @F.arrow_udf("int")
    def ctph_distances(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(kernels.common_and_distance(kernels.padded_codes(a.to_pylist()), kernels.padded_codes(b.to_pylist()))[1], pa.int32())

    return ctph_distances


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Insertions and deletions that turn one block hash into the other."""
    return _distances()(col(a), col(b))


def edit_distance_native(a: Column | str, b: Column | str) -> Column:
    """edit_distance() as a plain expression: the bit-parallel recurrence v = (v + p) | (v - p), p = v & mask, a step a
    character of b. Sums are made of halves, as those of longs may not overflow."""
    low = F.lit((1 << 32) - 1)
    shift = lambda name, x, n: F.call_function(name, x, F.lit(n))

    def step(v: Column, mask: Column) -> Column:
        p = v.bitwiseAND(mask)
        right = v.bitwiseAND(low) + p.bitwiseAND(low)
        left = shift("shiftrightunsigned", v, 32) + shift("shiftrightunsigned", p, 32) + shift("shiftright", right, 32)
        return shift("shiftleft", left, 32).bitwiseOR(right.bitwiseAND(low)).bitwiseOR(v.bitwiseAND(F.bitwise_not(mask)))

    a, b = (F.substring(col(x), 1, FULL_SIZE) for x in (a, b))
    within = F.filter(hashes.codes(b), lambda c: c < FULL_SIZE)
    last = _once(position_array(a), lambda bits: F.aggregate(F.transform(within, lambda c: F.element_at(bits, c + 1)), F.lit(-1).cast("long"), step))
    # Bits beyond a's length stay 1: those that are 0 are the longest common subsequence.
    return (F.length(a) + F.length(b) - 2 * (FULL_SIZE - F.bit_count(last))).cast("int")


def _once(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it; inside a loop it would be computed in every step."""
    return F.transform(F.array(value), f)[0]


def has_common_substring(a: Column | str, b: Column | str) -> Column:
    """Whether two block hashes share seven characters in a row."""
    return F.arrays_overlap(hashes.windows(a), hashes.windows(b))


def raw_score_by_distance(la: Column | str, lb: Column | str, distance: Column | str) -> Column:
    scaled = F.floor(col(distance) * FULL_SIZE / (col(la) + col(lb)))
    return (100 - F.floor(100 * scaled / FULL_SIZE)).cast("int")


def score_cap(effective_log: Column | str, la: Column | str, lb: Column | str) -> Column:
    n = col(effective_log)
    return F.when(n >= 4, 100).otherwise(F.call_function("shiftleft", F.lit(1), F.least(n, F.lit(4)).cast("int")) * F.least(col(la), col(lb))).cast("int")


def is_candidate(a: Column | str, b: Column | str) -> Column:
    """Whether two normal digests have near block sizes and share seven characters in the block hashes that are compared.
    If so they score above 0; if not, only equal ones do."""
    a, b = col(a), col(b)
    d = a["log_block_size"] - b["log_block_size"]
    common = has_common_substring
    return (
        F.when(d == 0, common(a["bh1"], b["bh1"]) | common(a["bh2"], b["bh2"]))
        .when(d == -1, common(a["bh2"], b["bh1"]))
        .when(d == 1, common(a["bh1"], b["bh2"]))
        .otherwise(F.lit(False))
    )


def position_array(bh: Column | str) -> Column:
    """For each of the 64 characters its places in a block hash, as the bits of a long.

    The places whose code has bit k are one number, read from the block hash with its characters replaced by 0 and 1. Six
    steps then part the places of all characters by their codes' bits, the highest first."""
    places = F.reverse(F.regexp_replace(F.substring(F.coalesce(col(bh), F.lit("")), 1, FULL_SIZE), "[^A-Za-z0-9+/]", "-"))
    digits = lambda f: "".join("01"[f(c)] for c in range(FULL_SIZE)) + "0"
    number = lambda f: F.conv(F.concat(F.lit("0"), F.translate(places, ALPHABET + "-", digits(f))), 2, -10).cast("long")
    planes = [number(lambda c, k=k: c >> k & 1).alias(f"p{k}") for k in range(6)]

    def part(bits: Column, q: Column) -> Column:
        return F.flatten(F.transform(bits, lambda x: F.array(x.bitwiseAND(F.bitwise_not(q)), x.bitwiseAND(q))))

    return _once(F.struct(number(lambda c: 1).alias("all"), *planes), lambda p: functools.reduce(part, [p[f"p{k}"] for k in range(5, -1, -1)], F.array(p["all"])))


def compare(a: Column | str, b: Column | str, strict: bool = False) -> Column:
    """STRUCT<score, side, error> of two digest strings, parsed as long normal ones; an error is the left one first."""
    p, q = (hashes.parse(x, long=True, normalized=True, strict=strict) for x in (a, b))
    side = F.when(p["error"].isNotNull(), "Left").when(q["error"].isNotNull(), "Right")
    return F.struct(F.when(side.isNull(), score(p["hash"], q["hash"], normalized=True)).alias("score"), side.alias("side"), F.coalesce(p["error"], q["error"]).alias("error"))
