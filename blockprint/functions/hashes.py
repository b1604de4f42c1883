"""Digests as values: parsing, formatting, normal form, validity, order, conversions and index windows.

A digest is STRUCT<log_block_size INT, bh1 STRING, bh2 STRING>. Everything is a column expression; nothing raises. Raw and
normal, short and long forms have one type: they are told apart by what they hold (runs, a bh2 of more than 32).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprint.constants import ALPHABET, FULL_SIZE, HALF_SIZE, MAX_LEN_LONG, MAX_LEN_SHORT, ORDERED, PARSE_ERRORS, PARSE_ORIGINS, WINDOW
from blockprint.functions import blocksize
from blockprint.functions.blocksize import col

HASH = "struct<log_block_size:int,bh1:string,bh2:string>"


def digest(log: Column | str | int, bh1: Column | str, bh2: Column | str) -> Column:
    """A digest from its parts; null where a part is not valid."""
    n = F.lit(log) if isinstance(log, int) else col(log)
    h = F.struct(n.cast("int").alias("log_block_size"), col(bh1).alias("bh1"), col(bh2).alias("bh2"))
    return F.when(blocksize.is_log_valid(n) & _is_block_hash(col(bh1), FULL_SIZE) & _is_block_hash(col(bh2), FULL_SIZE), h)


def from_block_size(size: Column | str, bh1: Column | str, bh2: Column | str) -> Column:
    return digest(blocksize.log_of(size), bh1, bh2)


def empty() -> Column:
    """The digest of no bytes, 3::"""
    return F.struct(F.lit(0).alias("log_block_size"), F.lit("").alias("bh1"), F.lit("").alias("bh2"))


def _is_block_hash(bh: Column, most: int) -> Column:
    return bh.rlike(rf"^[A-Za-z0-9+/]{{0,{most}}}\z")


# ---- normal form ---------------------------------------------------------------------------------------------------


def normalize_block_hash(bh: Column | str) -> Column:
    """Runs of one character cut to three."""
    return F.regexp_replace(col(bh), r"(.)\1{3,}", "$1$1$1")


def normalize(h: Column | str) -> Column:
    h = col(h)
    return F.when(h.isNotNull(), F.struct(h["log_block_size"].alias("log_block_size"), normalize_block_hash(h["bh1"]).alias("bh1"), normalize_block_hash(h["bh2"]).alias("bh2")))


def is_normalized(h: Column | str) -> Column:
    h = col(h)
    return ~h["bh1"].rlike(r"(.)\1{3}") & ~h["bh2"].rlike(r"(.)\1{3}")


def is_valid(h: Column | str, long: bool = False, normalized: bool = False) -> Column:
    h = col(h)
    ok = blocksize.is_log_valid(h["log_block_size"]) & _is_block_hash(h["bh1"], FULL_SIZE) & _is_block_hash(h["bh2"], FULL_SIZE if long else HALF_SIZE)
    return F.coalesce(ok & is_normalized(h) if normalized else ok, F.lit(False))


# ---- accessors and conversions -------------------------------------------------------------------------------------


def block_size(h: Column | str) -> Column:
    return blocksize.from_log(col(h)["log_block_size"])


def to_string(h: Column | str) -> Column:
    h = col(h)
    return F.when(h.isNotNull(), F.concat_ws(":", block_size(h), h["bh1"], h["bh2"]))


def debug(h: Column | str) -> Column:
    """All fields as JSON; not a promised format."""
    return F.to_json(col(h))


def length_as_string(h: Column | str) -> Column:
    return F.length(to_string(h))


def most_length(long: bool) -> int:
    return MAX_LEN_LONG if long else MAX_LEN_SHORT


def to_short(h: Column | str) -> Column:
    """STRUCT<hash, error>: a long digest as a short one, or BlockHashOverflow."""
    h = col(h)
    fits = F.length(h["bh2"]) <= HALF_SIZE
    return F.struct(F.when(fits, h).alias("hash"), F.when(~fits, "BlockHashOverflow").alias("error"))


def codes(bh: Column | str) -> Column:
    """A block hash as an array of numbers from 0 to 63."""
    return F.transform(F.filter(F.split(col(bh), ""), lambda c: c != ""), lambda c: base64_index(c))


def base64_index(ch: Column | str) -> Column:
    """0 to 63, or 64 for a character outside the alphabet."""
    at = F.instr(F.lit(ALPHABET), col(ch))
    return F.when((at > 0) & (F.length(col(ch)) == 1), at - 1).otherwise(64).cast("int")


def compare_block_sizes(a: Column | str, b: Column | str) -> Column:
    return blocksize.relation(col(a)["log_block_size"], col(b)["log_block_size"])


def sort_key(h: Column | str) -> Column:
    """A struct that orders digests: block size, then each block hash by the places of its characters, then length."""
    h = col(h)
    key = lambda bh: F.struct(F.rpad(F.translate(bh, ALPHABET, ORDERED), FULL_SIZE, ORDERED[0]), F.length(bh))
    return F.struct(h["log_block_size"], key(h["bh1"]), key(h["bh2"]))


# ---- parsing -------------------------------------------------------------------------------------------------------


def _error(kind: str, origin: str, offset: Column | int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), (F.lit(offset) if isinstance(offset, int) else offset).cast("int").alias("offset"))


def _block_hash(rest: Column, base: Column, origin: str, most: int, normalized: bool, strict: bool, end: str) -> tuple[Column, Column, Column]:
    """Of the text after a separator: the stored block hash, its raw length, and the first error (null: none)."""
    shape = normalize_block_hash if normalized else lambda x: x
    run = F.regexp_extract(rest, r"^[A-Za-z0-9+/]*", 0)
    after = F.substring(rest, F.length(run) + 1, F.lit(1))
    stored = shape(run)
    # The place of the first character that is stored beyond the room.
    beyond = F.filter(F.sequence(F.lit(most + 1), F.greatest(F.length(run), F.lit(most + 1))), lambda i: F.length(shape(F.substring(run, F.lit(1), i))) > most)[0] - 1
    too_long = F.length(stored) > most
    if strict:
        next_ = F.substring(rest, F.lit(most + 1), F.lit(1))
        too_long = (F.length(run) >= most) & ~next_.isin("", ":", ",")
        beyond = F.lit(most)
    unexpected = _error("UnexpectedCharacter", origin, base + F.length(run))
    error = F.when(too_long, _error("BlockHashIsTooLong", origin, base + beyond))
    if end == ":":
        error = error.when(after == "", _error("UnexpectedEndOfString", origin, base + F.length(run))).when(after != ":", unexpected)
    else:
        error = error.when(~after.isin("", ","), unexpected)
    return stored, F.length(run), error


def parse(text: Column | str, long: bool = False, normalized: bool = True, strict: bool = False) -> Column:
    """STRUCT<hash, last_index, file_name, error STRUCT<kind, origin, offset>> of "size:bh1:bh2" or "size:bh1:bh2,name".

    last_index is where the digest ends (the comma or the end). normalized cuts runs before lengths are checked; strict
    checks the raw lengths. A null text gives null.
    """
    t = col(text)
    digits = F.regexp_extract(t, r"^[0-9]*", 0)
    n = F.length(digits)
    after = F.substring(t, n + 1, F.lit(1))
    large = (n > 10) | (digits.try_cast("long") > (1 << 32) - 1)
    size = F.when(~large, digits.try_cast("long"))
    error = (
        F.when(digits.startswith("0"), _error("BlockSizeStartsWithZero", "BlockSize", 0))
        .when(after == "", _error("UnexpectedEndOfString", "BlockSize", n))
        .when(after != ":", _error("UnexpectedCharacter", "BlockSize", n))
        .when(n == 0, _error("BlockSizeIsEmpty", "BlockSize", 0))
        .when(large, _error("BlockSizeIsTooLarge", "BlockSize", 0))
        .when(~blocksize.is_valid(size), _error("BlockSizeIsInvalid", "BlockSize", 0))
    )
    base1 = n + 1
    rest1 = F.substring(t, base1 + 1, F.length(t))
    bh1, raw1, error1 = _block_hash(rest1, base1, "BlockHash1", FULL_SIZE, normalized, strict, ":")
    base2 = base1 + raw1 + 1
    rest2 = F.substring(t, base2 + 1, F.length(t))
    bh2, raw2, error2 = _block_hash(rest2, base2, "BlockHash2", FULL_SIZE if long else HALF_SIZE, normalized, strict, "")
    error = F.coalesce(error, error1, error2)
    h = F.struct(blocksize.log_of(size).alias("log_block_size"), bh1.alias("bh1"), bh2.alias("bh2"))
    ok = error.isNull()
    last = base2 + raw2
    name = F.when(F.substring(t, last + 1, F.lit(1)) == ",", F.regexp_replace(F.substring(t, last + 2, F.length(t)), '^"(.*)"$', "$1"))
    return F.when(t.isNotNull(), F.struct(F.when(ok, h).alias("hash"), F.when(ok, last).cast("int").alias("last_index"), F.when(ok, name).alias("file_name"), error.alias("error")))


def with_parsed(df: DataFrame, text: str, name: str = "parsed", long: bool = False, normalized: bool = True, strict: bool = False) -> DataFrame:
    """df with parse() of a column. The generator keeps Spark from merging later projections into it, which would parse
    once more for each field that is used."""
    return df.select("*", F.explode(F.array(parse(text, long, normalized, strict))).alias(name))


def error_message(error: Column | str) -> Column:
    e = col(error)
    told = lambda key, names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]
    return F.when(e.isNotNull(), F.format_string("error occurred while parsing a fuzzy hash (%s, at byte offset %d): %s", told(e["origin"], PARSE_ORIGINS), e["offset"], told(e["kind"], PARSE_ERRORS)))


# ---- windows -------------------------------------------------------------------------------------------------------


def windows(bh: Column | str) -> Column:
    """All substrings of seven characters of a (normal) block hash."""
    b = col(bh)
    return F.when(F.length(b) >= WINDOW, F.transform(F.sequence(F.lit(1), F.length(b) - (WINDOW - 1)), lambda i: F.substring(b, i, F.lit(WINDOW)))).otherwise(F.array().cast("array<string>"))


def _packed(lead: Column, bh: Column) -> Column:
    # Eight characters of six bits are 48 bits; the first one is the block size.
    return F.transform(windows(bh), lambda w: F.conv(F.hex(F.unbase64(F.concat(lead, w))), 16, 10).cast("long"))


def numeric_windows(bh: Column | str) -> Column:
    """windows() as numbers of 42 bits."""
    return _packed(F.lit(ALPHABET[0]), col(bh))


def index_windows(bh: Column | str, effective_log: Column | str) -> Column:
    """windows() as numbers of 47 bits that hold the block size (log, or log + 1 for a second block hash) too."""
    n = col(effective_log).cast("int")
    return _packed(F.substring(F.lit(ALPHABET), n + 1, F.lit(1)), col(bh))


def index_keys(h: Column | str) -> Column:
    """The distinct keys of a normal digest: digests can score above 0 without being equal only if they share one."""
    h = col(h)
    return F.array_distinct(F.concat(index_windows(h["bh1"], h["log_block_size"]), index_windows(h["bh2"], h["log_block_size"] + 1)))
