"""Quality rules: counts of words, symbols, repeated lines and windows, and bands of word perplexity by language.

The language model is interpolated modified Kneser-Ney over words, of order ORDER and for each value of `lang`; unknown words
are spelled by a Kneser-Ney model of byte trigrams over the whole corpus (at most 2**24 entries). Orders above 2 know whole passages, so
they measure how often a text was copied rather than how it is written; they are for corpora without copies. The corpus is dealt to two
folds by a hash of id and text, with a model each, and a text is scored by the other fold's, as gibberish would explain
itself otherwise. Nothing is pruned, so the model grows with the input, and it is never collected.

It is counted level by level. A block (BLOCK_BYTES of texts as the scan gives them) sends the sorted hashes of its n-grams
with counts to buckets, which are ranges of hashes; a bucket adds up what blocks have sent and answers each with the sums of
its n-grams, in the order in which it sent them, so answers need no hashes. Of the blocks that have an n-gram one owns it
and counts it as a continuation of its last n - 1 words and a successor of its first n - 1, which is what the next lower
level sums. Answers lie in a file for each partition of the scan, in the shared folder; the text itself is never shuffled.
If partitions are not what they were when their answers were made (Spark may plan a scan anew after it lost executors),
tasks notice by the sums of their hashes, and the job starts again over a copy of the texts that is fixed. Hashes have
MARGIN_BITS more than the logarithm of the corpus' bytes, so some 2**-10 of the n-grams count for another one.

A document's bits a word must lie in its language's band: the quartiles (in steps of 1 / STEPS bit) of all of the language's
documents that pass the counting rules, moved out by BELOW and ABOVE times their distance from the median. Nulls: a null text
has no words and fails; a null lang is a language of its own. Repeated rows are counted and judged each. Empty tables give
empty results.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprint.llm.common import bytes_and_bounds, column, cut, fresh_folder, in_small_batches, pieces
from blockprint.llm.minimisers import BYTE_VALUES, SEPARATOR, Ranges, joined, mixed, ragged_ranges, runs, word_hashes, words_of
from blockprint.llm.records import file_system

ORDER, WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 2, 5, 10, 20
SYMBOLS = "#*$%&|<>"
#: How far a band reaches beyond the lower and the upper quartile, in their distances from the median, and at least (in
#: bits a word). It reaches further down, as near copies of other texts have few bits and are not worse for that.
BELOW, ABOVE, LEAST_REACH, STEPS = 10.0, 6.0, 1.0, 256
#: Bytes of text in a block, and of counted text for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
MARGIN_BITS = 8
BORDER = np.uint64(0x5851F42D4C957F2D)  # the unit before a text's first word and after its last
BORDER_BITS = 8.0
START = 10  # texts begin as if after line feeds
U = np.uint64


# ---- counting rules ------------------------------------------------------------------------------------------------


def repeated_window_words(hashes: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each document, how many of its words lie in windows found twice or more in it. Windows that share a hash are
    compared word by word."""
    owner, place = ragged_ranges(lengths)
    n = len(hashes)
    out = np.zeros(len(lengths), np.int64)
    starts = np.flatnonzero(place + window <= lengths[owner]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return out
    key = owner[starts].astype(np.uint64)
    for k in range(window):
        key = joined(key, hashes[starts + k])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    a, b = starts[order[1:][same]], starts[order[:-1][same]]
    equal = owner[a] == owner[b]
    for k in range(window):
        equal &= hashes[a + k] == hashes[b + k]
    marks = np.zeros(n + 1, np.int64)
    twice = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(marks, twice, 1)
    np.add.at(marks, np.minimum(twice + window, n), -1)
    np.add.at(out, owner[np.cumsum(marks[:-1]) > 0], 1)
    return out


SYMBOL, STARTS_CHARACTER = np.zeros(256, bool), (np.arange(256) & 0xC0) != 0x80
SYMBOL[[ord(c) for c in SYMBOLS]] = True


def repeated_lines(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """For each text, how many of its lines that have a word equal an earlier one. Lines of equal hashes are compared."""
    feeds = np.flatnonzero(data == ord("\n"))
    starts = np.unique(np.concatenate([feeds + 1, bounds[:-1]]))
    starts = starts[starts < len(data)]
    owner = np.searchsorted(bounds, starts, "right") - 1
    ends = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, starts)], bounds[owner + 1])
    out = np.zeros(len(bounds) - 1, np.int64)
    marks = np.append(0, np.cumsum(is_word))
    some = marks[ends] > marks[starts]
    starts, ends, owner = starts[some], ends[some], owner[some]
    key = mixed(Ranges(BYTE_VALUES[data])(starts, ends) ^ mixed(owner.astype(U)))
    order = np.argsort(key)
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    raw = data.tobytes() if len(again) else b""
    for text in np.unique(owner[again]).tolist():
        a, b = np.searchsorted(owner, [text, text + 1])
        lines = [raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        out[text] = len(lines) - len(set(lines))
    return out


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each of the texts that lie in data between the bounds."""
    starts, ends, lengths = words_of(data, bounds)
    is_word = ~SEPARATOR[data]
    of_texts = lambda marks: np.diff(np.append(0, np.cumsum(marks))[bounds])
    return {
        "n_words": lengths,
        "word_chars": of_texts(is_word & STARTS_CHARACTER[data]),
        "n_symbols": of_texts(SYMBOL[data]),
        "n_dup_lines": repeated_lines(data, bounds, is_word),
        "n_repeat_words": repeated_window_words(word_hashes(data, starts, ends), lengths),
    }


# ---- spelling ------------------------------------------------------------------------------------------------------


def trigrams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The code of the last three bytes at every byte; before a text stand START bytes."""
    a = data.astype(np.uint32)
    p, q = np.full(len(a), START, np.uint32), np.full(len(a), START, np.uint32)
    p[1:], q[2:] = a[:-1], a[:-2]
    starts = bounds[:-1][np.diff(bounds) > 0]
    p[starts] = q[starts] = START
    second = starts + 1
    second = second[second < bounds[-1]]
    q[second] = START
    return q << np.uint32(16) | p << np.uint32(8) | a


def spelling_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The byte trigrams of all texts, of which there are 2**24 at most, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                codes = np.sort(trigrams(*bytes_and_bounds(column(part, "text"))))
                first, last = runs(codes)
                grams, at = np.unique(np.concatenate([grams, codes[first]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, last - first]), len(grams)).astype(np.int64)
        yield pa.record_batch({"gram": pa.array(grams.astype(np.int64)), "n": pa.array(n)})

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    return rows.column("gram").to_numpy(), rows.column("n").to_numpy()


def discounts(counted: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's discounts for counts 0, 1, 2 and 3 or more, from how many n-grams have counts 1, 2, 3, 4."""
    n = [float(x) for x in counted]
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return np.array([0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def spelling_bits(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-log2 of the probability of a byte after two others, for each code of three bytes."""

    def smoothed(keys: np.ndarray, counts: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities of contexts x 256 bytes from counts and the shorter contexts' probabilities."""
        d = discounts([(counts == k).sum() for k in (1, 2, 3, 4)])[np.minimum(counts, 3)]
        out = np.zeros((len(below), 256), np.float64)
        out.ravel()[keys] = counts - d
        total, freed = np.bincount(keys >> 8, counts, len(below)), np.bincount(keys >> 8, d, len(below))
        known = total > 0
        left = np.where(known, freed / np.maximum(total, 1), 1.0)
        return out / np.maximum(total, 1)[:, None] + left[:, None] * below

    pairs, pair_counts = np.unique(grams & 0xFFFF, return_counts=True)  # continuation counts
    singles, single_counts = np.unique(pairs & 0xFF, return_counts=True)
    one = smoothed(singles, single_counts, np.full((1, 256), 1 / 256))
    two = smoothed(pairs, pair_counts, np.broadcast_to(one, (256, 256)))
    out = np.empty((256, 256 * 256), np.float32)
    bounds = np.searchsorted(grams >> 16, np.arange(257))
    d = discounts([(n == k).sum() for k in (1, 2, 3, 4)])
    for a in range(256):  # contexts that begin with one byte at a time, as the whole is large
        rows = slice(bounds[a], bounds[a + 1])
        keys, counts = grams[rows] & 0xFFFF, n[rows]
        less = d[np.minimum(counts, 3)]
        total, freed = np.bincount(keys >> 8, counts, 256), np.bincount(keys >> 8, less, 256)
        p = two * np.where(total > 0, freed / np.maximum(total, 1), 1.0)[:, None]
        p.ravel()[keys] += (counts - less) / total[keys >> 8]
        out[a] = -np.log2(np.maximum(p, 1e-30)).ravel()
    return out.ravel()


TABLES: dict[int, np.ndarray] = {}


def spelling_table(shared) -> np.ndarray:
    """spelling_bits() of the broadcast counts, made once in a worker."""
    grams, n = shared.value
    key = hash((grams.tobytes(), n.tobytes()))
    if key not in TABLES:
        TABLES.clear()
        TABLES[key] = spelling_bits(grams, n)
    return TABLES[key]


# ---- the model of words ----------------------------------------------------------------------------------------------


class BlocksMoved(Exception):
    """The rows of a partition are not those that its answers were made for."""


def lang_keys(langs: list[str | None]) -> np.ndarray:
    known = {x: int.from_bytes(blake2b(b"-" if x is None else b"+" + x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], U)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a partition in blocks with their numbers, which do not depend on how rows come in batches."""

    def split() -> Iterator[tuple[int, pa.RecordBatch]]:
        before = 0
        for batch in batches:
            _, bounds = bytes_and_bounds(column(batch, "text"))
            number = (before + bounds[:-1]) // BLOCK_BYTES
            for a, b in zip(*runs(number), strict=True):
                yield int(number[a]), batch.slice(a, b - a)
            before += int(bounds[-1])

    for number, group in groupby(split(), key=lambda x: x[0]):
        yield number, pa.Table.from_batches([part for _, part in group]).combine_chunks().to_batches()[0]


def beyond(counts: np.ndarray) -> np.ndarray:
    return np.maximum(counts - 3, 0)


class Grams:
    """The n-grams of a block's texts. Before each text stand order - 1 borders, one behind it; texts without words have
    none. keys[n][i]: hash of the n words up to place i (n = 0: of the language); reach: places of i in its text."""

    def __init__(self, part: pa.RecordBatch, order: int, bits: int):
        self.order, self.shift = order, U(64 - bits)
        data, bounds = bytes_and_bounds(column(part, "text"))
        self.starts, self.ends, lengths = words_of(data, bounds)
        langs = mixed(lang_keys(column(part, "lang").to_pylist()))
        self.size = np.where(lengths > 0, lengths + order, 0)
        self.owner, self.place = ragged_ranges(self.size)
        self.inner = np.flatnonzero((self.place >= order - 1) & (self.place < self.size[self.owner] - 1))
        units = np.full(len(self.owner), BORDER)
        units[self.inner] = word_hashes(data, self.starts, self.ends)
        self.fold = (column(part, "fold").to_numpy()).astype(np.int64)[self.owner]
        full = [langs[self.owner]]
        full.append(joined(full[0], units))
        for _ in range(order - 1):
            full.append(joined(np.append(full[-1][:1], full[-1][:-1]), units))
        self.keys = [x >> self.shift for x in full]

    def places(self, n: int) -> np.ndarray:
        """Where n-grams end; those of the model's order end at words and at the text's end."""
        return np.flatnonzero(self.place >= max(n - 1, 0))

    def ranked(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted n-grams, and the number of the one at each place among them."""
        at = self.places(n)
        order = np.argsort(self.keys[n][at])
        key = self.keys[n][at[order]]
        first, last = runs(key)
        rank = np.zeros(len(self.owner), np.int32)
        rank[at[order]] = np.repeat(np.arange(len(first), dtype=np.int32), last - first)
        return key[first], rank

    def top(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The n-grams of the highest order and how often each fold has them."""
        at = self.places(self.order)
        both = self.keys[self.order][at] << U(1) | self.fold[at].astype(U)
        both.sort()
        first, last = runs(both)
        key, fold, count = both[first] >> U(1), (both[first] & U(1)).astype(np.int64), last - first
        start, _ = runs(key)
        which = np.cumsum(np.isin(np.arange(len(key)), start)) - 1
        return key[start], [np.bincount(which, count * (fold == f), len(start)).astype(np.int64) for f in (0, 1)]

    def lower(self, n: int, above: Answers) -> tuple[np.ndarray, list[np.ndarray]]:
        """The n-grams, and what the (n + 1)-grams that the block owns add to them, for both folds each: how many have
        them at their end; of those that have them at their start, the sum of what counts have beyond 3, and how many have counts 1, 2, 3 or
        more."""
        key, rank = self.ranked(n + 1)
        sums = above.of(key)
        where = np.empty(len(key), np.int64)
        at = self.places(n + 1)
        where[rank[at]] = at  # any place of each
        mine = np.flatnonzero(sums[-1] > 0)
        where = where[mine]
        keys, rank = self.ranked(n)
        end, begin = rank[where], rank[where - 1 if n else where]
        counts = [sums[f][mine] for f in (0, 1)]
        add = lambda to, what: np.bincount(to, what, len(keys)).astype(np.int64)
        out = [add(end, c > 0) for c in counts] + [add(begin, beyond(c)) for c in counts]
        return keys, out + [add(begin, kind(c)) for kind in (lambda c: c == 1, lambda c: c == 2, lambda c: c > 2) for c in counts]


#: Bits of three columns that share a byte; numbers that do not fit follow in full.
SHARES = (3, 3, 2)


def plane(raw: bytes) -> bytes:
    """Bytes of one kind, compressed by themselves if that makes them fewer: size, stored size, bytes."""
    small = pa.compress(raw, "zstd", asbytes=True) if len(raw) > 32 else raw
    return struct.pack("<II", len(raw), min(len(small), len(raw))) + (small if len(small) < len(raw) else raw)


def planes(data: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        size, stored = struct.unpack_from("<II", data, at)
        raw = data[at + 8 : at + 8 + stored]
        at += 8 + stored
        yield np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True) if stored < size else raw, np.uint8)


def wide(c: np.ndarray) -> list[bytes]:
    """Numbers by bytes: how many bytes they need, and a plane for each."""
    width = max(1, -(-int(c.max()).bit_length() // 8)) if len(c) else 1
    parts = np.ascontiguousarray(c.astype(U).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return [plane(bytes([width])), *(plane(x.tobytes()) for x in parts)]


def narrow(rest: Iterator[np.ndarray]) -> np.ndarray:
    parts = [next(rest) for _ in range(int(next(rest)[0]))]
    out = np.zeros((len(parts[0]), 8), np.uint8)
    for k, x in enumerate(parts):
        out[:, k] = x
    return out.view("<u8").ravel()


def packed(columns: list[np.ndarray], sorted_first: bool) -> bytes:
    """Columns of numbers, most of which are small, compressed; of a sorted first one the differences."""
    out = []
    if sorted_first:
        out += wide(np.diff(columns[0].astype(U), prepend=U(0)))
        columns = columns[1:]
    out.append(plane(bytes([len(columns)])))
    large = []
    for k in range(0, len(columns), 3):
        byte, shift = np.zeros(len(columns[0]), np.uint8), 0
        for c, n_bits in zip(columns[k : k + 3], SHARES):
            most = (1 << n_bits) - 1
            byte |= (np.minimum(c, most) << shift).astype(np.uint8)
            large.append(c[c >= most])
            shift += n_bits
        out.append(plane(byte.tobytes()))
    return b"".join([*out, *wide(np.concatenate(large))])


def unpacked(data: bytes, sorted_first: bool) -> list[np.ndarray]:
    rest = planes(data)
    out = [np.cumsum(narrow(rest), dtype=U)] if sorted_first else []
    n = int(next(rest)[0])
    bytes_ = [next(rest) for _ in range(-(-n // 3))]
    large, used = narrow(rest), 0
    for k, byte in enumerate(bytes_):
        shift = 0
        for n_bits in SHARES[: n - 3 * k]:
            most = (1 << n_bits) - 1
            c = ((byte >> shift) & most).astype(np.int64)
            over = np.flatnonzero(c == most)
            c[over] = large[used : used + len(over)]
            used += len(over)
            out.append(c)
            shift += n_bits
    return out


class Answers:
    """The answers that lie in a partition's file, read block by block."""

    def __init__(self, folder: str, level: int, part: int):
        store, base = file_system(folder)
        path = f"{base}/level-{level}/part-{part}"
        known = store.get_file_info(path).type == pa.fs.FileType.File
        self.rows = iter(pa.ipc.open_stream(store.open_input_stream(path))) if known else iter(())
        self.batch: pa.RecordBatch | None = None
        self.parts: list[tuple[int, bytes]] = []

    def next(self, block: int) -> Answers:
        """Goes on to a block, whose number is greater than the last one's."""
        self.parts = []
        while True:
            if self.batch is None or not self.batch.num_rows:
                self.batch = next(self.rows, None)
                if self.batch is None:
                    return self
            number = column(self.batch, "block").to_numpy()
            end = int(np.searchsorted(number, block, "right"))
            begin = int(np.searchsorted(number, block))
            taken = self.batch.slice(begin, end - begin)
            self.parts += zip(column(taken, "check").to_pylist(), column(taken, "data").to_pylist(), strict=True)
            self.batch = self.batch.slice(end)
            if self.batch.num_rows:
                return self

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        """The sums of a block's n-grams, and whether it owns each."""
        found = [unpacked(data, False) for _, data in self.parts]
        sizes = [len(f[0]) for f in found]
        ends = np.cumsum(sizes, dtype=np.int64)
        if sum(sizes) != len(keys) or any(check != checked(keys[e - s : e]) for (check, _), s, e in zip(self.parts, sizes, ends.tolist(), strict=True)):
            raise BlocksMoved("the rows of a partition are not those that its answers were made for")
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 11


def checked(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(keys)).view(np.int64)) if len(keys) else 0


def stored(rows: DataFrame, folder: str, level: int, n_tasks: int) -> DataFrame:
    """Writes the answers among rows into a file for each part, as a whole or not at all; the other rows are what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(f"{base}/level-{level}", recursive=True)

        def by_part() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                part = column(batch, "to").to_numpy()
                for a, b in zip(*runs(part), strict=True):
                    yield int(part[a]), batch.slice(a, b - a)

        for part, group in groupby(by_part(), key=lambda x: x[0]):
            if part < 0:
                yield from (batch.select(["part", "block", "lang", "sums"]) for _, batch in group)
                continue
            path = f"{base}/level-{level}/part-{part}"
            draft = f"{base}/level-{level}/draft-{part}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                file = None
                for _, batch in group:
                    batch = batch.select(["block", "check", "data"])
                    file = file or pa.ipc.new_stream(out, batch.schema)
                    file.write_batch(batch)
                file.close()
            if store.get_file_info(path).type == pa.fs.FileType.NotFound:
                store.move(draft, path)
            else:  # another attempt was first; it had the same rows
                store.delete_file(draft)

    to = F.when(F.col("data").isNotNull(), F.col("part")).otherwise(-1 - F.pmod(F.col("bucket"), F.lit(n_tasks)))
    spread = rows.withColumn("to", to.cast("int")).repartition(n_tasks, "to").sortWithinPartitions("to", "block", "bucket")
    return spread.mapInArrow(run, "part int, block int, lang long, sums array<long>")


SENT = "bucket int, part int, block int, data binary, langs binary"
ANSWERED = "part int, block int, bucket int, check long, data binary, lang long, sums array<long>"


def answered(sent: DataFrame, n_buckets: int, folds: int = 2) -> DataFrame:
    """What buckets answer: to each block the sums of its n-grams and whether it owns them; and in rows without part the
    numbers of n-grams of counts 1 to 4 by fold and, if blocks tell the languages, the sums over each one's words. The
    languages of each block pass through, in rows without data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                bucket = column(batch, "bucket").to_numpy()
                for a, b in zip(*runs(bucket), strict=True):
                    yield int(bucket[a]), batch.slice(a, b - a)

        for bucket, group in groupby(split(), key=lambda x: x[0]):
            if bucket < 0:  # the languages of blocks
                for _, batch in group:
                    of = [(p, b, k) for p, b, x in zip(*(column(batch, c).to_pylist() for c in ("part", "block", "langs")), strict=True) for k in np.frombuffer(x, np.int64).tolist()]
                    p, b, k = zip(*of, strict=True)
                    yield answers(p, b, [bucket] * len(of), [None] * len(of), [None] * len(of), k, [None] * len(of))
                continue
            part, block, langs, found = [], [], [], []
            for _, batch in group:
                part += column(batch, "part").to_pylist()
                block += column(batch, "block").to_pylist()
                langs += column(batch, "langs").to_pylist()
                found += [unpacked(x, True) for x in column(batch, "data").to_pylist()]
            with_langs = langs[0] is not None
            sizes = [len(f[0]) for f in found]
            keys = np.concatenate([f[0] for f in found])
            order = np.argsort(keys)
            first, last = runs(keys[order])
            columns, totals = [], []
            n_columns = len(found[0]) - 1 - with_langs
            for c in range(n_columns):
                total = np.add.reduceat(np.concatenate([f[1 + c] for f in found])[order], first)
                totals.append(total)
                wide = np.empty(len(keys), np.int64)
                wide[order] = np.repeat(total, last - first)
                columns.append(wide)
            own = np.zeros(len(keys), np.int64)
            own[np.minimum.reduceat(order, first)] = 1  # the first block
            columns.append(own)
            ends = np.cumsum(sizes).tolist()
            parts = [packed([c[e - s : e] for c in columns], False) for s, e in zip(sizes, ends, strict=True)]
            sums = [int((totals[f] == k).sum()) for f in range(folds) for k in (1, 2, 3, 4)]
            n = len(parts)
            yield answers(part, block, [bucket] * n, [checked(keys[e - s : e]) for s, e in zip(sizes, ends, strict=True)], parts, [None] * n, [None] * n)
            rows, kinds = [sums], [None]
            if with_langs:
                of = np.concatenate([np.frombuffer(x, np.int64)[f[-1]] for x, f in zip(langs, found, strict=True)])[order[first]]
                names, at = np.unique(of, return_inverse=True)
                for i, name in enumerate(names.tolist()):
                    here = [t[at == i] for t in totals[:folds]]
                    rows.append([0] * folds + [int(beyond(t).sum()) for t in here] + [int(kind(t).sum()) for kind in (lambda t: t == 1, lambda t: t == 2, lambda t: t > 2) for t in here])
                    kinds.append(name)
            yield answers([None] * len(rows), [None] * len(rows), [bucket] * len(rows), [None] * len(rows), [None] * len(rows), kinds, rows)

    def answers(part, block, bucket, check, data, lang, sums) -> pa.RecordBatch:
        i32, i64 = pa.int32(), pa.int64()
        return pa.record_batch({"part": pa.array(part, i32), "block": pa.array(block, i32), "bucket": pa.array(bucket, i32), "check": pa.array(check, i64), "data": pa.array(data, pa.binary()), "lang": pa.array(lang, i64), "sums": pa.array(sums, pa.list_(i64))})

    spread = sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "part", "block")
    return spread.mapInArrow(run, ANSWERED)


def sender(level: int, order: int, bits: int, n_buckets: int, folder: str):
    """A task that sends the n-grams of its blocks to buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = above = None
        for block, rows in blocks(batches):
            if part is None:
                part = column(rows, "part")[0].as_py()
                above = Answers(folder, level + 1, part) if level < order else None
            grams = Grams(rows, order, bits)
            keys, columns = grams.top() if level == order else grams.lower(level, above.next(block))
            if not len(keys):
                continue
            langs = None
            if level == 1:  # which language each word is of
                at = grams.places(1)
                names, index = np.unique(grams.keys[0][at], return_inverse=True)
                kind = np.zeros(len(keys), np.int64)
                kind[grams.ranked(1)[1][at]] = index
                columns, langs = [*columns, kind], names.view(np.int64).tobytes()
            bucket = bucket_of(keys, bits, n_buckets)
            cuts = list(zip(*runs(bucket), strict=True))
            out = [(int(bucket[a]), packed([keys[a:b], *(c[a:b] for c in columns)], True)) for a, b in cuts]
            if langs is not None:
                out.append((-1 - (part * 31 + block) % n_buckets, None))
            to, data = zip(*out, strict=True)
            n = len(out)
            yield pa.record_batch({"bucket": pa.array(to, pa.int32()), "part": pa.array([part] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "data": pa.array(data, pa.binary()), "langs": pa.array([langs] * n, pa.binary())})

    return run


def bucket_of(keys: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """Buckets are ranges of keys."""
    high = keys >> U(bits - 32) if bits > 32 else keys << U(32 - bits)
    return (high * U(n_buckets) >> U(32)).astype(np.int64)


def word_bits(grams: Grams, spelled: np.ndarray, sums: list[tuple[list[np.ndarray], np.ndarray]], less: np.ndarray) -> np.ndarray:
    """The mean of -log2 of the probabilities of each text's words and of its end, by the model of the other fold; nan
    without words. sums[n]: the n-grams' sums, and the number of the one at each place; less[n][fold]: discounts."""
    at = grams.places(grams.order)
    other = 1 - grams.fold[at]
    new = np.full(len(grams.owner), BORDER_BITS)
    new[grams.inner] = spelled
    p = np.exp2(-np.minimum(new[at], 1000.0))

    def pick(n: int, c: int, where: np.ndarray) -> np.ndarray:
        found, rank = sums[n]
        return np.stack(found[2 * c : 2 * c + 2], axis=1)[rank[where], other]

    for n in range(1, grams.order + 1):
        before = at - 1 if n > 1 else at
        count, total, freed = pick(n, 0, at), pick(n - 1, 1, before), 0.0
        d = less[n - 1][other]
        for k in (1, 2, 3):
            having = pick(n - 1, 1 + k, before)
            total, freed = total + k * having, freed + d[:, k] * having
        known = total > 0
        taken = np.maximum(count - np.take_along_axis(d, np.minimum(count, 3)[:, None], 1)[:, 0], 0)
        p = np.where(known, (taken + freed * p) / np.maximum(total, 1), p)
    n_texts = len(grams.size)
    events = np.bincount(grams.owner[at], minlength=n_texts)
    return np.where(events > 0, np.bincount(grams.owner[at], -np.log2(p), n_texts) / np.maximum(events, 1), np.nan)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scorer(order: int, bits: int, folder: str, spelling, less: np.ndarray):
    """A task that counts and scores the texts of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, table = [], None
        for block, rows in blocks(batches):
            if table is None:
                table = spelling_table(spelling)
                part = column(rows, "part")[0].as_py()
                answers = [Answers(folder, n, part) for n in range(order + 1)]
            for a in answers:
                a.next(block)
            grams, sums = Grams(rows, order, bits), []
            for n, a in enumerate(answers):
                keys, rank = grams.ranked(n)
                sums.append((a.of(keys), rank))
            grams.keys.clear()
            bits_of_bytes = []
            for piece in pieces(rows, "text"):  # the spelling needs several numbers for each byte
                data, bounds = bytes_and_bounds(column(piece, "text"))
                starts, ends, lengths = words_of(data, bounds)
                if len(starts):
                    with_end = np.minimum(ends + 1, np.repeat(bounds[1:], lengths))  # with the byte that ends the word
                    cuts = np.stack([starts, with_end], axis=1).ravel()
                    bits_of_bytes.append(np.add.reduceat(np.append(table[trigrams(data, bounds)], np.float32(0)).astype(np.float64), cuts)[::2])
            bits_a_word = word_bits(grams, np.concatenate(bits_of_bytes) if bits_of_bytes else np.zeros(0), sums, less)
            del grams, sums
            counts = [base_counts(*bytes_and_bounds(column(piece, "text"))) for piece in pieces(rows, "text")]
            counts = {k: np.concatenate([c[k] for c in counts]) for k in BASE}
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])
            yield pa.record_batch({"doc_id": column(rows, "doc_id"), "lang": column(rows, "lang"), **{k: pa.array(counts[k], pa.int64()) for k in BASE}, "base_failed": failed, "bits": pa.array(bits_a_word, from_pandas=True)})

    return run


def measured(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, the counts, base_failed and bits: the mean of -log2 of a word's probability (log2 of perplexity)."""
    docs = docs.select("doc_id", "lang", "text")
    try:
        return measured_in_place(docs, order)
    except Exception as e:
        if BlocksMoved.__name__ not in str(e):
            raise
        return measured_in_place(cut(docs), order)  # a copy whose partitions are files


def measured_in_place(docs: DataFrame, order: int) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, n_buckets = min(63, max(16, int(size).bit_length() + MARGIN_BITS)), max(8, -(-size // BUCKET_BYTES))
    fold = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")
    rows = in_small_batches(docs.select("doc_id", "lang", "text", fold.alias("fold"), F.spark_partition_id().alias("part")))
    spelling = spark.sparkContext.broadcast(spelling_counts(docs))  # 2**24 entries at most
    folder = fresh_folder(spark, "word-counts")
    less = np.zeros((order, 2, 4))
    for level in range(order, 0, -1):
        sent = rows.mapInArrow(sender(level, order, bits, n_buckets, folder), SENT)
        found = cut(stored(answered(sent, n_buckets), folder, level, n_buckets))
        counted = found.where("part is null and lang is null").agg(*[F.sum(F.col("sums")[k]) for k in range(8)]).first()
        less[level - 1] = [discounts([counted[4 * f + k] or 0 for k in range(4)]) for f in (0, 1)]
    of_langs = found.where("part is null and lang is not null").groupBy(F.col("lang").alias("_lang")).agg(*[F.sum(F.col("sums")[k]).alias(f"c{k}") for k in range(10)])
    cut(stored(lang_answers(found.where("part is not null").select("part", "block", "lang"), of_langs), folder, 0, n_buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = cut(rows.mapInArrow(scorer(order, bits, folder, spelling, less), f"doc_id {kind}, lang string, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, bits double"))
    store, base = file_system(folder)
    if store.get_file_info(base).type == pa.fs.FileType.Directory:
        store.delete_dir(base)
    return out


def lang_answers(of_blocks: DataFrame, of_langs: DataFrame) -> DataFrame:
    """Answers of level 0: to each block the sums over its languages' words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [column(batch, f"c{k}").to_numpy() for k in range(10)]
            data = [packed([c[i : i + 1] for c in sums] + [np.ones(1, np.int64)], False) for i in range(batch.num_rows)]
            keys = column(batch, "lang").to_numpy().view(U)
            yield pa.record_batch({"part": column(batch, "part"), "block": column(batch, "block"), "bucket": column(batch, "lang"), "check": pa.array([checked(keys[i : i + 1]) for i in range(len(keys))], pa.int64()), "data": pa.array(data, pa.binary()), "lang": column(batch, "lang"), "sums": pa.nulls(batch.num_rows, pa.list_(pa.int64()))})

    rows = of_blocks.join(of_langs, F.col("lang") == F.col("_lang")).drop("_lang")
    return rows.mapInArrow(pack, "part int, block int, bucket long, check long, data binary, lang long, sums array<long>")


def bands(rows: DataFrame) -> DataFrame:
    """_lang, lowest_bits, highest_bits: the band of each language, from its quartiles in steps of 1 / STEPS bit."""
    steps = rows.where("not base_failed").groupBy("lang", F.round(F.col("bits") * STEPS).cast("long").alias("_step")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy("lang").orderBy("_step")
    steps = steps.withColumns({"_upto": F.sum("_n").over(order), "_all": F.sum("_n").over(Window.partitionBy("lang"))})
    quartile = lambda k: F.min(F.when(4 * F.col("_upto") >= k * F.col("_all"), F.col("_step"))) / STEPS
    found = steps.groupBy("lang").agg(*[quartile(k).alias(f"_q{k}") for k in (1, 2, 3)])
    below, above = F.greatest((F.col("_q2") - F.col("_q1")) * BELOW, F.lit(LEAST_REACH)), F.greatest((F.col("_q3") - F.col("_q2")) * ABOVE, F.lit(LEAST_REACH))
    return found.select(F.col("lang").alias("_lang"), (F.col("_q1") - below).alias("lowest_bits"), (F.col("_q3") + above).alias("highest_bits"))


def judge(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and log2 of the perplexity with its band."""
    rows = measured(docs.withColumn("lang", F.col("lang").cast("string")), order)
    of_lang = bands(rows)
    out = rows.join(of_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = F.coalesce(F.col("bits").between(F.col("lowest_bits"), F.col("highest_bits")), F.lit(False))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "bits", "lowest_bits", "highest_bits")
