"""Which documents may share a window of text, found by minimisers.

Every window has a minimiser: the least hash of the grams in it. Equal windows have the same one, and neighbours mostly do,
so a document sends one value for a run of windows. Values that occur in one document only are dropped; what is left goes
back to the documents, whose texts are then the only ones to be looked at closely. Hashes only steer the search here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprint.llm.common import bytes_and_bounds, column, cut, pieces, shuffle_partitions, text_key

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
MULTIPLIERS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


#: Seeds and multipliers of the two lanes of word hashes; any odd multipliers do.
LANES = ((U(0x243F6A8885A308D3), U(0x9E3779B97F4A7C15)), (U(0x13198A2E03707344), U(0xD6E8FEB86659FD93)))
#: Words of more bytes are hashed by blake2b, one by one; there can be only few.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64 bits of each word's bytes; the lanes are independent of each other. Eight bytes at a time go through a bijection
    that mixes all bits, chained and begun with the length, so no arrangement of repeated letters makes words collide."""
    seed, multiplier = LANES[lane]
    size = ends - starts
    out = mixed(size.astype(np.uint64) * multiplier + seed)
    short = size <= LONG_WORD
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rows, at = np.flatnonzero(short), starts[short]
    left = size[short]
    while len(rows):
        value = eights[at]
        part = left < 8
        value[part] &= (U(1) << (left[part].astype(np.uint64) * U(8))) - U(1)
        out[rows] = mixed((out[rows] ^ value) * multiplier + seed)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([lane + 1])).digest(), "little")
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of each pair (a, b), in this order."""
    return mixed(mixed(a * U(0xD6E8FEB86659FD93) + U(0x2545F4914F6CDD1D)) ^ b)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64 bits of each range of a width: pairs of pairs, up to the largest power of two, and two of these that overlap."""
    if len(words) < width:
        return words[:0]
    size, out = 1, words
    while size * 2 <= width:
        out = joined(out[:-size], out[size:])
        size *= 2
    return joined(out[: len(words) - width + 1], out[width - size :]) if size < width else out


class Powers:
    """Powers of an odd multiplier and of its inverse, modulo 2**64, as far as asked for."""

    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in cls.kept or len(cls.kept[which][0]) < n:
            m = int(MULTIPLIERS[which])
            out = []
            for x in (m, pow(m, -1, 1 << 64)):
                a = np.full(max(n, 1 << 16), x, np.uint64)
                a[0] = 1
                out.append(np.cumprod(a))
            cls.kept[which] = (out[0], out[1])
        up, down = cls.kept[which]
        return up[:n], down[:n]


class Ranges:
    """Hashes of ranges of a sequence of 64-bit values, by sums of powers modulo 2**64. Arrangements of two values can be made
    to collide, so these hashes steer searches only, or stand beside one of another kind."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = Powers.of(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def every(self, width: int) -> np.ndarray:
        """Of all ranges of a width, one for each start."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:-width]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words of all texts, and the number of words of each text."""
    separator = SEPARATOR[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = separator[:-1], separator[1:]
    full = np.diff(bounds) > 0
    before[bounds[:-1][full]] = True
    after[bounds[1:][full] - 1] = True
    starts, ends = np.flatnonzero(~separator & before), np.flatnonzero(~separator & after) + 1
    at = np.searchsorted(starts, bounds)
    return starts, ends, np.diff(at)


def lowered(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= ord("A")) & (data <= ord("Z"))] += 32
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    if len(values) < width:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def window_minima(units: np.ndarray, window: int, gram: int, double: bool = False) -> np.ndarray:
    """The minimiser of each window of units, as a signed number (for Spark's longs). double: the minimisers by two orders of
    the grams as one number, which windows that share a frequent gram only seldom have in common."""
    grams = Ranges(units).every(gram)
    out = sliding_min(grams, window - gram + 1)
    if double:
        out = joined(out, sliding_min(mixed(grams ^ U(0x5DEECE66D1234567)), window - gram + 1))
    return out.view(np.int64)


def ragged_ranges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given lengths: each element's group, and its place in the group."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def windows_inside(lengths: np.ndarray, window: int) -> np.ndarray:
    """For units of texts one after another: whether the window that starts at each lies in its text."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.arange(len(ends)) + window <= ends


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], n)


def neighbours(w: np.ndarray, owner: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of neighbours in w with one owner (and equal keys)."""
    a, b = runs(w - np.arange(len(w)), owner[w], *(k[w] for k in keys))
    return w[a], b - a


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal rows of 128 bits stand together, and the starts and ends of their runs in it. Rows are
    sorted by their first half, which alone is all but sure to tell them apart, and compared as a whole."""
    order = np.argsort(hashes[:, 0])
    return order, *runs(hashes[order, 0], hashes[order, 1])


def first_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Without rows whose text another row of the batch has with a smaller doc_id (null is smallest)."""
    best: dict[str, tuple[tuple, int]] = {}
    for i, (d, t) in enumerate(zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True)):
        rank = (d is not None, d or 0)
        if t is not None and (t not in best or rank < best[t][0]):
            best[t] = (rank, i)
    return batch.take(pa.array(sorted(i for _, i in best.values()), pa.int64()))


def comes_again(units: np.ndarray, window: int, most: int) -> np.ndarray:
    """Whether the window at each place stands again at most that many units later."""
    hashes = Ranges(units).every(window)
    out = np.zeros(len(hashes), bool)
    for k in range(1, min(most, len(hashes) - 1) + 1):
        out[:-k] |= hashes[:-k] == hashes[k:]
    return out


def values_of(docs: DataFrame, units: Callable, window: int, gram: int, within: bool) -> DataFrame:
    """doc_id, value, twice: the minimisers of each text's windows, each once. If within is asked for, twice tells
    whether the text may repeat a window with that minimiser: it has several runs of it, or a window comes again in a run;
    and the text's key stands beside doc_id, as several texts may have one id; and minimisers are double ones.
    units: of bytes and bounds, 64-bit units and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                part = first_copies(part)
                if not part.num_rows:
                    continue
                values, lengths = units(*bytes_and_bounds(column(part, "text")))
                owner = np.repeat(np.arange(part.num_rows), lengths)
                minima = window_minima(values, window, gram, within)
                inside = windows_inside(lengths, window)[: len(minima)]
                again = comes_again(values, window, window - gram)[inside] if within else np.zeros(int(inside.sum()), bool)
                v, o = minima[inside], owner[: len(minima)][inside]
                starts, ends = runs(v, o)
                if not len(starts):
                    continue
                v, o, again = v[starts], o[starts], np.logical_or.reduceat(again, starts) | (ends - starts > window - gram + 1)
                order = np.lexsort((v, o))
                v, o, again = v[order], o[order], again[order]
                first, last = runs(v, o)
                twice = (last - first > 1) | np.logical_or.reduceat(again, first)
                who = pa.array(o[first])
                yield pa.record_batch({**{c: column(part, c).take(who) for c in names}, "value": pa.array(v[first]), "twice": pa.array(twice)})

    kind, names = docs.schema["doc_id"].dataType.simpleString(), ["doc_id", "key"] if within else ["doc_id"]
    docs = docs.select("doc_id", "text", *([text_key(F.col("text")).alias("key")] if within else []))
    return docs.mapInArrow(run, f"doc_id {kind}, " + "key long, " * within + "value long, twice boolean")


def shared_values(values: DataFrame, within: bool) -> DataFrame:
    """The rows of values that several documents have (or, if within, one has twice). Documents are told apart by doc_id
    and, if values have it, the key of their text. Rows come sorted by value and pass
    through; only the last group's state is kept, whatever its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # a first row whose value is not yet shared
        open_value = None  # the last value, if it is shared
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            v = column(batch, "value").to_numpy()
            ids = column(batch, "doc_id")
            d, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            twice = column(batch, "twice").to_numpy(zero_copy_only=False)
            starts, ends = runs(v)
            of = np.repeat(starts, ends - starts)
            other = (d != d[of]) | (null != null[of]) | (twice if within else False)
            if keyed:
                k = column(batch, "key").to_numpy()
                other |= k != k[of]
            shared = np.add.reduceat(other, starts) > 0
            if open_value is not None and v[0] == open_value:
                shared[0] = True
            take = np.repeat(shared, ends - starts)
            rest = None if shared[-1] else batch.slice(starts[-1], 1)
            open_value = v[-1] if shared[-1] else None
            if take.any():
                yield batch.filter(pa.array(take)).select(["doc_id", "value"])

    kind, keyed = values.schema["doc_id"].dataType.simpleString(), "key" in values.columns
    rows = values.repartition(shuffle_partitions(values.sparkSession), "value").sortWithinPartitions("value")
    return rows.mapInArrow(run, f"doc_id {kind}, value long")


def with_shared_values(docs: DataFrame, firsts: DataFrame, units: Callable, window: int, gram: int, within: bool) -> DataFrame:
    """doc_id, key, text, values of the documents in firsts (doc_id, key) that have shared values."""
    known = shared_values(values_of(docs, units, window, gram, within), within)
    known = cut(known.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("value").alias("values")))
    rows = firsts.join(known, F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "values")
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return texts.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "text", "values")


def copies(docs: DataFrame) -> DataFrame:
    """For each different text: doc_id and key of its first document (null first), and how many rows have it."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return cut(rows.groupBy("digest", "key").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"), F.count("*").alias("n")).select("digest", "key", F.col("first.doc_id").alias("doc_id"), "n"))


def is_in(values: np.ndarray, owner: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in its owner's list."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    a = mixed(values.view(np.uint64) ^ mixed(owner.astype(np.uint64) + U(1)))
    b = np.sort(mixed(flat.view(np.uint64) ^ mixed(of.astype(np.uint64) + U(1))))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return b[at] == a if len(b) else np.zeros(len(a), bool)
