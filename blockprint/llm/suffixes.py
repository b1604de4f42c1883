"""Repeated byte strings, found with suffix arrays.

A document loses every byte that lies in a string of LENGTH bytes which also starts in a document with a smaller doc_id.
Stretches of text that may hold such strings (documents share their minimisers) are dealt to shards by minimiser, so equal
strings meet. A shard sorts the suffixes of those stretches that share the hash of a string with another document's, by Larsson
and Sadakane's refinement: ranks by the first h bytes give, as pairs, ranks by 2h, and only groups that still have several
suffixes are sorted again. Kasai's walk through the text gives the common prefixes of neighbours; between neighbours that share LENGTH bytes or more the smallest doc_id owns
the string. If a minimiser fills more than one shard, the strings of the earlier shards are kept in sorted order, and
those of the next one are found among them by binary search and put between them.

Before stretches travel, (a) minimisers of one document are dropped, (b) texts that occur twice are represented by their
first document, and (c) of the strings that a piece of a task has in several documents only those of the first one travel, so that
a frequent passage sends a row for each task, not for each document. Such strings are found by hash and compared by bytes.

Nulls: a null text is empty; a null doc_id is neither smaller nor larger than others, so such rows lose nothing and take
nothing. Rows that repeat a doc_id are one document as to order: they do not take from each other. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprint.llm.common import bytes_and_bounds, column, cut, pieces, shuffle_partitions, text_key
from blockprint.llm.minimisers import BYTE_VALUES, Ranges, U, copies, is_in, neighbours, ragged_ranges, runs, window_minima, windows_inside, with_shared_values

LENGTH, GRAM, SHARD = 50, 20, 2 << 20
#: Stretches that a task remembers to have sent.
MOST_SEEN = 100_000
#: Between the stretches of a shard; never in UTF-8.
BETWEEN = 0xFF
#: Suffixes that Kasai's walk takes in step are this far apart.
LANE = 256


def byte_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[data], np.diff(bounds)


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data in order, and each suffix's rank. A suffix that is a prefix of another comes first."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | wide[k : n + k]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    h = 8
    while True:
        sizes = np.diff(np.append(first, n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in order
        if not len(tied):
            return order, rank
        suffixes = order[tied]
        # By the rank of what follows the first h bytes; suffixes that end before that come first, shorter ones first.
        follows = suffixes + h
        second = np.where(follows < n, rank[np.minimum(follows, n - 1)] + h + 1, n - suffixes)
        pair = rank[suffixes].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        by = np.argsort(pair)
        order[tied], pair = suffixes[by], pair[by]
        new = np.ones(n, bool)
        new[tied[1:]] = pair[1:] != pair[:-1]
        first = np.flatnonzero(new)
        rank[order[tied]] = np.repeat(first, np.diff(np.append(first, n)))[tied]
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """For each place of order but the first, how many bytes (`most` at most) its suffix shares with the one before.

    Kasai's walk: from one suffix to the next in the text the shared length drops by one at most. Stretches of LANE
    suffixes walk side by side, eight bytes at a time.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    lanes = -(-n // LANE)
    h = np.zeros(lanes, np.int64)
    start = np.arange(lanes) * LANE
    for step in range(LANE):
        i = start + step
        if i[-1] >= n:
            i, start, h = i[:-1], start[:-1], h[:-1]
            if not len(i):
                break
        j = before[i]
        limit = np.minimum(most, n - np.maximum(i, j))
        h = np.where(j < 0, 0, np.maximum(h - 1, 0))
        active = np.flatnonzero((j >= 0) & (h < limit))
        while len(active):
            unlike = eights[i[active] + h[active]] ^ eights[j[active] + h[active]]
            same = np.bitwise_count((unlike & -unlike) - U(1)).astype(np.int64) >> 3  # of these eight bytes
            h[active] = np.minimum(h[active] + same, limit[active])
            active = active[(same == 8) & (h[active] < limit[active])]
        out[rank[i]] = h
    return out


def owners(data: np.ndarray, valid: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the suffixes that are marked valid: in sorted order their places, the group (of equal first `length` bytes) of
    each, and each group's smallest doc."""
    order, rank = suffix_array(data)
    shared = common_prefixes(data, order, rank, length)
    group = np.cumsum(shared < length)  # neighbours that share less start a group
    keep = valid[order]
    order, group = order[keep], group[keep]
    if not len(order):
        return order, group, np.zeros(0, doc.dtype)
    first, last = runs(group)
    return order, np.repeat(np.arange(len(first)), last - first), np.minimum.reduceat(doc[order], first)


# ---- shards --------------------------------------------------------------------------------------------------------


def packed_stretches(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Stretches of text to be dealt out: value, doc_id, key, start (byte), n (strings), bytes; and, with nulls in value
    and bytes, runs of strings of which the task itself has seen a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                data, bounds = bytes_and_bounds(column(part, "text"))
                lengths = np.diff(bounds)
                units = BYTE_VALUES[data]
                minima = window_minima(units, length, gram)
                owner = np.repeat(np.arange(part.num_rows), lengths)
                at = np.flatnonzero(windows_inside(lengths, length)[: len(minima)])
                at = at[is_in(minima[at], owner[at], column(part, "values"))]
                if not len(at):
                    continue
                doc = column(part, "doc_id").to_numpy()[owner[at]]
                least = smallest_documents(data, at, Ranges(units)(at, at + length), doc, length)
                del units
                raw = data.tobytes()
                # Stretches of strings that the piece has in no smaller document, and runs of those that it has.
                w, n = neighbours(at[doc == least], owner, minima)
                stretches = [raw[x:y] for x, y in zip(w.tolist(), (w + n + length - 1).tolist(), strict=True)]
                ids = column(part, "doc_id").to_numpy()[owner[w]].tolist()
                fresh = np.ones(len(w), bool)
                for i, (s, d) in enumerate(zip(stretches, ids, strict=True)):
                    if seen.get(s, d) < d:  # a whole stretch that the task has sent from a smaller document
                        fresh[i] = False
                    else:
                        seen[s] = d
                if len(seen) > MOST_SEEN:
                    seen.clear()
                v, m = neighbours(at[doc > least], owner)
                for w, n, sent in ((w[fresh], n[fresh], [stretches[i] for i in np.flatnonzero(fresh).tolist()]), (np.concatenate([w[~fresh], v]), np.concatenate([n[~fresh], m]), None)):
                    who = pa.array(owner[w])
                    yield pa.record_batch([pa.nulls(len(w), pa.int64()) if sent is None else pa.array(minima[w]), column(part, "doc_id").take(who), column(part, "key").take(who), pa.array((w - bounds[owner[w]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(w), pa.binary()) if sent is None else pa.array(sent, pa.binary())], names=["value", "doc_id", "key", "start", "n", "bytes"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"value long, doc_id {kind}, key long, start int, n int, bytes binary")


def smallest_documents(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each of the strings that start at the places `at`, the smallest document that has it among these. Strings are
    grouped by hash and compared by their bytes; one that is unlike the others of its group stands for itself."""
    order = np.argsort(hashes)
    first, last = runs(hashes[order])
    several = np.repeat(last - first > 1, last - first)
    least = doc.copy()
    if not several.any():
        return least
    order = order[several]
    first, last = runs(hashes[order])
    earliest = np.full(len(at), -1, np.int64)  # the first place that has the string's hash
    earliest[order] = np.repeat(np.minimum.reduceat(at[order], first), last - first)
    # Where the string before is known to equal the one before that place, the last byte alone is new.
    rows = np.flatnonzero(earliest >= 0)
    a, b = at[rows], earliest[rows]
    follows = np.zeros(len(rows), bool)
    follows[1:] = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)
    same = np.empty(len(rows), bool)
    same[follows] = data[a[follows] + length - 1] == data[b[follows] + length - 1]
    strings, heads = np.lib.stride_tricks.sliding_window_view(data, length), np.flatnonzero(~follows)
    for i in range(0, len(heads), 1 << 16):
        h = heads[i : i + (1 << 16)]
        same[h] = (strings[a[h]] == strings[b[h]]).all(axis=1)
    if not same.all():  # a chain holds only as far as all of it is equal
        run, run_end = runs(np.cumsum(~follows))
        bad = np.add.reduceat(~same, run) > 0
        for x, y in zip(run[bad].tolist(), run_end[bad].tolist(), strict=True):
            same[x:y] = (strings[a[x:y]] == strings[b[x:y]]).all(axis=1)
    unlike = np.zeros(len(at), bool)
    unlike[rows[~same]] = True
    equal = order[~unlike[order]]
    first, last = runs(hashes[equal])
    least[equal] = np.repeat(np.minimum.reduceat(doc[equal], first), last - first)
    return least


class Shards:
    """Takes stretches by value and doc_id, in that order, a shard at a time; keeps the strings of an open value."""

    def __init__(self, length: int):
        self.length = length
        self.strings = np.zeros(0, f"S{length}")  # sorted; of the open value only
        self.least = np.zeros(0, np.int64)
        self.value: int | None = None

    def add(self, table: pa.Table) -> pa.RecordBatch | None:
        """Runs of strings (doc_id, key, start, n) that a smaller document has."""
        values, n = table.column("value").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        ids, keys, starts = (table.column(c).to_numpy() for c in ("doc_id", "key", "start"))
        stretches = table.column("bytes").to_pylist()
        # A stretch that a smaller document has as a whole is gone as a whole; rows come by doc_id.
        first: dict[bytes, int] = {}
        of = np.fromiter((first.setdefault(s, i) for i, s in enumerate(stretches)), np.int64, len(stretches))
        whole = ids > ids[of]
        # Suffixes are sorted for values with several different stretches, and for those that other shards may have too.
        unlike = np.flatnonzero(of == np.arange(len(of)))
        a, b = runs(values[unlike])
        several = np.repeat(b - a > 1, b - a) | (values[unlike] == values[-1]) | (values[unlike] == (self.value if self.value is not None else values[-1]))
        rows = np.flatnonzero(np.isin(of, unlike[several]) & ~whole)
        rows = self.may_share(rows, values, ids, n, stretches)
        gone = [(np.flatnonzero(whole), starts[whole].astype(np.int64), n[whole])]
        if len(rows):
            gone.append(self.sort(rows, values, ids, starts, n, stretches))
        who, begin, count = (np.concatenate(x) for x in zip(*gone, strict=True))
        if not len(who):
            return None
        return pa.record_batch([pa.array(ids[who]), pa.array(keys[who]), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc_id", "key", "start", "n"])

    def joined(self, rows: np.ndarray, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of these rows one after another, each with BETWEEN behind it, and their sizes with that."""
        between = bytes([BETWEEN])
        data = np.frombuffer(between.join([stretches[i] for i in rows.tolist()]) + between, np.uint8)
        return data, np.array([len(stretches[i]) for i in rows.tolist()]) + 1

    def may_share(self, rows: np.ndarray, values: np.ndarray, ids: np.ndarray, n: np.ndarray, stretches: list[bytes]) -> np.ndarray:
        """Of these rows, those that have a string whose hash a row of another document has too, and all rows of values
        that other shards may have. Strings that are equal have one hash, so what is left out has none to be found; in
        large tables most stretches of a minimiser have only that in common, and sorting them is most of the work."""
        open_value = (values[rows] == values[-1]) | (values[rows] == (self.value if self.value is not None else values[-1]))
        some = rows[~open_value]
        if not len(some):
            return rows
        data, sizes = self.joined(some, stretches)
        of, place = ragged_ranges(sizes)
        at = np.flatnonzero(place < n[some][of])
        hashes, row = Ranges(BYTE_VALUES[data])(at, at + self.length), of[at]
        order = np.argsort(hashes)
        first, last = runs(hashes[order])
        doc = ids[some][row[order]]
        shared = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), last - first)
        keep = np.zeros(len(some), bool)
        keep[row[order[shared]]] = True
        return np.sort(np.concatenate([some[keep], rows[open_value]]))

    def sort(self, rows: np.ndarray, values: np.ndarray, ids: np.ndarray, starts: np.ndarray, n: np.ndarray, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these rows, the runs of strings that a smaller document has: row, start, number."""
        length = self.length
        data, sizes = self.joined(rows, stretches)
        begin = np.cumsum(sizes) - sizes
        of, place = ragged_ranges(sizes)
        order, group, least = owners(data, place < n[rows][of], ids[rows][of], length)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        text = np.lib.stride_tricks.sliding_window_view(data, length)[order[first]]
        value = values[rows][of[order[first]]]
        if self.value is not None and len(self.strings) and (mine := np.flatnonzero(value == self.value)).size:
            strings = np.ascontiguousarray(text[mine]).view(f"S{length}").ravel()
            place = np.searchsorted(self.strings, strings)
            where = np.minimum(place, len(self.strings) - 1)
            known = self.strings[where] == strings
            least[mine] = np.where(known, np.minimum(least[mine], self.least[where]), least[mine])
            if self.value == values[-1]:  # sorted strings go between sorted ones, those that were there keep their owners
                self.strings, self.least = np.insert(self.strings, place[~known], strings[~known]), np.insert(self.least, place[~known], least[mine][~known])
        if self.value != values[-1] or not len(self.strings):
            last = value == values[-1]
            self.strings, self.least, self.value = np.ascontiguousarray(text[last]).view(f"S{length}").ravel(), least[last], int(values[-1])
        w = np.sort(order[ids[rows][of[order]] > least[group]])
        a, b = runs(w - np.arange(len(w)), of[w])
        w, count = w[a], b - a
        return rows[of[w]], starts[rows][of[w]] + w - begin[of[w]], count


def repeated_strings(stretches: DataFrame, length: int) -> DataFrame:
    """doc_id, key, start, n: runs of strings that start in a smaller document too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held, size = Shards(length), [], 0
        for batch in batches:
            direct = batch.filter(pa.compute.is_null(column(batch, "value")))
            if direct.num_rows:
                yield direct.select(["doc_id", "key", "start", "n"])
            batch = batch.filter(pa.compute.is_valid(column(batch, "value")))
            for part in pieces(batch, "bytes", SHARD):
                if size > SHARD:
                    out = shards.add(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held, size = [], 0
                held.append(part)
                size += column(part, "bytes").nbytes
        if held:
            out = shards.add(pa.Table.from_batches(held))
            if out is not None:
                yield out

    kind = stretches.schema["doc_id"].dataType.simpleString()
    spread = stretches.repartition(shuffle_partitions(stretches.sparkSession), F.coalesce("value", F.xxhash64("doc_id", "start"))).sortWithinPartitions("value", "doc_id")
    return spread.mapInArrow(run, f"doc_id {kind}, key long, start int, n int")


def merged(starts: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of the runs' bytes, as maximal spans."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], (starts + n + length - 1)[order]
    reach = np.maximum.accumulate(b)
    new = np.append(True, a[1:] > reach[:-1])
    return a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def without_spans(texts: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """doc_id, key, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes outside all spans as text (bytes
    of characters that were cut in two are left out of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, rows = batch.slice(i, 500), []
                for t, s, n in zip(*(column(part, c).to_pylist() for c in ("text", "starts", "ns")), strict=True):
                    raw = (t or "").encode()
                    a, b = merged(np.array(s, np.int64), np.array(n, np.int64), length)
                    edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(raw)]
                    rows.append((int((b - a).sum()), len(a), b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
                columns = {"doc_id": column(part, "doc_id"), "key": column(part, "key"), "n_removed": pa.array([r[0] for r in rows], pa.int64()), "n_spans": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": [hashlib.sha256(r[2]).hexdigest() for r in rows]}
                yield pa.record_batch(columns | ({"kept": [r[2].decode("utf-8", "ignore") for r in rows]} if keep_text else {}))

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "key", "text", "starts", "ns").mapInArrow(run, f"doc_id {kind}, key long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text)


def drop_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; if keep_text, also text (what is left) and
    rest (a struct of docs' other columns)."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]) if keep_text else F.lit(None)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))
    numbered = docs.where("doc_id is not null").select("doc_id", "text")
    known = copies(numbered)
    texts = with_shared_values(numbered, known.select("doc_id", "key"), byte_units, length, gram, within=False)
    found = repeated_strings(packed_stretches(texts, length, gram), length)
    lists = cut(found.groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")))
    ids = lists.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "starts", "ns")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    at = lambda left, right: (left["doc_id"] == right["_id"]) & (left["key"] == right["_key"])
    left = without_spans(rows.join(ids, at(rows, ids)).drop("_id", "_key"), length, keep_text).dropDuplicates(["doc_id", "key"])
    left = left.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("n_removed").alias("_removed"), F.col("n_spans").alias("_spans"), F.col("kept_sha256").alias("_sha"), *(["kept"] if keep_text else []))
    # Texts that several rows have: all but the first document's are gone as a whole.
    several = known.where("n > 1").select(F.col("digest").alias("_digest"), F.col("key").alias("_several"), F.col("doc_id").alias("_first"))
    base = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_own"), *(["text", "rest"] if keep_text else []))
    out = base.join(left, at(base, left), "left").join(several, (F.col("_own") == F.col("_digest")) & (F.col("key") == F.col("_several")), "left")
    whole = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)) & (F.col("n_bytes") >= length)
    columns = [
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "_own")).alias("kept_sha256"),
    ]
    if keep_text:
        columns += ["rest", F.when(whole, "").otherwise(F.coalesce("kept", "text")).alias("text")]
    return out.select(*columns)
