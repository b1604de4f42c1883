"""Repeated word windows, counted in super-k-mer buckets.

A window is WINDOW consecutive words of a document. Consecutive windows with one minimiser travel as one packed string
(the stretch of text that they cover) to the bucket of that minimiser, where the windows are sorted and counted. Minimisers
are the least grams by two orders, so windows at the border of a frequent passage do not all meet in its bucket. Every
window of which the corpus has two or more is repeated; a document loses the words that such windows cover.

Before strings travel, (a) minimisers that occur once are dropped, (b) texts that occur twice are represented by one, and
(c) a task that has a window twice keeps it once and marks all of its own occurrences, so that a frequent passage sends a
row for each task, not for each document. Buckets are read in sorted order and need memory for one piece at a time, and,
of a minimiser that fills more than a piece, its different windows. Windows are told apart by 128 bits: two
independent 64-bit hashes of each word, put together in two ways.

Nulls: a null text has no words; a null doc_id is an id like any other. Repeated rows are occurrences of their own, so all
of them are repeated. A text of fewer than WINDOW words loses nothing. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprint.llm.common import WORD, WORD_PATTERN, bytes_and_bounds, column, cut, pieces, shuffle_partitions, text_key
from blockprint.llm.minimisers import Ranges, copies, grouped, is_in, neighbours, ragged_ranges, runs, window_hashes, window_minima, windows_inside, with_shared_values, word_hashes, words_of

WINDOW, GRAM, PIECE = 35, 8, 3 << 20
#: Strings that a task remembers to have sent.
MOST_SEEN = 100_000


def word_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, lengths = words_of(data, bounds)
    return word_hashes(data, starts, ends), lengths


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """128 bits for each window of words: a row of two numbers, made of independent hashes of the words (`words` is one
    lane) in two ways."""
    other = Ranges(word_hashes(data, starts, ends, 1), 1).every(window)
    return np.stack([window_hashes(words, window), other], axis=1)


SHIPPED = "value long, doc_id {kind}, key long, start int, n int, words binary"


def packed_runs(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Super-k-mers of the texts' shared minimisers: value, document, first window, number of windows, their stretch of
    text; and, with null in value and words, runs of windows that the task itself has found twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                data, bounds = bytes_and_bounds(column(part, "text"))
                starts, ends, lengths = words_of(data, bounds)
                words = word_hashes(data, starts, ends)
                minima = window_minima(words, window, gram, double=True)
                owner = np.repeat(np.arange(part.num_rows), lengths)
                at = np.flatnonzero(windows_inside(lengths, window)[: len(minima)])
                at = at[is_in(minima[at], owner[at], column(part, "values"))]
                if not len(at):
                    continue
                order, first, last = grouped(identities(data, starts, ends, words, window)[at])
                times = np.repeat(last - first, last - first)
                twice, ship = np.zeros(len(at), bool), np.zeros(len(at), bool)
                twice[order] = times > 1
                ship[order[first]] = True
                base, raw = np.cumsum(lengths) - lengths, data.tobytes()
                w, n = neighbours(at[ship], owner, minima)
                strings = [raw[x:y] for x, y in zip(starts[w].tolist(), ends[w + n + window - 2].tolist(), strict=True)]
                fresh = np.ones(len(w), bool)
                for i, s in enumerate(strings):
                    times = seen[s] = seen.get(s, 0) + 1
                    fresh[i] = times <= 2  # two of a string tell the bucket that it is repeated, and the rest know
                if len(seen) > MOST_SEEN:
                    seen.clear()
                v, m = neighbours(at[twice], owner)
                for w, n, sent in ((w[fresh], n[fresh], [strings[i] for i in np.flatnonzero(fresh).tolist()]), (np.concatenate([w[~fresh], v]), np.concatenate([n[~fresh], m]), None)):
                    who = pa.array(owner[w])
                    yield pa.record_batch([pa.nulls(len(w), pa.int64()) if sent is None else pa.array(minima[w]), column(part, "doc_id").take(who), column(part, "key").take(who), pa.array((w - base[owner[w]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(w), pa.binary()) if sent is None else pa.array(sent, pa.binary())], names=["value", "doc_id", "key", "start", "n", "words"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, SHIPPED.format(kind=kind))


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, key, start, n: runs of windows that occur twice or more."""

    def counted(table: pa.Table, kept: dict | None) -> tuple[pa.RecordBatch | None, dict]:
        """Runs of repeated windows of the rows in table and of what is kept of the last value; what is to be kept."""
        values, n = table.column("value").combine_chunks().to_numpy(), table.column("n").to_numpy().astype(np.int64)
        data, bounds = bytes_and_bounds(table.column("words").combine_chunks())
        starts, ends, lengths = words_of(data, bounds)
        hashes = identities(data, starts, ends, word_hashes(data, starts, ends), window)
        row, place = ragged_ranges(n)
        hashes = hashes[(np.cumsum(lengths) - lengths)[row] + place]
        value, where = values[row], table.column("start").to_numpy().astype(np.int64)[row] + place
        ids, keys = table.column("doc_id").combine_chunks().take(pa.array(row)), table.column("key").to_numpy()[row]
        known = np.zeros(len(value), bool)
        if kept is not None:
            hashes, value = np.concatenate([kept["hashes"], hashes]), np.concatenate([kept["value"], value])
            where, keys = np.concatenate([kept["where"], where]), np.concatenate([kept["keys"], keys])
            ids, known = pa.concat_arrays([kept["ids"], ids]), np.concatenate([kept["known"], known])
        order, first, last = grouped(hashes)
        size = last - first
        any_known = np.add.reduceat(known[order], first) > 0
        bad = np.zeros(len(value), bool)
        bad[order] = np.repeat((size > 1) | any_known, size)
        fresh = bad & ~known
        out = None
        if fresh.any():
            w = np.flatnonzero(fresh)
            code = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            w = w[np.lexsort((where[w], keys[w], code[w]))]
            a, b = runs(where[w] - np.arange(len(w)), code[w], keys[w])
            out = pa.record_batch([ids.take(pa.array(w[a])), pa.array(keys[w[a]]), pa.array(where[w[a]].astype(np.int32)), pa.array((b - a).astype(np.int32))], names=["doc_id", "key", "start", "n"])
        stay = order[first]  # one of each different window of the last value
        stay = stay[value[stay] == values[-1]]
        return out, {"hashes": hashes[stay], "value": value[stay], "where": where[stay], "keys": keys[stay], "ids": ids.take(pa.array(stay)), "known": bad[stay]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, kept = 0, None
        for batch in batches:
            direct = batch.filter(pa.compute.is_null(column(batch, "value")))
            if direct.num_rows:
                yield direct.select(["doc_id", "key", "start", "n"])
            batch = batch.filter(pa.compute.is_valid(column(batch, "value")))
            for part in pieces(batch, "words", PIECE):
                v = column(part, "value").to_numpy()
                if size > PIECE:
                    out, last = counted(pa.Table.from_batches(held), kept)
                    if out is not None:
                        yield out
                    kept = last if len(last["value"]) and last["value"][0] == v[0] else None
                    held, size = [], 0
                held.append(part)
                size += column(part, "words").nbytes
        if held:
            out, _ = counted(pa.Table.from_batches(held), kept)
            if out is not None:
                yield out

    kind = rows.schema["doc_id"].dataType.simpleString()
    # Rows that only pass through (no value) are dealt by document, the others by minimiser.
    spread = rows.repartition(shuffle_partitions(rows.sparkSession), F.coalesce("value", F.xxhash64("doc_id", "start"))).sortWithinPartitions("value")
    return spread.mapInArrow(run, f"doc_id {kind}, key long, start int, n int")


def covered(starts: np.ndarray, n: np.ndarray, window: int, size: int) -> np.ndarray:
    """Which of `size` units lie in the windows of the runs."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, np.minimum(starts, size), 1)
    np.add.at(marks, np.minimum(starts + n + window - 1, size), -1)
    return np.cumsum(marks[:-1]) > 0


def without_windows(texts: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """doc_id, key, n_removed, kept_sha256 (and text, if kept): the words that no window in lists `starts`, `ns` covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                removed, kept = [], []
                for t, s, n in zip(*(column(part, c).to_pylist() for c in ("text", "starts", "ns")), strict=True):
                    words = WORD.findall(t or "")
                    gone = covered(np.array(s, np.int64), np.array(n, np.int64), window, len(words))
                    removed.append(int(gone.sum()))
                    kept.append(" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                columns = {"doc_id": column(part, "doc_id"), "key": column(part, "key"), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": [hashlib.sha256(k.encode()).hexdigest() for k in kept]}
                yield pa.record_batch(columns | ({"kept": kept} if keep_text else {}))

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "key", "text", "starts", "ns").mapInArrow(run, f"doc_id {kind}, key long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space) for each row of docs."""
    docs = docs.select("doc_id", "text")
    known = copies(docs)
    texts = with_shared_values(docs, known.select("doc_id", "key"), word_units, window, gram, within=True)
    found = repeated_windows(packed_runs(texts, window, gram), window)
    lists = cut(found.groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns")))
    ids = lists.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "starts", "ns")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    at = lambda left, right: left["doc_id"].eqNullSafe(right["_id"]) & (left["key"] == right["_key"])
    cut_texts = without_windows(rows.join(ids, at(rows, ids)).drop("_id", "_key"), window, keep_text).dropDuplicates(["doc_id", "key"])
    cut_texts = cut_texts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("n_removed").alias("_removed"), F.col("kept_sha256").alias("_sha"), *(["kept"] if keep_text else []))
    # Texts that several rows have: each of their windows starts elsewhere too.
    several = known.where("n > 1").select(F.col("digest").alias("_digest"), F.col("key").alias("_several"))
    words = F.expr(f"regexp_extract_all(coalesce(text, ''), r'{WORD_PATTERN}', 0)")
    base = docs.select("doc_id", text_key(F.col("text")).alias("key"), words.alias("_words"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_own"))
    base = base.select("doc_id", "key", "_own", F.size("_words").cast("long").alias("n_words"), F.array_join("_words", " ").alias("_joined"))
    base = base.select("doc_id", "key", "_own", "n_words", F.sha2("_joined", 256).alias("_all"), *(["_joined"] if keep_text else []))
    out = base.join(cut_texts, at(base, cut_texts), "left").join(several, (F.col("_own") == F.col("_digest")) & (F.col("key") == F.col("_several")), "left")
    whole = F.col("_digest").isNotNull() & (F.col("n_words") >= window)
    columns = [
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "_all")).alias("kept_sha256"),
    ]
    if keep_text:
        columns.append(F.when(whole, "").otherwise(F.coalesce("kept", "_joined")).alias("kept"))
    return out.select(*columns)
