"""Digests in Structured Streaming: of whole records, and of streams that come in chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockprint.functions import hashes, kernels
from blockprint.functions.digests import digest, score
from blockprint.functions.incremental import StreamDigest
from blockprint.operators.joins import FEW_QUERIES

OUTPUT = "id string, n_bytes long, log_block_size int, bh1 string, bh2 string, complete boolean, error string"
STATE = "state binary, next long, held string, last long, told boolean"


def digest_records(stream: DataFrame, data: str, long: bool = False) -> DataFrame:
    """The stream with a digest of each record; no state."""
    return stream.withColumn("digest", digest(data, long))


def match_records(stream: DataFrame, known: DataFrame, data: str, id: str = "id", known_id: str = "id", known_digest: str = "digest", threshold: int = 1) -> DataFrame:
    """Matches of each record of a stream with a static table of digests: id, match, score. A match is found through
    index keys; of the keys that a record and a digest share the first one alone gives a row, so no state is needed to give
    each pair once. Rows carry a digest to its keys, not all its keys to each; the keys of few known digests go to all tasks."""
    keyed = lambda h: F.concat(hashes.index_keys(h), F.array(F.xxhash64(hashes.to_string(h))))
    keys = known.where(F.col(known_digest).isNotNull()).select(F.col(known_id).alias("match"), hashes.normalize(known_digest).alias("hb"))
    keys = keys.select("match", "hb", F.explode(keyed("hb")).alias("k"))
    keys = F.broadcast(keys) if known.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES else keys
    rows = stream.select(F.col(id).alias("id"), hashes.normalize(digest(data)).alias("ha"))
    met = rows.select("id", "ha", F.explode(keyed("ha")).alias("k")).join(keys, "k").where(F.col("k") == F.array_intersect(keyed("ha"), keyed("hb"))[0])
    return met.select("id", "match", score("ha", "hb", normalized=True).alias("score")).where(F.col("score") >= threshold)


def digest_chunks(stream: DataFrame, every_batch: bool = False, long: bool = False, keep_ms: int | None = None) -> DataFrame:
    """Digests of streams in rows (id, seq, chunk, is_last), seq from 0 on.

    Chunks that come early wait in the state until those before them have come; chunks whose seq has been used are
    dropped. A row goes out when the last chunk is used (append mode) or, with every_batch, for what has been used so far
    after each batch that had chunks of the stream (update mode). Of a complete stream some bytes are kept, so that late
    chunks are known as such; with keep_ms they, and what is kept of streams to which nothing comes, go after that time. A
    stream of more bytes than digests are for has an error and no digest.
    """

    def row(id: str, size: int, h: tuple, complete: bool, error: str | None) -> pd.DataFrame:
        return pd.DataFrame([(id, size, *h, complete, error)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def fold(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        state, following, held, last, told = group.get if group.exists else (b"", 0, "{}", -1, False)
        if told:
            return
        waiting = {int(k): bytes.fromhex(v) for k, v in json.loads(held).items()}
        for batch in batches:
            for seq, chunk, is_last in zip(batch["seq"], batch["chunk"], batch["is_last"], strict=True):
                if seq >= following and seq not in waiting:
                    waiting[int(seq)] = bytes(chunk) if chunk is not None else b""
                    if is_last:
                        last = int(seq)
        ready = []
        while following in waiting:
            ready.append(waiting.pop(following))
            following += 1
        data, complete = b"".join(ready), last >= 0 and following > last
        if complete and not state:  # the whole stream at once
            group.update((b"", following, "{}", last, True))
            if keep_ms is not None:
                group.setTimeoutDuration(keep_ms)
            [(log, bh1, bh2)] = kernels.digests([data], not long)
            yield row(key[0], len(data), (log, bh1.decode(), bh2.decode()), True, None)
            return
        out = StreamDigest.load(bytes(state)) if state else StreamDigest()
        out.update(data)
        group.update((b"", following, "{}", last, True) if complete else (out.dump(), following, json.dumps({k: v.hex() for k, v in waiting.items()}), last, False))
        if keep_ms is not None:
            group.setTimeoutDuration(keep_ms)
        if every_batch or complete:
            h = (None, None, None) if out.error else out.digest(long)
            yield row(key[0], out.size, h, complete, out.error)

    rows = stream.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"), F.coalesce("is_last", F.lit(False)).alias("is_last"))
    return rows.groupBy("id").applyInPandasWithState(fold, OUTPUT, STATE, "update" if every_batch else "append", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
