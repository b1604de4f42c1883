"""Digests of byte streams that come in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprint.functions import kernels
from blockprint.functions.hashes import HASH
from blockprint.functions.incremental import StreamDigest

#: Bytes of a stream that are held before its state takes them; streams up to this are digested many at a time.
HELD_BYTES, PASS_BYTES = 4 << 20, 1 << 20
#: Bytes up to which each prefix of a stream is digested as a whole, which then costs less than a step of a state.
PREFIX_BYTES = 8 << 10
ARROW_HASH = pa.struct([("log_block_size", pa.int32()), ("bh1", pa.string()), ("bh2", pa.string())])


def _in_order(df: DataFrame, id: str, seq: str, chunk: str) -> DataFrame:
    rows = df.select(F.col(id).alias("id"), F.col(seq).alias("seq"), F.col(chunk).cast("binary").alias("chunk"))
    return rows.repartition("id").sortWithinPartitions("id", "seq").select("id", "chunk")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes | None, bool]]:
    """(id, chunk, whether it is the stream's first) of rows that come stream by stream."""
    last, any_ = None, False
    for batch in batches:
        for key, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield key, chunk, not any_ or key != last
            last, any_ = key, True


def digest_chunks(df: DataFrame, id: str, seq: str, chunk: str, long: bool = False) -> DataFrame:
    """id, digest and error of each stream in rows (id, seq, chunk), of any length: a task reads its streams one after another
    and keeps HELD_BYTES of one. Null chunks are left out; a stream of more bytes than digests are for has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        found: list = []
        small: list[tuple[int, bytes]] = []
        held: list[bytes] = []
        size, state, some = 0, None, 0

        def batch() -> pa.RecordBatch:
            for (at, _), h in zip(small, kernels.digests([data for _, data in small], not long) if small else [], strict=True):
                found[at] = (h[0], h[1].decode(), h[2].decode())
            out = pa.record_batch({"id": pa.array(ids, kind), "digest": pa.array([None if isinstance(f, str) else dict(zip(("log_block_size", "bh1", "bh2"), f, strict=True)) for f in found], ARROW_HASH), "error": pa.array([f if isinstance(f, str) else None for f in found], pa.string())})
            ids.clear()
            found.clear()
            small.clear()
            return out

        def close() -> None:
            nonlocal size, state, some
            data = b"".join(held)
            if state is None:
                small.append((len(found), data))
                some += len(data)
                found.append(None)
            else:
                state.update(data)
                found.append(state.error or state.digest(long))
            held.clear()
            size, state = 0, None

        kind, open_ = None, False
        for key, data, new in _streams(typed(batches)):
            kind = types[0]
            if new:
                if open_:
                    close()
                if some > PASS_BYTES:
                    yield batch()
                    some = 0
                ids.append(key)
                open_ = True
            if data:
                held.append(data)
                size += len(data)
                if size > HELD_BYTES:
                    state = state or StreamDigest()
                    state.update(b"".join(held))
                    held.clear()
                    size = 0
        if open_:
            close()
            yield batch()

    types: list[pa.DataType] = []

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types[:] = [batch.schema.field(0).type]
            yield batch

    rows = _in_order(df, id, seq, chunk)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest {HASH}, error string")


def prefix_digests(df: DataFrame, id: str, seq: str, chunk: str, long: bool = False) -> DataFrame:
    """id, place (from 1 on), n_bytes, digest and error after each chunk of each stream. While a stream has PREFIX_BYTES or
    less, what there is of it is digested many at a time; then a state goes on after its digest was asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, place, so_far = None, 0, b""
        for batch in batches:
            rows: list = []
            small: list[tuple[int, bytes]] = []
            some = 0

            def settle(rows: list = rows, small: list = small) -> None:
                for (at, data), (n, x, y) in zip(small, kernels.digests([data for _, data in small], not long) if small else [], strict=True):
                    rows[at] = (*rows[at][:3], {"log_block_size": n, "bh1": x.decode(), "bh2": y.decode()}, None)
                small.clear()

            for key, chunk_, new in one(batch):
                if new:
                    state, place, so_far = None, 0, b""
                place += 1
                if state is None and len(so_far) + len(chunk_ or b"") <= PREFIX_BYTES:
                    so_far += chunk_ or b""
                    small.append((len(rows), so_far))
                    rows.append((key, place, len(so_far), None, None))
                    some += len(so_far)
                    if some > PASS_BYTES:
                        settle()
                        some = 0
                    continue
                if state is None:
                    state = StreamDigest()
                    state.update(so_far)
                    so_far = b""
                state.update(chunk_ or b"")
                h = None if state.error else dict(zip(("log_block_size", "bh1", "bh2"), state.digest(long), strict=True))
                rows.append((key, place, state.size, h, state.error))
            settle()
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), ARROW_HASH, pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "place", "n_bytes", "digest", "error"])

    last: list = []

    def one(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes | None, bool]]:
        for key, chunk_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield key, chunk_, not last or last[0] != key
            last[:] = [key]

    rows = _in_order(df, id, seq, chunk)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, place long, n_bytes long, digest {HASH}, error string")
