"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are counts over the whole text. cos(x W + b) with W from a normal distribution approximates a Gaussian kernel;
the ridge weights solve normal equations whose sums each partition makes of its rows (fixed size, summed in a tree). The
raw scores of labelled rows that the ridge has not seen are counted in fixed bins, and pooling adjacent violators over the
bins gives the calibration. Everything but the features' scale is linear in the rows; no row is sampled.

Rows with crc32(doc_id as text) mod 4 = 2 are never learned from; 0 and 1 fit the ridge, 3 the calibration. Nulls are
empty texts; an empty text gets the score of its (zero) statistics. Labels other than 0 and 1 are ignored; without labels
every score is 0.5. Repeated rows are scored each; a document with several labels is learned from once for each. An empty
table gives an empty result; other columns are ignored. Sums are made in a fixed order of rows, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprint.llm.common import WORD, bytes_and_bounds, column, cut, in_small_batches, pieces, shuffle_partitions, text_key

FEATURES, SEED, RIDGE, BINS, ACCEPT, SLOTS = 256, 11, 1e-3, 4000, 0.7, 16
STATISTICS = ("log_words", "word_length", "distinct_words", "repeats", "upper", "digits", "symbols", "exclamations", "points", "commas", "other_marks", "bare_words", "lines", "repeated_lines", "spaces", "non_ascii", "top_word", "control")
#: Classes of bytes that are counted.
UPPER, LOWER, DIGIT, SYMBOL, EXCLAIM, POINT, COMMA, MARK, SPACE, HIGH, CONTROL, LINE, CLASSES = range(13)


def byte_classes() -> np.ndarray:
    out = np.full(256, MARK, np.uint8)
    out[:32] = out[127] = CONTROL
    out[128:] = HIGH
    for kind, chars in ((UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, "abcdefghijklmnopqrstuvwxyz"), (DIGIT, "0123456789"), (SYMBOL, "#*$%&|<>{}[]\\^~_=+@/"), (EXCLAIM, "!?"), (POINT, "."), (COMMA, ",;:"), (SPACE, " \t"), (LINE, "\n\r")):
        out[[ord(c) for c in chars]] = kind
    return out


CLASS = byte_classes()


def statistics(text: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, bounds = bytes_and_bounds(text)
    n = len(text)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    counts = np.bincount(owner * CLASSES + CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    words_of = np.zeros((n, 7))
    for i, t in enumerate(text.to_pylist()):
        words = WORD.findall(t or "")
        if not words:
            continue
        lines = [x for x in t.split("\n") if x.strip()]
        seen: dict[str, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        words_of[i] = (len(words), sum(map(len, words)), len(seen), sum(map(eq, words, words[1:])), len(lines), len(lines) - len(set(lines)), max(seen.values()))
    size, letters = np.maximum(1, np.diff(bounds)), np.maximum(1, counts[:, UPPER] + counts[:, LOWER])
    words, top = np.maximum(1, words_of[:, 0]), words_of[:, 6]
    out = np.stack(
        [
            np.log1p(words_of[:, 0]), np.minimum(words_of[:, 1] / words, 50), words_of[:, 2] / words, words_of[:, 3] / words, counts[:, UPPER] / letters, counts[:, DIGIT] / size,
            np.minimum(counts[:, SYMBOL] / words, 4), np.minimum(counts[:, EXCLAIM] / words, 4), np.minimum(counts[:, POINT] / words, 4), np.minimum(counts[:, COMMA] / words, 4), np.minimum(counts[:, MARK] / words, 4),
            (letters <= 1) * 1.0, words_of[:, 4] / words, words_of[:, 5] / np.maximum(1, words_of[:, 4]), counts[:, SPACE] / size, counts[:, HIGH] / size, np.minimum(1, top / words), counts[:, CONTROL] / size,
        ],
        axis=1,
    )
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and x: the statistics as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x = statistics(column(part, "text"))
                yield pa.record_batch({"doc_id": column(part, "doc_id"), "key": column(part, "key"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, x binary")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def partition_sums(rows: DataFrame, of_rows: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows (x, y) of of_rows: each partition sums its own, SLOTS tasks sum those, the driver the rest, all
    in a fixed order."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(column(batch, "x").to_pylist())).reshape(batch.num_rows, -1)
                for i in range(0, len(x), 2000):
                    total += of_rows(x[i : i + 2000], column(batch, "y").to_numpy(zero_copy_only=False)[i : i + 2000].astype(float))
        part = TaskContext.get().partitionId()
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "slot": pa.array([part % SLOTS], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(column(batch, "slot").to_pylist(), column(batch, "total").to_pylist(), strict=True):
                totals[slot] = totals.get(slot, 0) + np.frombuffer(raw).reshape(shape)
        yield pa.record_batch({"slot": pa.array(list(totals), pa.int32()), "total": pa.array([t.tobytes() for t in totals.values()], pa.binary())})

    sums = rows.select("x", "y").mapInArrow(run, "part int, slot int, total binary")
    sums = sums.repartition(SLOTS, "slot").sortWithinPartitions("slot", "part").mapInArrow(add, "slot int, total binary")
    return sum((np.frombuffer(r["total"]).reshape(shape) for r in sorted(sums.collect(), key=lambda r: r["slot"])), np.zeros(shape))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    fitted: bool = False

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.shifts
        return np.concatenate([np.cos(z) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score; a thousandth of the raw one keeps the order of scores that the calibration makes equal. It is
        rounded, as the last digits of products of matrices depend on how many rows are multiplied at once."""
        raw = self.raw(x)
        return np.round(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip((raw + 1) / 3, 0, 1), 9)


def isotonic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; knots at the mean x of each block."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, ones, n, strict=True):
        blocks.append([a * c, b, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    known = stats.join(known, F.col("doc_id") == F.col("_id")).withColumn("fold", fold(F.col("doc_id"))).where("fold <> 2")
    known = cut(known.repartition(shuffle_partitions(stats.sparkSession), "doc_id").sortWithinPartitions("doc_id", "key", "y").select("x", "y", "fold"))
    fitting, checking = known.where("fold <> 3"), known.where("fold = 3")
    d, rng = len(STATISTICS), np.random.default_rng(SEED)
    moments = partition_sums(fitting, lambda x, y: np.stack([np.full(d, float(len(x))), x.sum(0), (x * x).sum(0)]), (3, d))
    n = max(1.0, moments[0, 0])
    mean = moments[1] / n
    scale = np.sqrt(np.maximum(moments[2] / n - mean**2, 1e-6))
    model = Model(mean, scale, rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    if moments[0, 0] == 0:
        return model
    model.fitted = True

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return z.T @ np.concatenate([z, y[:, None]], axis=1)

    sums = partition_sums(fitting, equations, (FEATURES + 1, FEATURES + 2))
    model.weights = np.linalg.solve(sums[:, :-1] + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, sums[:, -1])

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = np.clip(model.raw(x), -0.999, 1.999)
        at = ((raw + 1) * (BINS / 3)).astype(int)
        return np.stack([np.bincount(at, w, BINS) for w in (np.ones(len(y)), y, raw)])

    counts = partition_sums(checking, histogram, (3, BINS))
    if counts[0].any():
        some = counts[0] > 0
        model.knots, model.values = isotonic(counts[2, some] / counts[0, some], counts[1, some], counts[0, some])
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, key, score, predicted. The model has a fixed size, whatever the input."""
    parameters = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.concatenate([parameters.value.score(np.frombuffer(b"".join(part)).reshape(len(part), -1)) for part in (column(batch, "x").to_pylist()[i : i + 2000] for i in range(0, batch.num_rows, 2000))])
                yield pa.record_batch({"doc_id": column(batch, "doc_id"), "key": column(batch, "key"), "score": s, "predicted": pa.array((s >= ACCEPT).astype(np.int32))})

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, key long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    stats = cut(with_statistics(docs))
    out = scored(stats, fit(stats, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns. It is fitted to the labelled rows of docs;
    statistics are taken once more where rows are judged, so no text is shuffled. Without labelled rows to fit to, nothing
    is known against any row and all are kept."""
    model = fit(cut(with_statistics(docs)), labels)
    if not model.fitted:
        return docs
    parameters = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(parameters.value.score(statistics(column(part, "text"))) >= ACCEPT))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
