"""The pipeline's stages on a small corpus, each against what its operator gives."""

from __future__ import annotations

import random
from pathlib import Path

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from blockprint.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        seen.append((name, before, docs.collect()))
    kept = {name: {r["doc_id"] for r in after} for name, _, after in seen}
    _, before, after = seen[1]
    assert kept["n-gram Jaccard join"] == {c for d, _, c, _ in brute.linked([(r["doc_id"], r["text"]) for r in before]) if d == c}
    _, before, after = seen[2]
    removed = {d: n for d, _, n, _, _ in brute.strings([(r["doc_id"], r["text"]) for r in before])}
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in before}
    assert {r["doc_id"] for r in after} == {d for d in sizes if not removed[d] or removed[d] < sizes[d]}
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
    _, before, after = seen[3]
    count = {}
    for r in after:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert max(count.values()) == 2 and set(count) <= {r["doc_id"] for r in before}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == len(after) and entry.queries()["pipeline"](spark, DATA).count() == len(after)


def test_pipeline_of_nothing_and_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(40)), "en", "s", 1), (2, "x y z", "en", "s", 1)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(folder)).write.parquet(str(folder / f"{step}"))
            if step != 0:  # without labels the classifier accepts nothing
                docs = spark.read.parquet(str(folder / f"{step}"))


def test_pipeline_without_labels(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "en", "s", 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() > 0


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
