"""Joins, clusters, chunks, sources and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from blockprint import queries
from blockprint.functions import digests, hashes
from blockprint.operators import chunks, joins, sets
from blockprint.operators.components import components
from blockprint.plans.relational import SPARK, digest_sql
from blockprint.sources import files
from blockprint.streaming import digests as streaming


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(1500)) for _ in range(8)]
    texts = [b[: rng.randint(600, 1500)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) for b in base for _ in range(4)]
    texts += [texts[0], texts[0], "", "short", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return rows.withColumn("digest", digests.digest("text")).cache()


def brute_force(df, threshold=1):
    """similarity_join() of one set by comparing all pairs."""
    a = df.select(F.col("id").alias("left"), hashes.normalize("digest").alias("ha"))
    b = df.select(F.col("id").alias("right"), hashes.normalize("digest").alias("hb"))
    return a.crossJoin(b).where("left < right").select("left", "right", digests.score("ha", "hb", normalized=True).alias("score")).where(F.col("score") >= threshold)


def brute_force_candidates(df):
    a = df.select(F.col("id").alias("left"), hashes.normalize("digest").alias("ha"))
    b = df.select(F.col("id").alias("right"), hashes.normalize("digest").alias("hb"))
    return a.crossJoin(b).where("left < right").where(digests.is_candidate("ha", "hb")).select("left", "right")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_joins_equal_brute_force(corpus):
    assert rows(joins.candidate_pairs(corpus)) == rows(brute_force_candidates(corpus))
    for threshold in (1, 50, 100):
        assert rows(joins.similarity_join(corpus, threshold=threshold)) == rows(brute_force(corpus, threshold))
    few = corpus.where("id < 5")
    both = rows(joins.one_against_many(few, corpus))
    again = {(a, b, s) for a, b, s in rows(brute_force(corpus))}
    assert {(a, b) for a, b, _ in both if a < b} == {(a, b) for a, b, _ in again if a < 5}
    assert all(s == 100 for a, b, s in both if a == b)


def test_top_matches(corpus):
    best = joins.top_matches(corpus, corpus, 2).collect()
    every = brute_force(corpus).collect()
    want = {}
    for a, b, s in [*every, *((b, a, s) for a, b, s in every)]:
        want.setdefault(a, []).append((-s, b))
    assert {(r["left"], r["right"], r["rank"]) for r in best} == {(a, b, i + 1) for a, m in want.items() for i, (_, b) in enumerate(sorted(m)[:2])}


def test_top_matches_of_many_equal_digests(spark):
    """20,000 rows of one digest give k rows each, not their square."""
    h = F.struct(F.lit(0).alias("log_block_size"), F.lit("abcdefgh").alias("bh1"), F.lit("ijklmnop").alias("bh2"))
    other = F.struct(F.lit(0).alias("log_block_size"), F.lit("abcdefgx").alias("bh1"), F.lit("zz").alias("bh2"))
    df = spark.range(20_000).select("id", h.alias("digest")).union(spark.range(20_000, 20_002).select("id", other.alias("digest")))
    got = joins.top_matches(df, df, 2).groupBy("right", "rank").count().collect()
    best = {(r["right"], r["rank"]): r["count"] for r in got}
    assert best[0, 1] == 19_999 and best[1, 1] == 1 and best[1, 2] == 19_998 and sum(best.values()) == 2 * 20_002


def test_semi_and_anti(corpus):
    other = corpus.where("id in (0, 34)")
    found = {b for _, b, _ in joins.one_against_many(other, corpus).collect()}
    assert {r["id"] for r in joins.with_match(corpus, other).collect()} == found
    assert {r["id"] for r in joins.with_match(corpus, other, negate=True).collect()} == {r["id"] for r in corpus.collect()} - found


@pytest.mark.parametrize("threshold", [1, 60])
def test_clusters(corpus, threshold):
    parent = {r["id"]: r["id"] for r in corpus.collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in brute_force(corpus, threshold).collect():
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert dict(map(tuple, joins.clusters(corpus, threshold).collect())) == {x: root(x) for x in parent}


def test_components_of_a_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(links.where("false")).count() == 0


def test_relational_digest(corpus, spark):
    for long in (False, True):
        sql = digest_sql(SPARK, "{docs}", "id", "text", long, "text is not null")
        h = F.struct("log_block_size", "bh1", "bh2")
        got = spark.sql(sql, docs=corpus.select("id", "text")).select("id", hashes.to_string(h))
        assert rows(got) == rows(corpus.where("text is not null").select("id", hashes.to_string(digests.digest("text", long))))


def test_relational_digest_of_odd_bytes(spark):
    """Steps of bytes that end in pieces, bytes of all values, zeros and null; no row of single bytes is shuffled."""
    rng = random.Random(6)
    data = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 6, 7, 4095, 4096, 4097, 9000)]
    data += [bytes(5000), b"\xff" * 300, b"ab" * 3000 + bytes(7), b"ab" * 3000 + bytes(6), bytes(3) + b"abc" * 900]
    rows = spark.createDataFrame([*enumerate(map(bytearray, data)), (99, None)], "id int, data binary")
    for long in (False, True):
        got = spark.sql(digest_sql(SPARK, "{rows}", "id", "data", long), rows=rows)
        want = {r["id"]: r["d"] or "3::" for r in rows.select("id", hashes.to_string(digests.digest("data", long)).alias("d")).collect()}
        assert {r["id"]: f"{3 << r['log_block_size']}:{r['bh1']}:{r['bh2']}" for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_chunks(corpus, spark):
    cut = [(r["id"], i, r["text"][i * 70 : i * 70 + 70].encode()) for r in corpus.where("text is not null").collect() for i in range(len(r["text"]) // 70 + 1)]
    random.Random(2).shuffle(cut)
    pieces = spark.createDataFrame(cut, "id long, seq long, chunk binary")
    assert rows(chunks.digest_chunks(pieces, "id", "seq", "chunk").select("id", hashes.to_string("digest"))) == rows(corpus.where("text is not null").select("id", hashes.to_string("digest")))


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"Hello, World!\n")
    (folder / "b.bin").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.hash_files(spark, str(folder)).collect()}
    assert got["a.txt"]["digest"]["bh1"] == "aaX8v" and got["b.bin"]["digest"].asDict() == {"log_block_size": 0, "bh1": "", "bh2": ""}
    out = str(tmp_path / "list")
    files.write_hashes(files.hash_files(spark, str(folder)).withColumn("name", F.element_at(F.split("path", "/"), -1)), out, file_name="name")
    (tmp_path / "list" / "more.txt").write_text("# comment\n\n4::\n")
    read = {r["text"]: r for r in files.read_hashes(spark, out).collect()}
    assert read['3:aaX8v:aV,"a.txt"']["file_name"] == "a.txt" and read["4::"]["error"]["kind"] == "BlockSizeIsInvalid" and len(read) == 3


def test_streams(spark, tmp_path):
    parts = [[("a", 1, b"World!\n", True), ("b", 0, b"x" * 5000, False)], [("a", 0, b"Hello, ", False), ("b", 0, b"late", False)], [("b", 1, b"y" * 300, True)]]
    schema = "id string, seq long, chunk binary, is_last boolean"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.digest_chunks(stream).writeStream.format("memory").queryName("chunked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: r for r in spark.table("chunked").collect()}
    assert (got["a"]["bh1"], got["a"]["bh2"], got["a"]["complete"]) == ("aaX8v", "aV", True)
    want = spark.range(1).select(digests.digest(F.lit("x" * 5000 + "y" * 300)).alias("d")).first()["d"]
    assert (got["b"]["log_block_size"], got["b"]["bh1"], got["b"]["bh2"]) == tuple(want)


def test_stream_meets_table(spark, tmp_path, corpus):
    known = corpus.where("id between 0 and 3").select("id", "digest")
    corpus.where("text is not null").select("id", "text").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    streaming.match_records(stream, known, "text").writeStream.format("memory").queryName("matched").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.table("matched").collect()}
    want = {(a, b, s) for b, a, s in map(tuple, joins.one_against_many(known, corpus).collect())}
    assert got == want


def test_streams_of_tables_in_folders(spark, tmp_path, corpus):
    """A table may be a folder of files."""
    folder = str(tmp_path)
    docs = corpus.where("text is not null").select(F.col("id").alias("doc_id"), "text")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    corpus.where("id in (0, 5)").select(F.col("id").alias("item_id"), "text").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    want = {(r["doc_id"], r["item_id"], r["score"]) for r in queries.benchmark_overlap(spark, folder).collect()}
    assert {tuple(r) for r in queries.streamed_matches(spark, folder).collect()} == want and len(want) > 2
    got = {int(r["id"]): r["digest"] for r in queries.streamed_digest(spark, folder).collect()}
    assert got == {r["id"]: r["d"] for r in corpus.where("text is not null").select("id", hashes.to_string("digest").alias("d")).collect()}


def test_sets(spark):
    read = lambda *texts: spark.createDataFrame([(t,) for t in texts], "t string").select(hashes.parse("t", normalized=False)["hash"].alias("digest"))
    a, b = read("3:AAAAA:", "3:AAA:", "6:b:c", None), read("3:AAAA:", "12::")
    shown = lambda df: sorted(r[0] for r in df.select(hashes.to_string("digest")).collect())
    assert shown(sets.distinct(a)) == ["3:AAA:", "6:b:c"]
    assert shown(sets.union(a, b)) == ["12::", "3:AAA:", "6:b:c"]
    assert shown(sets.intersect(a, b)) == ["3:AAA:"] and shown(sets.subtract(a, b)) == ["6:b:c"]


def test_large_files(spark, tmp_path):
    data = b"".join(bytes([i % 251]) * (i % 13) for i in range(20000))
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / "a.bin"),), (f"file://{tmp_path}/b.bin",), (None,)], "path string")
    got = {r["length"]: r["digest"] for r in files.hash_large_files(paths, buffer=1000).collect()}
    want = spark.createDataFrame([(data,)], "d binary").select(digests.digest("d").alias("h")).first()["h"]
    assert got == {len(data): want, 0: got[0]} and tuple(got[0]) == (0, "", "")


def test_inputs_that_are_too_large(spark, tmp_path, monkeypatch):
    """A stream or file of more bytes than digests are for has an error; the others their digests."""
    from blockprint.functions import incremental

    state = incremental.StreamDigest()
    state.update(b"abc")
    state.size = (192 << 30) + 1
    assert state.error == "InputSizeTooLarge"
    with pytest.raises(ValueError):
        state.digest()
    monkeypatch.setattr(incremental, "MAX_INPUT_SIZE", 5000)
    monkeypatch.setattr(chunks, "HELD_BYTES", 1000)
    pieces = spark.createDataFrame([(i, k, b"abcdefg" * 100) for i in range(3) for k in range(4 * i + 1)] + [(9, 0, None), (8, 0, b"")], "id long, seq long, chunk binary").repartition(1)
    out = chunks._in_order(pieces, "id", "seq", "chunk").count()
    assert out == 1 + 5 + 9 + 2
    names = files.write_files(spark.createDataFrame([("a", "text"), ("b", None)], "name string, data string"), f"file://{tmp_path}/f", "name", "data")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.hash_large_files(names).collect()}
    assert got["b"]["length"] == 0 and got["a"]["length"] == 4 and got["a"]["error"] is None


def test_chunks_of_long_streams(spark, monkeypatch):
    """Streams that are longer than what is held go through a state, shorter ones through the kernel; both agree."""
    monkeypatch.setattr(chunks, "HELD_BYTES", 300)
    rng = random.Random(9)
    texts = {i: bytes(rng.choice(b"abcdefgh") for _ in range(rng.choice([0, 10, 299, 1500, 6000]))) for i in range(20)}
    pieces = [(i, k, t[a : a + 97] or None) for i, t in texts.items() for k, a in enumerate(range(0, len(t) + 1, 97))]
    got = {r["id"]: r for r in chunks.digest_chunks(spark.createDataFrame(pieces, "id long, seq long, chunk binary"), "id", "seq", "chunk").collect()}
    want = spark.createDataFrame(list(texts.items()), "id long, data binary").select("id", digests.digest("data").alias("h")).collect()
    assert {i: tuple(r["digest"]) for i, r in got.items()} == {r["id"]: tuple(r["h"]) for r in want} and not any(r["error"] for r in got.values())
    assert chunks.digest_chunks(spark.createDataFrame([], "id long, seq long, chunk binary"), "id", "seq", "chunk").count() == 0
    ends = {r["id"]: r for r in chunks.prefix_digests(spark.createDataFrame(pieces, "id long, seq long, chunk binary"), "id", "seq", "chunk").collect() if r["n_bytes"] == len(texts[r["id"]])}
    assert {i: tuple(r["digest"]) for i, r in ends.items()} == {r["id"]: tuple(r["h"]) for r in want}


def test_prefixes_of_short_and_long_streams(spark, monkeypatch):
    """Short streams need no state; those that grow beyond PREFIX_BYTES go on with one."""
    rng = random.Random(12)
    chunk = lambda: bytes(rng.choice(b"abcd ") for _ in range(rng.choice([0, 1, 70, 400])))
    pieces = [(i, k, chunk() or None) for i in range(12) for k in range(rng.choice([1, 3, 12]))]
    whole = [(i, k + 1, b"".join(c or b"" for j, n, c in pieces if j == i and n <= k)) for i, k, _ in pieces]
    want = {(r["id"], r["place"]): (len(r["data"]), tuple(r["h"])) for r in spark.createDataFrame(whole, "id long, place long, data binary").select("*", digests.digest("data").alias("h")).collect()}
    rows = spark.createDataFrame(pieces, "id long, seq long, chunk binary")
    found = lambda: {(r["id"], r["place"]): (r["n_bytes"], tuple(r["digest"])) for r in chunks.prefix_digests(rows, "id", "seq", "chunk").collect()}
    with monkeypatch.context() as m:
        m.setattr(chunks, "PREFIX_BYTES", 500)
        assert found() == want
    monkeypatch.setattr(chunks, "StreamDigest", None)
    assert found() == want


def test_streams_that_come_at_once_need_no_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "StreamDigest", None)
    texts = {"a": b"Hello, World!\n", "b": b"xy" * 900, "c": b""}
    pieces = [(i, k, t[a : a + 97] or None, a + 97 > len(t)) for i, t in texts.items() for k, a in enumerate(range(0, len(t) + 1, 97))]
    spark.createDataFrame(pieces, "id string, seq long, chunk binary, is_last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, seq long, chunk binary, is_last boolean").parquet(str(tmp_path / "in"))
    streaming.digest_chunks(stream).writeStream.format("memory").queryName("at_once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: (r["n_bytes"], r["log_block_size"], r["bh1"], r["bh2"], r["complete"], r["error"]) for r in spark.table("at_once").collect()}
    want = spark.createDataFrame(list(texts.items()), "id string, data binary").select("id", digests.digest("data").alias("h")).collect()
    assert got == {r["id"]: (len(texts[r["id"]]), *r["h"], True, None) for r in want}
