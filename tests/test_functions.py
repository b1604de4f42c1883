"""Column functions: parsing, normal form, order, windows, duals, registration."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from blockprint import api
from blockprint.constants import ALPHABET
from blockprint.functions import blocksize, digests, dual, hashes, plain
from blockprint.queries import TEXTS

A64 = ALPHABET[:32] * 2


def one(spark, column, **values):
    kinds = {k: "string" if isinstance(v, str) or v is None else "long" for k, v in values.items()}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())).select(column.alias("x")).first()
    return row["x"]


LONG_RUNS = [t + s for t, s in (("6:" + "0" * 8 + A64[3:] + ":", ""), ("6:" + A64[:40] + "0" * 8 + A64[43:] + ":", ""), ("6::", "0" * 8 + A64[3:32]), ("6::", A64 + "A"), ("6:" + A64 + "A:", ""), ("6:" + "A" * 200 + ":", ""), ("6::" + A64[:32], "@"), ("6:" + A64, "@"))]


@pytest.mark.parametrize("normalized", [True, False])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("long", [True, False])
def test_parse_equals_plain(spark, normalized, strict, long):
    texts = random.Random(7).sample(TEXTS, 400) + LONG_RUNS + ["3:aaX8v:aV", "3:é:", "é", ":", "3", "3:a\n:", "24576:cSahQzDAOUSGqluqLgJLyT4KgO+bBxB8tGRGdv:c275gJm8zFxfS"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashes.parse("t", long, normalized, strict).alias("p")).collect()
    for t, p in rows:
        want = plain.parse(t, long, normalized, strict)
        got = p.asDict(recursive=True)
        assert {k: got[k] for k in want} == want, t


def test_messages_and_names(spark):
    p = hashes.parse("t")
    assert one(spark, hashes.error_message(p["error"]), t="4::") == "error occurred while parsing a fuzzy hash (block size, at byte offset 0): block size is not valid"
    assert one(spark, p["file_name"], t='3::a,"x,y"') == "x,y"
    assert one(spark, p, t=None) is None


def test_normalize(spark):
    h = hashes.parse("t", normalized=False)["hash"]
    text = "3:ABBCCCDDDDEEEEE:555554444333221"
    assert one(spark, hashes.to_string(hashes.normalize(h)), t=text) == "3:ABBCCCDDDEEE:555444333221"
    assert one(spark, hashes.is_normalized(h), t=text) is False
    assert one(spark, hashes.is_valid(h, normalized=True), t=text) is False
    assert one(spark, hashes.is_valid(h), t=text) is True


def test_order(spark):
    ordered = ["ABBR", "ABBRA", "ABBRAA", "ABBREVIATES", "abbr", "abbrA", "abbrAA", "abbreviates", "0123", "0123A", "0123AA", "01234567"]
    texts = [f"3:{x}:" for x in ordered] + [f"{s}:{x}:" for s in (6, 12, 6144, 12288) for x in "az"]
    shuffled = random.Random(1).sample(texts, len(texts))
    rows = spark.createDataFrame([(t,) for t in shuffled], "t string").withColumn("h", hashes.parse("t")["hash"])
    assert [r["t"] for r in rows.orderBy(hashes.sort_key("h")).collect()] == texts


def test_windows(spark):
    vector = "".join(ALPHABET[(x * 0xCB + 0x66) % 64] for x in range(20))
    numbers = one(spark, hashes.index_windows("b", F.lit(5)), b=vector)
    assert numbers == [sum(ALPHABET.index(c) << 6 * (6 - k) for k, c in enumerate(vector[i : i + 7])) + (5 << 42) for i in range(14)]
    assert one(spark, hashes.windows("b"), b="ABCDEF") == []
    assert one(spark, hashes.index_windows("b", F.lit(31)), b="AAAAAAA") == [31 << 42]


def test_conversions(spark):
    h = hashes.parse("t", long=True, normalized=False)["hash"]
    fits, not_ = f"3:{A64}:{A64[:32]}", f"3:{A64}:{A64[:33]}"
    assert one(spark, hashes.to_short(h)["error"], t=fits) is None
    assert one(spark, hashes.to_short(h)["error"], t=not_) == "BlockHashOverflow"
    assert one(spark, hashes.to_string(hashes.empty()), t="") == "3::"
    assert one(spark, hashes.digest(31, F.lit(""), F.lit("")), t="") is None
    assert one(spark, hashes.from_block_size(F.lit(12), F.lit("ab"), F.lit("")), t="").asDict() == {"log_block_size": 2, "bh1": "ab", "bh2": ""}
    assert one(spark, hashes.base64_index("t"), t="/") == 63 and one(spark, hashes.base64_index("t"), t="@") == 64


def test_block_sizes(spark):
    assert [one(spark, blocksize.log_for_input_size("n"), n=n) for n in (0, 192, 193, 384, 385, 192 << 30)] == [0, 0, 1, 1, 2, 30]
    assert one(spark, blocksize.log_for_input_size("n", 3), n=5) == 3


@pytest.mark.parametrize("long", [True, False])
def test_dual(spark, long):
    rng, size = random.Random(5), 64 if long else 32
    texts = ["12288:+yUwldx+C5IxJ845HYV5sxOH/cccccccex:+glvav84a5sxK", "3::", "3:" + "A" * 64 + ":" + "B" * size]
    for _ in range(60):
        bh = lambda n: "".join(rng.choice("AB") * rng.choice([1, 2, 3, 4, 5, 9, 20]) for _ in range(20))[: rng.randint(0, n)]
        texts.append(f"{3 << rng.randint(0, 30)}:{bh(64)}:{bh(size)}")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("d", dual.parse("t", long)["dual"])
    for r in rows.select("t", dual.to_raw_string("d").alias("raw"), dual.to_normalized_string("d").alias("norm"), dual.is_valid("d", long).alias("ok"), F.octet_length(F.col("d.rle2")).alias("n")).collect():
        assert r["raw"] == r["t"] and r["ok"] and r["n"] == size // 4
        assert r["norm"] == plain.normalize(r["t"])
    assert dual.compress_block_hash("A" * 12, 64) == ("AAA", bytes([2 | 3 << 6, 2 | 3 << 6, 2]).ljust(16, b"\0"))
    assert not dual.valid_rle("ABC", bytes([2]).ljust(16, b"\0"), 64)
    assert not dual.valid_rle("AAA", bytes([2, 2]).ljust(16, b"\0"), 64)
    assert not dual.valid_rle("AAA", bytes([0, 2]).ljust(16, b"\0"), 64)


def test_native_forms_equal_kernels(spark):
    rng = random.Random(9)
    bh = lambda: "".join(rng.choice("ABC") for _ in range(rng.randint(0, 30)))
    rows = spark.createDataFrame([(bh(), bh()) for _ in range(40)], "a string, b string")
    for r in rows.select(digests.edit_distance("a", "b").alias("x"), digests.edit_distance_native("a", "b").alias("y")).collect():
        assert r["x"] == r["y"]


def test_native_forms_of_full_block_hashes(spark):
    """Places up to the 64th, all characters, empty and null; in seconds, as nothing is computed again in each step."""
    rng = random.Random(10)
    bh = lambda: "".join(rng.choice(ALPHABET[: rng.choice([2, 8, 64])]) for _ in range(rng.choice([0, 1, 63, 64, 64, 64])))
    some = [(bh(), bh()) for _ in range(3000)] + [("A" * 64, "A" * 64), ("A" * 64, "B" * 64), ("A-", "-A"), (None, "A"), ("A", None)]
    rows = spark.createDataFrame(some, "a string, b string").repartition(4).cache()
    began = time.perf_counter()
    got = rows.select("a", "b", digests.edit_distance("a", "b").alias("x"), digests.edit_distance_native("a", "b").alias("y"), digests.position_array("a").alias("p")).collect()
    for r in got:
        assert r["y"] == (None if r["a"] is None or r["b"] is None else r["x"])
        bits = [sum(1 << i for i, c in enumerate(r["a"] or "") if c == ch) for ch in ALPHABET]
        assert [x & (1 << 64) - 1 for x in r["p"]] == bits
    assert time.perf_counter() - began < 30


def test_checked_digests(spark):
    data = F.lit("Hello, World!\n")
    assert one(spark, digests.digest_checked(data, F.lit(14)), t="")["error"] is None
    assert one(spark, digests.digest_checked(data, F.lit(15)), t="")["error"] == "FixedSizeMismatch"
    assert one(spark, digests.digest_checked(data, F.lit((192 << 30) + 1)), t="")["error"] == "FixedSizeTooLarge"
    long = F.lit("00NQe2z" * 54)
    assert one(spark, digests.digest_checked(long, truncate=False), t="")["error"] == "OutputOverflow"
    assert one(spark, digests.digest_checked(long, truncate=False, long=True), t="")["error"] is None
    assert one(spark, digests.digest("t"), t=None) is None


def test_piece_counts(spark, tmp_path):
    """Levels of texts in rows of a table, without a shuffle of their bytes."""
    from blockprint import queries
    from blockprint.plans.relational import SPARK, trigger_counts_sql

    rows = spark.createDataFrame([(1, "abc def " * 300), (2, ""), (3, None), (4, "\u00e9" * 50), (5, "abc def " * 300)], "doc_id long, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.trigger_counts(spark, str(tmp_path))
    want = spark.sql(trigger_counts_sql(SPARK, "{rows}", "doc_id", "text"), rows=rows).collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 2
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_position_array(spark):
    bits = one(spark, digests.position_array("b"), b="AB/A")
    assert bits[0] == 0b1001 and bits[1] == 0b10 and bits[63] == 0b100 and sum(bits) == 0b1111


def test_sql_functions(spark):
    api.register(spark)
    r = spark.sql("SELECT ctph_digest('Hello, World!\\n') AS d, ctph_compare('3::', '3::') AS c, ctph_normalize('3:AAAAA:') AS n, ctph_parse('4::') AS p, size(ctph_windows('3:ABCDEFGH:')) AS w").first()
    assert r["d"].asDict() == {"log_block_size": 0, "bh1": "aaX8v", "bh2": "aV"}
    assert r["c"]["score"] == 100 and r["n"] == "3:AAA:" and r["p"]["error"]["kind"] == "BlockSizeIsInvalid" and r["w"] == 2
    assert spark.sql("SELECT count(*) FROM ctph_index('3:ABCDEFGH:')").first()[0] == 2


def test_sizes_of_very_many_digits(spark):
    from blockprint.functions import plain

    text = "9" * 5000 + "::"
    assert plain.parse(text)["error"]["kind"] == "BlockSizeIsTooLarge" and plain.compare(text, "3::")["side"] == "Left" and plain.index_keys(text) is None
    assert spark.createDataFrame([(text,)], "t string").select(hashes.parse("t")["error"]["kind"]).first()[0] == "BlockSizeIsTooLarge"
