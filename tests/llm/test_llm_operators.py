"""Each operator against a plain version or a round trip, with nulls, empty and long texts, ties, repeated rows, empty
tables and columns of clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockprint.llm import bpe, jaccard, minimisers, mixing, quality, records, rules, suffixes, superkmers, tiff, warc
from blockprint.llm.common import fresh_folder
from blockprint.llm.queries import tokenizer_path

EXTRA = ", key long, value long, size long, _pattern string, region string, n long, cid long"
NULLS = (None,) * 7


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def texts(seed=1):
    """Documents with copies, near copies, shared passages, repeats, odd white space and extremes."""
    rng = random.Random(seed)
    passage, line = words(rng, 60), "the same line everywhere"
    out = []
    for _ in range(14):
        own = words(rng, rng.randint(20, 200))
        out.append(" ".join(own))
        near = list(own)
        near[len(near) // 2] = "changed"
        out.append(" ".join(near))
        out.append("\n".join(own[: len(own) // 2]) + "\t" + " ".join(passage) + " é " + " ".join(own[len(own) // 2 :]))
    out += [out[0], out[0], out[3].upper(), line + "\n" + line + "\n" + " ".join(words(rng, 30)), " ".join(passage)]
    out += ["", None, None, " \n\t", "one", "One", "a b c d", "a  b c\nd", "x " * 300, "ab" * 200, " ".join(words(rng, 6000)), "é" * 100, "\x00\x01" * 60, "a" * 49, "a" * 50, "a" * 51]
    return out


def documents(spark, values=None, ids=None):
    values = texts() if values is None else values
    ids = list(range(len(values))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", *NULLS) for i, t in zip(ids, values, strict=True)], "doc_id long, text string, lang string, source string" + EXTRA)


def rows(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def ordered(values):
    return sorted(values, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(5).cache()


def empty(docs):
    return docs.where("false")


# ---- 1 -------------------------------------------------------------------------------------------------------------


def linked(docs, **options):
    return rows(jaccard.join(docs, **options), "doc_id", "n_shingles", "component_id")


def test_jaccard_equals_brute_force(docs):
    assert linked(docs) == ordered(r[:3] for r in brute.linked(list(enumerate(texts()))))
    assert linked(empty(docs)) == []


def test_jaccard_repeated_and_null_ids(spark):
    values = [texts()[0], texts()[1], texts()[0], texts()[0], None, "", texts()[6]]
    ids = [7, 7, None, 3, None, 4, None]
    got = linked(documents(spark, values, ids))
    assert got == ordered(brute_components(ids, values))


def brute_components(ids, values):
    return [r[:3] for r in brute.linked(list(zip(ids, values, strict=True)))]


def thue_morse(k, letters="ab"):
    """A word of 2**k letters and its complement, on which hashes by powers modulo 2**64 collide."""
    x = [0]
    for _ in range(k):
        x += [1 - b for b in x]
    return "".join(letters[b] for b in x), "".join(letters[1 - b] for b in x)


def test_jaccard_tells_arranged_words_apart(spark):
    a, b = thue_morse(10)
    many, other = thue_morse(4, ("x ", "y "))
    values = [f"{a} a b c", f"{b} a b c", a, b, many, other, f"{a} a b c"]
    assert linked(documents(spark, values)) == ordered(r[:3] for r in brute.linked(list(enumerate(values))))


def test_jaccard_classes_of_one_short_id(spark, monkeypatch):
    """Sets whose 64-bit ids are equal are told apart by the second hash."""
    plain = jaccard.class_ids
    monkeypatch.setattr(jaccard, "class_ids", lambda h, n, lane=0: plain(h, n, lane) if lane else plain(h, n) % np.uint64(3))
    values = texts()[:12] + texts()[:2] + ["", None]
    pts = jaccard.points(documents(spark, values), np.zeros(0, np.uint64), 80)
    found, classes = jaccard.classes_of(pts)
    assert classes.count() == len({tuple(sorted(brute.shingles(t))) for t in values[:12]}) == found.where("cid is not null").select("cid").distinct().count()


def test_equal_posting_lists_are_compared(monkeypatch):
    posting, at = np.array([0, 1, 0, 1, 2, 3, 0, 1, 5]), np.array([0, 2, 4, 6, 8, 9])
    for hashed in (jaccard.mixed, lambda x: x * np.uint64(0)):  # equal hashes of unlike lists join nothing
        monkeypatch.setattr(jaccard, "mixed", hashed)
        weight, first = jaccard.alike(posting, at)
        assert first.tolist() == [0, 0, 2, 0, 4] and weight[0] == 3 and weight[2] == weight[4] == 1


def near_copies(rng, n, size, most):
    base = words(rng, size, 5000)
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(size)] = f"v{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_jaccard_large_regions(spark, monkeypatch):
    """Regions that are too large for a task are split over the cluster; what no pivots split is joined by blocks."""
    rng = random.Random(8)
    common = " ".join(words(rng, 40))
    values = near_copies(rng, 60, 200, 3) + near_copies(rng, 40, 80, 5) + [common + " " + " ".join(words(rng, 25, 10**6)) for _ in range(30)]
    want = ordered(r[:3] for r in brute.linked(list(enumerate(values))))
    for region, pivots, rounds, copies in ((3000, 4, 3, 2), (3000, 3, 1, 0)):
        monkeypatch.setattr(jaccard, "REGION", region)
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "PIVOT_BYTES", 12000)
        monkeypatch.setattr(jaccard, "MOST_COPIES", copies)
        assert linked(documents(spark, values)) == want


def test_region_join_equals_all_pairs():
    rng = random.Random(3)
    sets = []
    for _ in range(30):
        base = [rng.getrandbits(60) for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(1, 50)):
            s = {x if rng.random() > rng.choice([0.02, 0.1, 0.2]) else rng.getrandbits(60) for x in base}
            sets.append(np.sort(np.array(list(s), np.uint64)))
    region = jaccard.Region(np.arange(len(sets)), sets, 80)
    a, b = region.links()
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    want = [root(i) for i in range(len(sets))]
    got = list(range(len(sets)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        got[x] = y
    assert got == want


def test_cells_keep_pairs_together():
    rng = np.random.default_rng(2)
    points = rng.random((300, 2))
    pivots = points[:10]
    d = np.minimum(np.abs(pivots[:, None] - points[None]).sum(2), 1)
    share = np.stack(jaccard.cells(d, 0.05))
    near = np.argwhere(np.abs(points[:, None] - points[None]).sum(2) <= 0.05)
    assert all((share[:, i] & share[:, j]).any() for i, j in near)


# ---- 2, 6 ----------------------------------------------------------------------------------------------------------


def library_ids(values):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(v or "", add_special_tokens=False).ids for v in values], t


ODD = ["<|endoftext|>a<|endoftext|>", "naïve 🤖🤖 日本語　 test's we'll", "def f(x):\n    return x+1\n\n\n", " lead", "trail ", "ſtraße ÿ½²", "a b  c", "'s 'S don't", "١٢٣ 12", "​"]


def test_bpe_equals_the_library(spark):
    rng = random.Random(2)
    values = texts() + ODD + ["".join(rng.choice("etaoin shr,.THE  \n'sé日1") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    ids, t = library_ids(values)
    got = bpe.encode_documents(documents(spark, values), tokenizer_path(), digests=True).orderBy("doc_id").collect()
    for r, want in zip(got, ids, strict=True):
        raw = np.array(want, "<u4").tobytes()
        assert (bytes(r["ids"]), r["n_tokens"], r["ids_sha256"]) == (raw, len(want), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_documents(spark.createDataFrame(got), tokenizer_path()).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [t.decode(i, skip_special_tokens=False) for i in ids]
    assert bpe.encode_documents(documents(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("start", range(0, 0x20000, 0x8000))
def test_encoders_equal_the_library_on_all_characters(start):
    """Every code point but surrogates, between letters, digits, marks and spaces, by both encoders."""
    points = [c for c in range(start, start + 0x8000) if not 0xD800 <= c < 0xE000]
    values = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2{chr(c)}{chr(c)}.{chr(c)}\n" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    ids, _ = library_ids(values)
    prefix, library = bpe.PrefixBpe(tokenizer_path(), cache=1000), records.library_encoder(tokenizer_path(), 0)
    for text, want in zip(values, ids, strict=True):
        assert np.frombuffer(prefix.encode(text), "<u4").tolist() == want
        assert library(text).tolist() == [*want, 0]


def test_last_tokens_are_unique():
    model = bpe.PrefixBpe(tokenizer_path(), cache=10)
    ids, _ = library_ids([" antidisestablishmentarianism"])
    assert np.frombuffer(model.encode(" antidisestablishmentarianism"), "<u4").tolist() == ids[0]
    for a, b in zip(ids[0], ids[0][1:]):
        assert model.compatible(a, b)
    assert not model.compatible(ord("t") - 33, ord("h") - 33)


def test_token_records(spark):
    values = texts() + ODD
    ids = [3, 3, None, *range(10, 7 + len(values))]
    docs = documents(spark, values, ids)
    folder = fresh_folder(spark, "records")
    files = records.write_ids(docs, folder, tokenizer_path(), end=0)
    got = records.placed(files).orderBy("start").collect()
    want, _ = library_ids(values)
    by_id = {}
    for d, i in zip(ids, want, strict=True):
        by_id.setdefault(d, []).append([*i, 0])
    start = 0
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda d: (d is not None, d or 0))
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in by_id[r["doc_id"]]]
    assert records.written_and_read(spark, documents(spark, []), fresh_folder(spark, "none"), tokenizer_path()).count() == 0
    assert records.read_ids(files).count() == len(values)


def test_records_notice_damage():
    frames = records.frames([records.packed(5, np.arange(9), 2), records.packed(None, np.arange(1 << 17, (1 << 17) + 3), 4)])
    data, offsets = b"".join(frames), [0, len(frames[0])]
    a, b = map(records.unpacked, records.unframed(data, offsets))
    assert a[0] == 5 and a[1].tolist() == list(range(9)) and b[0] is None and b[1].tolist() == [1 << 17, (1 << 17) + 1, (1 << 17) + 2]
    for at in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframed(bytes(bad), offsets)
    with pytest.raises(ValueError):
        records.unframed(data[:-3], offsets)
    assert records.crc32c_many([b"123456789", b"", b"x" * 1000]) [:2] == [0xE3069283, 0]


# ---- 3, 7 ----------------------------------------------------------------------------------------------------------


def corpus(spark, n=600):
    rng = random.Random(6)
    values, good = [], []
    for i in range(n):
        own = words(rng, rng.randint(30, 120))
        kind = i % 4
        if kind == 0:
            own = [w for w in own[:20] for _ in range(6)]
        elif kind == 1:
            own = [w.upper() + "!!" for w in own]
        values.append(". ".join(" ".join(own[k : k + 9]) for k in range(0, len(own), 9)))
        good.append(int(kind > 1))
    return documents(spark, values), spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int"), good


def test_quality_held_out(spark):
    docs, labels, good = corpus(spark)
    out = quality.classify(docs, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert [r["held_out"] for r in out] == [zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out]
    assert len(held) > 80 and sum(r["predicted"] == good[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    # Held-out labels are not learned from.
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r["doc_id"], r["score"]) for r in quality.classify(docs, turned).collect()} == {(r["doc_id"], r["score"]) for r in out}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if r["predicted"]}


def test_quality_equals_plain_fit(spark):
    """Statistics, ridge and calibration against plain versions over all rows at once, whatever the partitions."""
    docs, labels, good = corpus(spark, 300)
    odd = documents(spark, texts(), range(1000, 1000 + len(texts())))
    both = docs.union(odd)
    values = {r["doc_id"]: r["text"] for r in both.collect()}
    ids = sorted(values)
    plain = np.array([brute.statistics(values[i]) for i in ids])
    assert np.allclose(quality.statistics(pa.array([values[i] for i in ids])), plain, atol=1e-12)
    want = brute.classifier([(i, good[i] if i < 300 else None) for i in ids], plain)
    got = rows(quality.classify(both, labels), "doc_id", "score")
    assert np.allclose([s for _, s in got], want, atol=1e-6)
    assert rows(quality.classify(both.repartition(3), labels), "doc_id", "score") == got == rows(quality.classify(both.repartition(7), labels.repartition(3)), "doc_id", "score")
    # A document with two labels is learned from twice.
    twice = labels.union(labels.where("doc_id = 5"))
    assert quality.classify(both, twice).count() == len(ids)


def test_quality_odd_inputs(spark, docs):
    labels = spark.createDataFrame([(1, None, 0), (2, 7, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(texts()) and len({round(r["score"], 2) for r in out}) == 1
    assert quality.classify(empty(docs), labels).count() == 0
    assert quality.classify(documents(spark, ["a b", None], [None, None]), labels).count() == 2


def test_quality_without_labels_keeps_all(spark, docs):
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in range(len(texts()))}
    for labelled in ([], [(i, 0, 0) for i in fold if fold[i] > 1], [(10**6, 1, 0)]):
        kept = quality.accepted(docs, spark.createDataFrame(labelled, "doc_id long, quality int, toxic int"))
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(fold)


def test_isotonic():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 1, 1]), np.ones(4))
    assert x.tolist() == [0.5, 2.5] and y.tolist() == [0.5, 1.0]


def test_rules_counts(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = rows(rules.judge(docs), "doc_id", *names)
    assert got == ordered((i, *brute.rules(t).values()) for i, t in enumerate(texts()))
    assert rules.judge(empty(docs)).count() == 0


def test_rules_bands(spark):
    docs, _, good = corpus(spark, 400)
    rng = random.Random(1)
    noise = [" ".join("".join(chr(rng.randrange(33, 600)) for _ in range(40)) for _ in range(20)) for _ in range(3)]
    both = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "en").alias("lang")).union(documents(spark, noise, [9001, 9002, 9003]).select("doc_id", "text", "lang"))
    out = {r["doc_id"]: r for r in rules.judge(both).collect()}
    assert not any(out[i]["kept"] for i in (9001, 9002, 9003)) and not out[9001]["base_failed"]
    assert all(out[i]["kept"] for i, g in enumerate(good) if g)


def test_rules_bands_letters(spark):
    """Words of few letters (the noise that test_rules_bands had first), and texts of words in a new order."""
    docs, _, good = corpus(spark, 400)
    rng = random.Random(1)
    noise = ["".join(rng.choice("qxzjkvwy#%") for _ in range(400)) + " a b c d e f g h i j k l" for _ in range(3)]
    both = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "en").alias("lang")).union(documents(spark, noise, [9001, 9002, 9003]).select("doc_id", "text", "lang"))
    out = {r["doc_id"]: r for r in rules.judge(both).collect()}
    assert not any(out[i]["kept"] or out[i]["base_failed"] for i in (9001, 9002, 9003))
    assert all(out[i]["kept"] for i, g in enumerate(good) if g)


def test_rules_bands_reject_marked_words(spark):
    """Texts whose words carry symbols pass the counting rules and are rejected by the bands; clean texts stay."""
    rng = random.Random(5)
    values = [" ".join(words(rng, 60)) for _ in range(120)] + [" ".join(w + rng.choice("#$%&*") * 3 for w in words(rng, 60)) for _ in range(4)]
    out = {r["doc_id"]: r for r in rules.judge(documents(spark, values)).collect()}
    assert all(out[i]["kept"] for i in range(120)) and not any(out[i]["kept"] or out[i]["base_failed"] for i in range(120, 124))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_rules_word_model(spark, monkeypatch, order):
    """Bits against plain counting, in several partitions and blocks; sentences keep the order of their words, shuffled ones
    do not."""
    rng = random.Random(3)
    sentences = [words(rng, 8, 300) for _ in range(60)]
    plain = [[w for _ in range(12) for w in rng.choice(sentences)] for _ in range(90)]
    values = [" ".join(t) for t in plain] + [" ".join(rng.sample(t, len(t))) for t in plain[:5]] + [" ".join(plain[0]), None, " ", "one", "x  y\n"]
    monkeypatch.setattr(rules, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(rules, "MARGIN_BITS", 30)
    docs = documents(spark, values).withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "fr").when(F.col("doc_id") % 7 != 0, "en")).repartition(3)
    out = {r["doc_id"]: r for r in rules.judge(docs, order).collect()}
    folds = {r["doc_id"]: (r["text"], r["lang"], r["f"]) for r in docs.withColumn("f", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2))).collect()}
    for i, want in enumerate(brute.bits_a_word([folds[i] for i in range(len(values))], order)):
        assert out[i]["bits"] is None if want is None else abs(out[i]["bits"] - want) < 1e-4, i
    again = {r["doc_id"]: r for r in rules.judge(docs.repartition(5, "doc_id"), order).collect()}
    assert all(again[i]["bits"] == out[i]["bits"] and again[i]["kept"] == out[i]["kept"] for i in out)
    if order > 1:
        assert min(out[90 + i]["bits"] for i in range(5)) > max(out[i]["bits"] for i in range(90)) + 0.3


def test_rules_when_partitions_change(spark, monkeypatch):
    """Answers that belong to other rows are noticed; then the texts are fixed first."""
    docs = documents(spark, [" ".join(words(random.Random(i), 30)) for i in range(40)]).repartition(3)
    want = rows(rules.judge(docs), "doc_id", "bits")
    plain, calls = rules.stored, []

    def mixed_up(found, folder, level, n_tasks):
        calls.append(level)
        other = F.when(F.col("data").isNull(), F.col("part")).otherwise((F.col("part") + 1) % 3)
        return plain(found.withColumn("part", other) if len(calls) == 2 else found, folder, level, n_tasks)

    monkeypatch.setattr(rules, "stored", mixed_up)
    assert rows(rules.judge(docs), "doc_id", "bits") == want and len(calls) > 3


def test_rules_columns_are_packed():
    rng = np.random.default_rng(2)
    for size in (0, 1, 500):
        columns = [np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64)), *(rng.integers(0, most, size) for most in (1, 300, 1 << 40))]
        back = rules.unpacked(rules.packed(columns, True), True)
        assert all(a.tolist() == b.tolist() for a, b in zip(columns, back, strict=True))
        back = rules.unpacked(rules.packed(columns[1:], False), False)
        assert all(a.tolist() == b.tolist() for a, b in zip(columns[1:], back, strict=True))


def test_spelling_sums_to_one():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 103, 4000).astype(np.uint8)
    bounds = np.array([0, 1, 1, 2000, 4000])
    codes, data = rules.trigrams(data, bounds), data.tolist()
    assert codes[0] == (10 << 16 | 10 << 8 | data[0]) and codes[1] == (10 << 16 | 10 << 8 | data[1]) and codes[2] == (10 << 16 | data[1] << 8 | data[2])
    bits = rules.spelling_bits(*np.unique(codes.astype(np.int64), return_counts=True))
    for context in (97 << 8 | 98, 120 << 8 | 97, 5 << 8 | 6):
        assert abs(np.exp2(-bits[context << 8 | np.arange(256)].astype(float)).sum() - 1) < 1e-5


# ---- 4, 9 ----------------------------------------------------------------------------------------------------------


def test_tiff_documents(docs):
    got = {r["doc_id"]: r for r in tiff.media_digests(tiff.store_documents(docs)).collect()}
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    media = {r["doc_id"]: bytes(r["media"]) for r in tiff.store_documents(docs).collect()}
    for i, t in enumerate(texts()):  # a second reader, and features by plain sums
        raw = (t or "").encode()
        pages = brute.tiff(media[i])
        payload = b"".join(p for _, _, p in pages)
        assert payload == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)) and all(w == 64 for w, _, _ in pages)
        assert got[i]["feature"] == brute.tiff_feature(payload, len(pages))
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
    assert got[0]["feature"] == got[42]["feature"] and got[0]["media_sha256"] == got[42]["media_sha256"]
    assert tiff.media_digests(tiff.store_documents(empty(docs))).count() == 0


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, tile, order):
    rng = np.random.default_rng(4)
    pages = [rng.integers(0, 256, (37, 50, 3), dtype=np.uint8), rng.integers(0, 3, (300, 1, 1), dtype=np.uint8), np.zeros((70, 90, 1), np.uint8)]
    for predictor in (1, 2):
        data = tiff.encode_pages(pages, compression, predictor, tile, 32, order)
        assert [p.data for p in tiff.decode_pages(data)] == [p.tobytes() for p in pages]
        for cut in (6, len(data) // 2, len(data) - 9):
            with pytest.raises(ValueError):
                list(tiff.decode_pages(data[:cut]))


def test_tiff_rows_after_a_page_that_is_not_read(spark):
    pages = [np.full((4, 4, 1), k, np.uint8) for k in range(3)]
    data = bytearray(tiff.encode_pages(pages))
    bits = struct.pack("<HHIH", tiff.BITS, 3, 1, 8)
    at = data.index(bits, data.index(bits) + 1)  # the second page's
    data[at : at + len(bits)] = struct.pack("<HHIH", tiff.BITS, 3, 1, 16)
    got = sorted(tiff.read_pages(spark.createDataFrame([(1, bytes(data))], "id long, content binary"), "id", "content").collect(), key=lambda r: r["page"])
    assert [(r["page"], None if r["data"] is None else bytes(r["data"]), r["error"] is None) for r in got] == [(0, pages[0].tobytes(), True), (1, None, False), (2, pages[2].tobytes(), True)]


@pytest.mark.parametrize("tag, kind, value", [(tiff.ROWS_PER_STRIP, 4, 0), (tiff.TILE_WIDTH, 4, 0), (tiff.TILE_HEIGHT, 4, 0), (tiff.WIDTH, 4, 2**31), (tiff.HEIGHT, 4, 2**32 - 1), (tiff.SAMPLES, 3, 0)])
def test_tiff_fields_that_lie(spark, tag, kind, value):
    data = bytearray(tiff.encode_pages([np.ones((40, 40, 1), np.uint8)], tile=16 if tag in (tiff.TILE_WIDTH, tiff.TILE_HEIGHT) else None))
    at = next(i for i in range(8, len(data) - 12) if struct.unpack_from("<HHI", data, i) == (tag, kind, 1))
    data[at + 8 : at + 12] = struct.pack("<I", value)
    none = bytearray(data)
    none[at + 4 : at + 8] = bytes(4)  # a field with no values
    missing = bytearray(data)
    missing[at : at + 2] = struct.pack("<H", 65000)
    files = spark.createDataFrame([(1, bytes(data)), (2, bytes(none)), (3, bytes(missing))], "id long, content binary")
    got = {r["id"]: r for r in tiff.read_pages(files, "id", "content").collect()}
    assert got[1]["error"] and len(got) == 3 and all(r["error"] or len(r["data"]) == 1600 for r in got.values())


def test_tiff_damage_is_an_error_or_a_page():
    rng = np.random.default_rng(3)
    for compression in (tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        good = tiff.encode_pages([rng.integers(0, 4, (30, 20, 1), dtype=np.uint8)], compression, 2)
        for _ in range(300):
            bad = bytearray(good)
            bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
            try:
                list(tiff.decode_pages(bytes(bad)))
            except ValueError:
                pass


def test_tiff_rows(spark):
    good = tiff.encode_pages([np.ones((4, 4, 1), np.uint8)] * 2)
    loop = bytearray(tiff.encode_pages([np.ones((4, 4, 1), np.uint8)]))
    at = int.from_bytes(loop[4:8], "little")
    n = int.from_bytes(loop[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = loop[4:8]
    files = spark.createDataFrame([(1, good), (2, bytes(loop)), (3, b""), (4, None), (5, b"nothing here")], "id long, content binary")
    got = sorted((r["id"], -1 if r["page"] is None else r["page"], r["error"] is None) for r in tiff.read_pages(files, "id", "content").collect())
    assert got == [(1, 0, True), (1, 1, True), (2, -1, False), (2, 0, True), (3, -1, False), (4, -1, False), (5, -1, False)]


def page_rows(spark, rows_):
    return spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1" if i else None, h, "clash") for i, h in rows_], "page_id long, url string, html string, payload_digest string")


def test_warc_round_trip(spark):
    rng = random.Random(3)
    long = "<p>" + " ".join(words(rng, 400)) + "</p>"
    values = [(i, rng.choice([long, long + "x", "short", "", None, "<html>" + " ".join(words(rng, rng.randint(1, 900)))])) for i in range(300)] + [(299, long), (299, long), (None, long), (None, "é" * 600)]
    assert len(values) > warc.SAMPLES
    got = rows(warc.archived_pages(page_rows(spark, values).coalesce(1), fresh_folder(spark, "warc")), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = ordered(brute.archived(values))
    assert got == want and {r[3] for r in got} == {"response", "revisit"}
    assert warc.archived_pages(page_rows(spark, []), fresh_folder(spark, "warc")).count() == 0
    files = warc.write_archives(warc.record_kinds(page_rows(spark, values[:60])), fresh_folder(spark, "warc"))
    back = warc.read_archives(files).where("record_type = 'response'").collect()
    assert all(hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] and "\n" not in (r["url"] or "") for r in back)


def test_warc_page_ids_of_text(spark):
    long = "x" * 1200
    values = [("a b", long), ("none", long), (None, long), ("", long), ("é>\r\n%", "short"), ("z", long), ("10", "short")]
    pages = spark.createDataFrame([(i, None, h) for i, h in values], "page_id string, url string, html string")
    got = rows(warc.archived_pages(pages, fresh_folder(spark, "warc")), "page_id", "record_type", "refers_to")
    assert got == ordered((i, "revisit" if h == long and i != "z" else "response", "z" if h == long and i != "z" else None) for i, h in values)


def test_warc_notices_damage():
    import io

    import zstandard

    digest = hashlib.sha1(b"body").hexdigest()
    good = warc.record("response", "1", "http://x", b"body", 4, digest, None)
    press = zstandard.ZstdCompressor(write_checksum=True)
    samples = [warc.record("response", str(i), None, f"<p>{i * 7919} {i}</p>".encode() * 9, 0, digest, None) for i in range(300)]
    raw = warc.dictionary(samples)
    assert raw
    with_raw = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    read = lambda data: list(warc.read_archive(io.BytesIO(data), "x"))
    data = warc.dictionary_frame(b"") + press.compress(good) * 2
    assert [r["payload"] for r in read(data)] == [b"body"] * 2
    assert read(warc.dictionary_frame(raw) + with_raw.compress(good))[0]["record_id"] == "<urn:page:1>"
    bad = [b"", data[:5], data[:-1], press.compress(good), warc.dictionary_frame(b"") + b"junk" * 9, warc.dictionary_frame(b"") + press.compress(good.replace(b"body", b"bodx")), warc.dictionary_frame(b"") + press.compress(good + b"more")]
    bad += [warc.dictionary_frame(b"") + press.compress(good.replace(a, b)) for a, b in ((b"WARC/1.1", b"WARD/1.1"), (b"Content-Length: 4", b"Content-Length: 5"), (b"WARC-Date", b"WARC-Data"), (b"HTTP/1.1", b"HTTQ/1.1"))]
    for x in bad:
        with pytest.raises(ValueError):
            read(x)


# ---- 5, 8 ----------------------------------------------------------------------------------------------------------


def test_strings_equal_brute_force(docs):
    got = rows(suffixes.drop_repeated_strings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == ordered(brute.strings(list(enumerate(texts()))))
    assert suffixes.drop_repeated_strings(empty(docs)).count() == 0


def test_strings_repeated_and_null_ids(spark):
    values = [texts()[0], texts()[2], texts()[5], texts()[0], texts()[0], texts()[1], None, texts()[8]]
    ids = [5, 5, 2, None, 5, 9, None, None]
    docs = documents(spark, values, ids)
    got = rows(suffixes.drop_repeated_strings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == ordered(brute.strings(list(zip(ids, values, strict=True))))
    kept = suffixes.drop_repeated_strings(docs, keep_text=True)
    assert kept.select("rest.*").columns == ["lang", "source", "key", "value", "size", "_pattern", "region", "n", "cid"]
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in kept.where("text is not null").collect() if r["n_removed"] == 0 or r["text"].isascii())


def test_strings_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 300)
    docs = documents(spark)
    values = list(enumerate(texts()))
    shards = suffixes.Shards(20)
    # One value, many shards: each row is a document's stretch.
    rng = random.Random(5)
    stretches = [bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 60))) for _ in range(60)]
    found = {}
    for i in range(0, 60, 7):
        part = stretches[i : i + 7]
        table = pa.table({"value": pa.array([1] * len(part), pa.int64()), "doc_id": pa.array(range(i, i + len(part)), pa.int64()), "key": pa.array([0] * len(part), pa.int64()), "start": pa.array([0] * len(part), pa.int32()), "n": pa.array([len(s) - 19 for s in part], pa.int32()), "bytes": pa.array(part, pa.binary())})
        out = shards.add(table)
        for r in out.to_pylist() if out is not None else []:
            found.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n"]))
    seen = {}
    for d, s in enumerate(stretches):
        mine = {k for k in range(len(s) - 19) if seen.get(s[k : k + 20], d) < d}
        assert found.get(d, set()) == mine
        for k in range(len(s) - 19):
            seen.setdefault(s[k : k + 20], d)
    assert rows(suffixes.drop_repeated_strings(docs), "doc_id", "n_removed") == ordered((r[0], r[2]) for r in brute.strings(values))


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for t in range(120):
        d = rng.integers(0, [2, 3, 256][t % 3], int(rng.integers(0, 300))).astype(np.uint8)
        d = np.tile(d[:7], 60)[: len(d)] if t % 5 == 0 else d
        order, rank = suffixes.suffix_array(d)
        raw = d.tobytes()
        assert order.tolist() == sorted(range(len(d)), key=lambda i: raw[i:])
        assert (rank[order] == np.arange(len(d))).all()
        for i, n in enumerate(suffixes.common_prefixes(d, order, rank, 50)[1:].tolist(), 1):
            a, b = raw[order[i] :], raw[order[i - 1] :]
            assert n == next((k for k in range(min(50, len(a), len(b))) if a[k] != b[k]), min(50, len(a), len(b)))


@pytest.mark.parametrize("kinds", [1, 3, 2**62])
def test_strings_of_equal_hashes_are_compared(kinds):
    """Whatever the hashes, a string's smallest document is one that has its bytes."""
    rng = np.random.default_rng(kinds % 7)
    raw = [bytes(rng.integers(97, 99, 40, dtype=np.uint8)) * 2 for _ in range(6)] + [thue_morse(6)[0].encode(), thue_morse(6)[1].encode()]
    data, length = np.frombuffer(b"".join(raw), np.uint8), 10
    ends = np.cumsum([len(r) for r in raw])
    at = np.concatenate([np.arange(e - len(r), e - length + 1) for e, r in zip(ends, raw, strict=True)])
    ids = rng.permutation(len(raw))
    doc = ids[np.searchsorted(ends, at, "right")]
    string = [data[i : i + length].tobytes() for i in at]
    hashes = np.array([hash(s) % kinds for s in string], np.int64).view(np.uint64)
    found = suffixes.smallest_documents(data, at, hashes, doc, length)
    having = {}
    for s, d in zip(string, doc.tolist(), strict=True):
        having.setdefault(s, set()).add(d)
    assert all(f in having[s] and f <= d for f, s, d in zip(found.tolist(), string, doc.tolist(), strict=True))
    if kinds == 2**62:
        assert found.tolist() == [min(having[s]) for s in string]


def test_windows_equal_brute_force(docs):
    got = rows(superkmers.drop_repeated_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered(brute.windows(list(enumerate(texts()))))
    assert superkmers.drop_repeated_windows(empty(docs)).count() == 0


def test_windows_tell_arranged_words_apart(spark):
    a, b = thue_morse(10)
    rest = " ".join(f"w{i}" for i in range(34))
    many, other = thue_morse(6, ("x ", "y "))
    values = [f"{a} {rest}", f"{b} {rest}", many[:70], other[:70], f"{many}{rest}", f"{other}{rest}"]
    got = rows(superkmers.drop_repeated_windows(documents(spark, values)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered(brute.windows(list(enumerate(values))))


def test_windows_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "PIECE", 200)
    period = " ".join(["alpha beta"] * 40)
    values = [texts()[0], texts()[2], texts()[5], texts()[0], None, "Des. " * 40, period, texts()[8] + " " + texts()[8], texts()[1]]
    ids = [5, 5, None, None, None, 8, 9, 10, 11]
    got = rows(superkmers.drop_repeated_windows(documents(spark, values, ids)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered(brute.windows(list(zip(ids, values, strict=True))))


@pytest.mark.parametrize("ids", [[None, None, 3], [7, 7, 3], [None, 7, 3]])
def test_windows_shared_by_rows_of_one_id(spark, ids):
    """Two rows with one id, or none, that alone share a passage."""
    rng = random.Random(8)
    passage = words(rng, 50, 10**6)
    values = [" ".join(words(rng, 40, 10**6) + passage + words(rng, 30, 10**6)), " ".join(passage + words(rng, 60, 10**6)), " ".join(words(rng, 90, 10**6))]
    got = rows(superkmers.drop_repeated_windows(documents(spark, values, ids)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered(brute.windows(list(zip(ids, values, strict=True)))) and sum(r[2] for r in got) == 100


def test_values_that_one_document_has_are_dropped(spark):
    values = spark.createDataFrame([(1, 5, False), (2, 5, False), (3, 6, False), (4, 7, True), (None, 8, False), (9, 8, False)] + [(i, 99, False) for i in range(50)], "doc_id long, value long, twice boolean")
    assert rows(minimisers.shared_values(values, within=True), "value").count((99,)) == 50
    assert {r[0] for r in rows(minimisers.shared_values(values, within=True), "value")} == {5, 7, 8, 99}
    assert {r[0] for r in rows(minimisers.shared_values(values, within=False), "value")} == {5, 8, 99}


# ---- 10 ------------------------------------------------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(2)
    values = [(i, " ".join(words(rng, rng.randint(0, 60))) if i % 17 else None, None, rng.choice(["a", "b", "é", "Z", None, "a"])) for i in range(800)]
    docs = spark.createDataFrame([(i, t, s, *NULLS) for i, t, _, s in values], "doc_id long, text string, source string" + EXTRA)
    out = mixing.mixed_documents(docs).collect()
    size = {i: len(brute.WORD.findall(t or "")) for i, t, _, _ in values}
    of = {s: [i for i, _, _, x in values if x == s] for s in {x for *_, x in values}}
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, targets, free = 1.5 * sum(size.values()), {}, list(names)
    while free:
        unit = total / sum(weights[s] for s in free)
        over = [s for s in free if unit * weights[s] > 2 * sum(size[i] for i in of[s])]
        for s in over or free:
            targets[s] = 2.0 * sum(size[i] for i in of[s]) if over else unit * weights[s]
            total -= targets[s]
        free = [s for s in free if s not in over] if over else []
    source = {i: s for i, _, _, s in values}
    taken = dict.fromkeys(names, 0)
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sum(size[i] for i in of[s]) and abs(r["target"] - targets[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(out) == 800 and all(abs(taken[s] - targets[s]) <= 61 for s in names)
    assert sorted(out) == sorted(mixing.mixed_documents(docs.repartition(7)).collect())
    assert mixing.mixed_documents(docs.where("false")).count() == 0
    assert mixing.mixed_documents(docs.where("text is null")).where("taken > 0").count() == 0


def test_flow_of_overlapping_sources():
    # Of two patterns one belongs to both sources; the flow meets both quotas and repeats no word that it need not.
    flow = mixing.min_cost_flow([100, 100], [[0, 1], [0]], [100, 100], 2)
    assert flow == [{1: 100}, {0: 100}]
    assert mixing.min_cost_flow([10], [[0]], [100], 2) == [{0: 20}]
    flow = mixing.min_cost_flow([50, 50], [[0, 1], [1]], [80, 40], 2)
    assert sum(f.get(0, 0) for f in flow) == 80 and sum(f.get(1, 0) for f in flow) == 40 and flow[0][0] <= 100


def test_mix_of_patterns(spark):
    docs = spark.createDataFrame([(i, 10, ["a", "b"] if i % 2 else ["a"]) for i in range(400)] + [(1000, 0, [])], "doc_id long, words long, of array<string>")
    out = mixing.mix(docs, F.col("words"), F.col("of"), ["doc_id"])
    got = out.groupBy(F.col("of")).agg(F.sum("taken").alias("t"), F.max("repeats").alias("r")).collect()
    assert sum(r["t"] or 0 for r in got) == pytest.approx(6000, abs=20) and max(r["r"] for r in got) <= 2


def test_mix_keeps_columns_of_its_names(spark):
    docs = spark.createDataFrame([(i, 10, "a", 7, "t") for i in range(4)], "doc_id long, words long, source string, size int, mix_size string")
    out = mixing.mix(docs, F.col("words"), F.array("source"), ["doc_id"])
    assert out.columns[:5] == docs.columns and {(r["size"], r["mix_size"], r["mix_mix_size"]) for r in out.collect()} == {(7, "t", 10)}
    assert sum(r["taken"] for r in out.collect()) == 60


@pytest.mark.parametrize("few", [0, 100_000])
def test_mix_of_many_sources(spark, monkeypatch, few):
    """Parts of sources that share patterns are solved by themselves; patterns that are too many to broadcast are joined."""
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", few)
    rng = random.Random(4)
    values = [(i, rng.randint(0, 30), rng.choice([[f"s{i % 90}"], [f"s{i % 90}", f"s{(i + 1) % 90}"], [None], [f"s{i % 7}", None]])) for i in range(900)]
    docs = spark.createDataFrame(values, "doc_id long, words long, of array<string>")
    out = mixing.mix(docs, F.col("words"), F.col("of"), ["doc_id"]).collect()
    # The whole problem at once, by the same definition.
    words_of = Counter()
    for _, n, of in values:
        words_of[tuple(sorted(of, key=lambda s: (s is None, s or "")))] += n
    names = sorted({s for k in words_of for s in k}, key=lambda s: (s is None, s or ""))
    size = [sum(n for k, n in words_of.items() if s in k) for s in names]
    total, weight, free, target = 1.5 * sum(words_of.values()), [(3, 1, 2)[i % 3] for i in range(len(names))], list(range(len(names))), {}
    while free:
        unit = total / sum(weight[i] for i in free)
        over = [i for i in free if unit * weight[i] > 2 * size[i]]
        for i in over or free:
            target[i] = 2.0 * size[i] if over else unit * weight[i]
            total -= target[i]
        free = [i for i in free if i not in over] if over else []
    keys = sorted(words_of, key=str)
    flow = mixing.min_cost_flow([words_of[k] for k in keys], [[names.index(s) for s in k] for k in keys], [round(target[i]) for i in range(len(names))], 2)
    assert sum(r["taken"] for r in out) == pytest.approx(sum(sum(f.values()) for f in flow), abs=15 * len(keys))
    first = {k: names.index(k[0]) for k in keys}
    for r in out:
        k = tuple(sorted(r["of"], key=lambda s: (s is None, s or "")))
        assert r["source_size"] == size[first[k]] and abs(r["target"] - target[first[k]]) < 1e-6 and 0 <= r["repeats"] <= 2
    got = {}
    for r in out:
        got[tuple(sorted(r["of"], key=lambda s: (s is None, s or "")))] = (r["pattern_words"], r["pattern_taken"])
    assert sum(t for _, t in got.values()) == sum(sum(f.values()) for f in flow) and all(t <= 2 * w for w, t in got.values())


def test_repeated_rows_of_a_mix(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", *NULLS)] * 5 + [(2, "d", "t", *NULLS)], "doc_id long, text string, source string" + EXTRA)
    out = mixing.mixed_documents(docs).collect()
    assert len(out) == 6 and mixing.mixture(docs).count() == sum(r["repeats"] for r in out)


def test_jaccard_region_takes_a_step_a_point(monkeypatch):
    """Near copies that are at all distances from each other: cells hold most of the points, again in their cells."""
    rng, sets, steps = np.random.default_rng(3), [], []
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    for share in rng.uniform(0.05, 0.5, 700):
        own, n = base.copy(), int(share * len(base))
        own[rng.choice(len(base), n, replace=False)] = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        sets.append(np.unique(own))
    plain = jaccard.Region.distances
    monkeypatch.setattr(jaccard.Region, "distances", lambda self, *args: steps.append(1) or plain(self, *args))
    region = jaccard.Region(np.arange(len(sets)), sets, 80)
    region.links()
    has = np.stack([np.isin(base, s) for s in sets]).astype(np.int64)
    both, n = has @ has.T, np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (n[:, None] + n - both)
    np.fill_diagonal(linked, True)  # a point's own shingles are not all of the base
    label = np.arange(len(sets))
    while (least := np.where(linked, label, len(sets)).min(axis=1)).tolist() != label.tolist():
        label = least
    assert len(set(zip(region.label.tolist(), label.tolist(), strict=True))) == len(set(region.label.tolist())) == len(set(label.tolist())) < len(sets)
    assert len(steps) <= len(sets) + 16


def test_shards_sort_only_what_may_be_shared(monkeypatch):
    """Stretches that have only a minimiser in common are not sorted, and the strings of earlier shards not again."""
    rng, length, sizes, again = random.Random(9), 50, [], []
    noise = lambda n: bytes(rng.choices(range(97, 123), k=n))
    gram, common, passage = noise(20), noise(60), noise(55)
    closed = [(v, v * 100 + i, noise(30) + gram + noise(30)) for v in range(10) for i in range(40)]
    closed += [(3, 390 + i, noise(20) + common + noise(20)) for i in range(2)]
    held = [(99, 2000 + i, noise(25) + passage + noise(25)) for i in range(200)]
    shards = suffixes.Shards(length)
    plain, argsort = suffixes.suffix_array, np.argsort
    monkeypatch.setattr(suffixes, "suffix_array", lambda d: sizes.append(len(d)) or plain(d))
    monkeypatch.setattr(np, "argsort", lambda a, *args, **more: again.extend([len(a)] * (a.dtype.kind == "S")) or argsort(a, *args, **more))
    taken = set()
    for part in (sorted(closed) + held[:40], held[40:80], held[80:120], held[120:160], held[160:]):
        value, doc, data = zip(*part, strict=True)
        table = pa.table({"value": pa.array(value, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "key": pa.array(doc, pa.int64()), "start": pa.array([0] * len(part), pa.int32()), "n": pa.array([len(s) - length + 1 for s in data], pa.int32()), "bytes": pa.array(data, pa.binary())})
        if (out := shards.add(table)) is not None:
            taken |= {(r["doc_id"], r["start"] + i) for r in out.to_pylist() for i in range(r["n"])}
    least: dict[bytes, int] = {}
    places = [(d, i, s[i : i + length]) for _, d, s in closed + held for i in range(len(s) - length + 1)]
    for d, _, s in places:
        least[s] = min(least.get(s, d), d)
    assert taken == {(d, i) for d, i, s in places if least[s] < d} and len(taken) >= 11 + 6 * 199
    assert shards.strings.tolist() == sorted({s for d, _, s in places if d >= 2000}) and shards.least.tolist() == [least[s] for s in shards.strings.tolist()]
    assert sizes[0] <= sum(len(s) + 1 for s in [x[2] for x in closed[-2:] + held[:40]]) + 1 and not again


def test_library_is_asked_once_for_each_pre_token(monkeypatch):
    asked = []
    encoder = records.LibraryEncoder(tokenizer_path(), 0)
    monkeypatch.setattr(encoder.plain.pieces, "encode", lambda w: asked.append(w) or b"\0\0\0\0")
    letters = "abcdefghij"
    for _ in range(2):
        for i in range(0, 400_000, 1000):
            encoder("".join(" " + "".join(letters[int(c)] for c in str(j)) for j in range(i, i + 1000)))
    assert len(asked) == len(set(asked)) == 400_000
