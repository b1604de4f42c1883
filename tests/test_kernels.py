"""The kernels against plain formulations and published values."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockprint.constants import ALPHABET
from blockprint.functions import kernels, plain
from blockprint.functions.incremental import StreamDigest
from blockprint.queries import SCORED


def plain_digest(data: bytes, truncate: bool) -> tuple[int, str, str]:
    c, n = [0] * 6 + list(data), len(data)
    rolls = []
    for i in range(n):
        w = c[i : i + 7]
        mixed = 0
        for j in range(7):
            mixed ^= w[6 - j] << 5 * j & 0xFFFFFFFF
        rolls.append(sum(w) + sum((j + 1) * x for j, x in enumerate(w)) + mixed & 0xFFFFFFFF)
    ends = [[i + 1 for i, r in enumerate(rolls) if (r + 1) % (3 << k) == 0] for k in range(31)] + [[]]
    guess = next(k for k in range(31) if 192 << k >= n)
    level = max([k for k in range(guess + 1) if len(ends[k]) >= 32], default=0)
    moving = n > 0 and rolls[-1] != 0

    def piece(a: int, b: int) -> str:
        s = 0x27
        for x in data[a:b]:
            s = (s * 0x01000193 ^ x) & 63
        return ALPHABET[s]

    def text(k: int, cap: int) -> str:
        out, at = "", 0
        for e in ends[k][:cap]:
            out, at = out + piece(at, e), e
        if len(ends[k]) > cap:
            return out + piece(at, n if moving else ends[k][-1])
        return out + piece(at, n) if moving else out

    return level, text(level, 63), text(level + 1, 31 if truncate else 63)


def samples() -> list[bytes]:
    rng = np.random.default_rng(7)
    out = [b"", b"a", bytes(10), b"Hello, World!\n"]
    out += [rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in rng.integers(1, 4000, 40)]
    out += [bytes(rng.integers(97, 100, int(n), dtype=np.uint8)) for n in rng.integers(1, 9000, 10)]
    for n in (3, 31, 32, 33, 62, 63, 64, 65, 100):  # patterns that end a piece at each repetition
        out += [b"006vuxV" * n, b"00NQe2z" * n, b"00NQe2z" * n + b"x", b"00NQe2z" * n + bytes(7)]
    return out


@pytest.mark.parametrize("truncate", [True, False])
def test_digests_equal_plain_ones(truncate):
    values = samples()
    got = [(k, a.decode(), b.decode()) for k, a, b in kernels.digests(values, truncate)]
    assert got == [plain_digest(v, truncate) for v in values]


def test_published_digests():
    assert kernels.digests([b"Hello, World!\n", b"", bytes(100)]) == [(0, b"aaX8v", b"aV"), (0, b"", b""), (0, b"", b"")]


def test_any_chunks_give_the_digest():
    rng = random.Random(3)
    for value in samples():
        s, at = StreamDigest(), 0
        while at < len(value):
            step = rng.choice([1, 3, 7, 100, 1000])
            s.update(value[at : at + step])
            at += step
            if rng.random() < 0.1:
                s = StreamDigest.load(s.dump())
        for long in (False, True):
            k, a, b = kernels.digests([value], not long)[0]
            assert s.digest(long) == (k, a.decode(), b.decode())


def test_highest_levels():
    """A pattern that ends pieces at all levels, after 96 GiB of zeros; the state is set, not fed."""
    pattern, zeros = b"`]]]_CT", (96 << 30) - 448
    s = StreamDigest()
    s.update(bytes(14))
    # Zero bytes change a piece's state with a period that divides 16, and end no pieces.
    s.size = zeros
    for _ in range(zeros % 16 and (zeros - 14) % 16):
        pass
    assert len(s.levels) == 0
    s.update(pattern * 64)
    assert s.size == 96 << 30
    level, one, two = s.digest(long=True)
    assert level == 29 and one[1:] == "i" * 63 and two[1:] == "i" * 63
    s.update(b"\1")
    level, one, two = s.digest()
    assert level == 30 and one[1:63] == "i" * 62 and one[63] == "H" and len(two) == 1


@pytest.mark.parametrize("a,b,score", [r[:3] for r in SCORED if r[2] is not None])
def test_published_scores(a, b, score):
    assert plain.compare(a, b)["score"] == plain.compare(b, a)["score"] == score


def test_score_matrix():
    names = ["7MKTVc849q4STQRtiy5N", "tMKTVc84WWb4SQnOOi85", "vMKTVc84eoaWWedqTniu", "YMKTVc84OMS0lyfgvh41"]
    want = [[100, 61, 50, 46], [61, 100, 57, 41], [50, 57, 100, 36], [46, 41, 36, 100]]
    got = kernels.string_scores([a for a in names for _ in names], names * 4, None).reshape(4, 4)
    assert got.tolist() == want
    for log in range(32):
        capped = kernels.string_scores([a for a in names for _ in names], names * 4, np.full(16, log)).reshape(4, 4)
        most = 100 if log >= 4 else 20 << log
        assert capped.tolist() == [[min(x, most) for x in r] for r in want]


def subsequence_distance(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return len(a) + len(b) - 2 * row[-1]


block_hashes = st.text("ABCab+/", max_size=64)


@settings(max_examples=200, deadline=None)
@given(block_hashes, block_hashes)
def test_distance_and_common_characters(a, b):
    common, d = kernels.common_and_distance(kernels.padded_codes([a]), kernels.padded_codes([b]))
    assert d[0] == subsequence_distance(a, b)
    assert common[0] == any(a[i : i + 7] in b for i in range(len(a) - 6))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 30), block_hashes, st.text("ABCab+/", max_size=32), st.integers(-2, 2), block_hashes, st.text("ABCab+/", max_size=32))
def test_scores_and_candidates(n, a1, a2, step, b1, b2):
    a1, a2, b1, b2 = map(plain.cut_runs, (a1, a2, b1, b2))
    m = min(30, max(0, n + step))
    x, y = f"{3 << n}:{a1}:{a2}", f"{3 << m}:{b1}:{b2}"
    score = plain.compare(x, y)["score"]
    assert 0 <= score <= 100 and score == plain.compare(y, x)["score"] and plain.compare(x, x)["score"] == 100
    if (n, a1, a2) != (m, b1, b2):
        assert (score > 0) == bool(set(plain.index_keys(x)) & set(plain.index_keys(y)))


@pytest.mark.parametrize("level", range(6))
def test_piece_counts(level):
    rng = random.Random(level)
    values = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 50, 0, 3000)] + [b"", bytes(20)]
    for value, counts in zip(values, kernels.piece_counts(values), strict=True):
        c = [0] * 6 + list(value)
        ends = 0
        for i in range(len(value)):
            w, mixed = c[i : i + 7], 0
            for j in range(7):
                mixed ^= w[6 - j] << 5 * j & 0xFFFFFFFF
            ends += ((sum(w) + sum((j + 1) * x for j, x in enumerate(w)) + mixed & 0xFFFFFFFF) + 1) % (3 << level) == 0
        assert counts[level] == ends
