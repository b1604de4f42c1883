"""The numpy kernels: digests of byte strings, and distances and scores of block hashes. They know nothing of Spark."""

from __future__ import annotations

import numpy as np

from blockprint.constants import ALPHABET, BLOCK_SIZES, CAPPING_BORDER, FNV_FACTOR, FNV_START, FULL_SIZE, HALF_SIZE, ROLL_SHIFT, ROLL_WINDOW, WINDOW

CHARS = np.frombuffer(ALPHABET.encode(), np.uint8)
CODES = np.full(256, 64, np.uint8)
CODES[CHARS] = np.arange(64)
PAD = ROLL_WINDOW - 1


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling value at each byte after the first PAD bytes, which are context only."""
    c, n = data.astype(np.uint32), len(data) - PAD
    plain, weighted, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for j in range(ROLL_WINDOW):
        x = c[PAD - j : len(c) - j]
        plain += x
        weighted += np.uint32(ROLL_WINDOW - j) * x
        mixed ^= x << np.uint32(ROLL_SHIFT * j)
    return plain + weighted + mixed


def trigger_levels(roll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that end pieces, and the highest level at which each does (it does at all lower ones too)."""
    r = roll.astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(r % np.uint64(3) == 0)
    q = r[at] // np.uint64(3)
    low = q & (~q + np.uint64(1))
    return at, np.minimum(np.log2(low.astype(np.float64)).astype(np.int64), BLOCK_SIZES - 1)


def piece_states(data: np.ndarray, starts: np.ndarray, first: int | np.ndarray = FNV_START) -> np.ndarray:
    """The piece hash after every byte. Pieces begin at starts (ascending, the first is 0) in the state `first`.

    The hash is s -> (s * 19 ^ c) mod 64. As 19 is odd, bit k of s * 19 is bit k of s, xor a function of the lower bits. So
    when the lower bits are known everywhere, bit k is a running xor within each piece: six passes give all states.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint8)
    low6, lengths = data & np.uint8(63), np.diff(np.append(starts, n))
    begin = np.broadcast_to(np.asarray(first, np.uint8), starts.shape)
    state = np.zeros(n, np.uint8)
    for k in range(6):
        before = np.empty(n, np.uint8)
        before[1:] = state[:-1]
        before[starts] = begin & np.uint8((1 << k) - 1)
        bit = ((before * np.uint8(FNV_FACTOR)) ^ low6) >> np.uint8(k) & np.uint8(1)
        run = np.bitwise_xor.accumulate(bit)
        offset = begin >> np.uint8(k) & np.uint8(1)
        offset = offset ^ np.where(starts > 0, run[np.maximum(starts - 1, 0)], 0).astype(np.uint8)
        state |= (run ^ np.repeat(offset, lengths)) << np.uint8(k)
    return state


def level_of(size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The level that a digest has: the highest one up to the guess from the size with 32 pieces or more."""
    levels = np.arange(BLOCK_SIZES)
    guess = np.argmax((192 << levels)[None, :] >= np.minimum(size, 192 << 30)[:, None], axis=1)
    fits = (levels[None, :] <= guess[:, None]) & (counts >= HALF_SIZE)
    return np.where(fits.any(axis=1), BLOCK_SIZES - 1 - np.argmax(fits[:, ::-1], axis=1), 0)


def strings_at(data: np.ndarray, bounds: np.ndarray, roll_ends: np.ndarray, at: np.ndarray, doc: np.ndarray, cap: int) -> list[bytes]:
    """Block hashes of documents one after another, for places `at` (of documents `doc`) that end pieces. The first `cap`
    pieces are ended; what follows is one more character if there are more, or if the rolling value at the end is not 0."""
    docs = len(bounds) - 1
    count = np.bincount(doc, minlength=docs)
    place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    ends = at[place < cap]
    full = np.diff(bounds) > 0
    resets = ends + 1
    starts = np.unique(np.concatenate([bounds[:-1][full], resets[resets < len(data)]]))
    state = piece_states(data, starts.astype(np.int64))
    tail = (count > cap) | roll_ends
    last = bounds[1:] - 1  # where the tail's value is read
    final = np.concatenate([[-1], at])[np.cumsum(count)]
    last = np.where(roll_ends | (count <= cap), last, final)
    value = np.where(full, state[np.maximum(last, 0)] if len(state) else 0, FNV_START)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[resets] = True
    value = np.where(full & fresh[last + 1] & roll_ends, FNV_START, value)  # nothing follows the last piece that was ended
    kept = np.minimum(count, cap)
    out = np.zeros(int((kept + tail).sum()), np.uint8)
    begin = np.cumsum(kept + tail) - (kept + tail)
    mine = doc[place < cap]
    out[begin[mine] + place[place < cap]] = state[ends]
    out[(begin + kept)[tail]] = value[tail]
    raw, edges = CHARS[out].tobytes(), np.append(begin, len(out)).tolist()
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def ends_of(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of values one after another: owner of each byte, rolling values, places that end pieces, their highest levels, and
    the number of pieces of each value whose highest level is each one."""
    sizes = np.array([len(v) for v in values], np.int64)
    gap = b"\0" * PAD
    padded = np.frombuffer(b"".join(x for v in values for x in (gap, v)), np.uint8)
    owner = np.repeat(np.arange(len(values)), sizes)
    roll = rolling(padded)[np.arange(len(owner)) + owner * PAD] if len(owner) else np.zeros(0, np.uint32)
    at, top = trigger_levels(roll)
    return owner, roll, at, top, np.bincount(owner[at] * BLOCK_SIZES + top, minlength=len(values) * BLOCK_SIZES).reshape(-1, BLOCK_SIZES)


def piece_counts(values: list[bytes]) -> np.ndarray:
    """For each value (rows) and level, how many pieces end."""
    return ends_of(values)[4][:, ::-1].cumsum(axis=1)[:, ::-1]


def digests(values: list[bytes], truncate: bool = True) -> list[tuple[int, bytes, bytes]]:
    """(log block size, bh1, bh2) of each value; bh2 has 32 characters at most, or 64 if not truncated."""
    sizes = np.array([len(v) for v in values], np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    data = np.frombuffer(b"".join(values), np.uint8)
    owner, roll, at, top, exact = ends_of(values)
    of = owner[at]
    level = level_of(sizes, exact[:, ::-1].cumsum(axis=1)[:, ::-1])
    ends = np.zeros(len(values), bool)
    ends[sizes > 0] = roll[bounds[1:][sizes > 0] - 1] != 0
    one = top >= level[of]
    two = top >= level[of] + 1
    first = strings_at(data, bounds, ends, at[one], of[one], FULL_SIZE - 1)
    second = strings_at(data, bounds, ends, at[two], of[two], (HALF_SIZE if truncate else FULL_SIZE) - 1)
    return list(zip(level.tolist(), first, second, strict=True))


# ---- comparison ----------------------------------------------------------------------------------------------------


def padded_codes(block_hashes: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of block hashes as rows of 64 (64 beyond their ends), and their lengths."""
    raw = [(b or "").encode()[:FULL_SIZE] for b in block_hashes]
    flat = np.frombuffer(b"".join(r.ljust(FULL_SIZE, b"\0") for r in raw), np.uint8).reshape(-1, FULL_SIZE)
    return CODES[flat], np.array([len(r) for r in raw], np.int64)


def position_masks(codes: np.ndarray) -> np.ndarray:
    """For each row and code, the places of the code as bits; column 64 is for no code and stays 0."""
    out = np.zeros((len(codes), 65), np.uint64)
    rows = np.arange(len(codes))
    for i in range(FULL_SIZE):
        out[rows, codes[:, i]] |= np.uint64(1 << i)
    out[:, 64] = 0
    return out


def common_and_distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of block hashes: whether they share seven characters in a row, and the insert and delete distance.

    The distance is len(a) + len(b) - 2 * LCS by the bit-parallel recurrence v = (v + p) | (v - p), p = v & mask.
    """
    (ca, la), (cb, lb) = a, b
    masks, rows = position_masks(ca), np.arange(len(ca))
    v = np.full(len(ca), ~np.uint64(0))
    streak = [np.zeros(len(ca), np.uint64) for _ in range(WINDOW)]  # bits where k + 1 characters end that match
    found = np.zeros(len(ca), np.uint64)
    for j in range(int(lb.max(initial=0))):
        m = masks[rows, cb[:, j]]
        for k in range(WINDOW - 1, 0, -1):
            streak[k] = streak[k - 1] << np.uint64(1) & m
        streak[0] = m
        found |= streak[WINDOW - 1]
        p = v & m
        v = (v + p) | (v - p)
    room = np.where(la >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    lcs = np.bitwise_count(~v & room).astype(np.int64)
    return found != 0, la + lb - 2 * lcs


def cap(log: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    return np.where(log >= CAPPING_BORDER, 100, np.left_shift(1, np.minimum(log, CAPPING_BORDER)) * np.minimum(la, lb))


def string_scores(a: list[str | None], b: list[str | None], log: np.ndarray | None) -> np.ndarray:
    """Scores of pairs of block hashes, 0 without seven common characters; capped if log block sizes are given."""
    pa, pb = padded_codes(a), padded_codes(b)
    common, d = common_and_distance(pa, pb)
    total = np.maximum(1, pa[1] + pb[1])
    score = 100 - (100 * ((d * 64) // total)) // 64
    score = np.where(common, score, 0)
    return score if log is None else np.minimum(score, np.where(common, cap(log, pa[1], pb[1]), 0))


def scores(la: np.ndarray, a1: list, a2: list, lb: np.ndarray, b1: list, b2: list) -> np.ndarray:
    """Scores of pairs of normal digests."""
    out = np.zeros(len(la), np.int64)
    d = la - lb
    same = np.array([x == y and z == w for x, y, z, w in zip(a1, b1, a2, b2, strict=True)], bool) & (d == 0)
    out[same] = 100
    take = lambda values, where: [values[i] for i in where.tolist()]
    for where, left, right, log in (
        (np.flatnonzero((d == 0) & ~same), a1, b1, la),
        (np.flatnonzero((d == 0) & ~same), a2, b2, la + 1),
        (np.flatnonzero(d == -1), a2, b1, lb),
        (np.flatnonzero(d == 1), a1, b2, la),
    ):
        if len(where):
            out[where] = np.maximum(out[where], string_scores(take(left, where), take(right, where), log[where]))
    return out
