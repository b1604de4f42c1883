"""The digest of a byte stream, chunk by chunk, in a state of a few kilobytes."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from blockprint.constants import BLOCK_SIZES, FNV_START, FULL_SIZE, HALF_SIZE, MAX_INPUT_SIZE
from blockprint.functions.kernels import CHARS, PAD, piece_states, rolling, trigger_levels


@dataclass
class Caps:
    """One block hash at one level: the characters of the pieces that were ended (`most` at most), the state since then,
    and the state at the last place that ends a piece."""

    most: int
    chars: list[int]
    state: int
    final: int

    def update(self, data: np.ndarray, at: np.ndarray) -> None:
        ends = at[: max(0, self.most - len(self.chars))]
        starts = np.concatenate([[0], ends + 1])
        first = np.concatenate([[self.state], np.full(len(ends), FNV_START)]).astype(np.uint8)
        inside = starts < len(data)
        states = piece_states(data, starts[inside], first[inside])
        self.chars += states[ends].tolist()
        if len(at):
            self.final = int(states[at[-1]])
        self.state = FNV_START if len(ends) and ends[-1] == len(data) - 1 else int(states[-1])

    def text(self, count: int, moving: bool) -> str:
        tail = [self.state if moving else self.final] if moving or count > self.most else []
        return CHARS[np.array(self.chars + tail, np.int64)].tobytes().decode() if self.chars or tail else ""


class StreamDigest:
    """update() with any chunks gives the digest of all bytes so far; digest() may be asked for at any time."""

    def __init__(self) -> None:
        self.size, self.tail, self.whole, self.roll = 0, b"", FNV_START, 0
        self.levels: dict[int, tuple[int, Caps, Caps]] = {}  # pieces, full, half

    def update(self, chunk: bytes) -> None:
        if not chunk:
            return
        data = np.frombuffer(chunk, np.uint8)
        context = self.tail.rjust(PAD, b"\0")
        roll = rolling(np.frombuffer(context + chunk, np.uint8))
        at, top = trigger_levels(roll)
        least = min(self.levels, default=0)
        highest = max([*self.levels, int(top.max()) if len(top) else -1], default=-1)
        for k in range(least, min(BLOCK_SIZES - 1, highest) + 1):
            n, full, half = self.levels.get(k) or (0, Caps(FULL_SIZE - 1, [], self.whole, 0), Caps(HALF_SIZE - 1, [], self.whole, 0))
            mine = at[top >= k]
            full.update(data, mine)
            half.update(data, mine)
            self.levels[k] = (n + len(mine), full, half)
        self.whole = int(piece_states(data, np.zeros(1, np.int64), np.array([self.whole], np.uint8))[-1])
        self.size += len(chunk)
        self.tail = (self.tail + chunk[-PAD:])[-PAD:]
        self.roll = int(roll[-1])
        # A level is never chosen once the next one has enough pieces and the input is too long for it.
        while (k := min(self.levels, default=0)) + 1 in self.levels and self.levels[k + 1][0] >= HALF_SIZE and 192 << k < self.size:
            del self.levels[k]

    @property
    def error(self) -> str | None:
        return "InputSizeTooLarge" if self.size > MAX_INPUT_SIZE else None

    def digest(self, long: bool = False) -> tuple[int, str, str]:
        if self.error:
            raise ValueError(self.error)
        fits = [k for k, (n, _, _) in self.levels.items() if n >= HALF_SIZE and (k == 0 or 192 << (k - 1) < self.size)]
        level, moving = max(fits, default=0), self.roll != 0
        return level, self._text(level, 1, moving), self._text(level + 1, 1 if long else 2, moving)

    def _text(self, level: int, which: int, moving: bool) -> str:
        if level in self.levels:
            return self.levels[level][which].text(self.levels[level][0], moving)
        return CHARS[[self.whole]].tobytes().decode() if moving and self.size else ""

    def dump(self) -> bytes:
        levels = {k: (n, *((c.most, c.chars, c.state, c.final) for c in caps)) for k, (n, *caps) in self.levels.items()}
        return json.dumps([self.size, self.tail.hex(), self.whole, self.roll, levels]).encode()

    @classmethod
    def load(cls, raw: bytes) -> StreamDigest:
        out = cls()
        out.size, tail, out.whole, out.roll, levels = json.loads(raw)
        out.tail = bytes.fromhex(tail)
        out.levels = {int(k): (n, Caps(*full), Caps(*half)) for k, (n, full, half) in levels.items()}
        return out
