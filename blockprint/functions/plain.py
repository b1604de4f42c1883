"""Digest strings one at a time in Python: what registered SQL functions run, and a second formulation for tests."""

from __future__ import annotations

import re

import numpy as np

from blockprint.constants import ALPHABET, FULL_SIZE, HALF_SIZE, MAX_RUN, WINDOW
from blockprint.functions import kernels

DIGITS = re.compile(r"[0-9]*", re.A)
LONG_RUN = re.compile(r"(.)\1{3,}")
PLACE = {c: i for i, c in enumerate(ALPHABET)}


def cut_runs(bh: str) -> str:
    return LONG_RUN.sub(r"\1" * MAX_RUN, bh)


def log_of(size: int) -> int | None:
    third, rest = divmod(size, 3)
    return third.bit_length() - 1 if not rest and 0 < third <= 1 << 30 and third & (third - 1) == 0 else None


def failed(kind: str, origin: str, offset: int) -> dict:
    return {"hash": None, "last_index": None, "error": {"kind": kind, "origin": origin, "offset": offset}}


def parse(text: str, long: bool = False, normalized: bool = True, strict: bool = False) -> dict:
    digits = DIGITS.match(text)[0]
    at = len(digits)
    if digits.startswith("0"):
        return failed("BlockSizeStartsWithZero", "BlockSize", 0)
    if at == len(text):
        return failed("UnexpectedEndOfString", "BlockSize", at)
    if text[at] != ":":
        return failed("UnexpectedCharacter", "BlockSize", at)
    if not digits:
        return failed("BlockSizeIsEmpty", "BlockSize", 0)
    if at > 10 or int(digits) > 0xFFFFFFFF:
        return failed("BlockSizeIsTooLarge", "BlockSize", 0)
    if (log := log_of(int(digits))) is None:
        return failed("BlockSizeIsInvalid", "BlockSize", 0)
    parts = []
    for origin, most, ends in (("BlockHash1", FULL_SIZE, ":"), ("BlockHash2", FULL_SIZE if long else HALF_SIZE, ",")):
        at += 1
        begin, stored, run = at, 0, 0
        while at < len(text) and text[at] in PLACE and not (strict and at - begin == most):
            run = run + 1 if at > begin and text[at] == text[at - 1] else 1
            if not normalized or run <= MAX_RUN:
                if stored == most:
                    return failed("BlockHashIsTooLong", origin, at)
                stored += 1
            at += 1
        raw, ahead = text[begin:at], text[at : at + 1]
        if strict and at - begin == most and ahead not in ("", ":", ","):
            return failed("BlockHashIsTooLong", origin, at)
        if ends == ":" and not ahead:
            return failed("UnexpectedEndOfString", origin, at)
        if ahead != ends and not (ends == "," and not ahead):
            return failed("UnexpectedCharacter", origin, at)
        parts.append(cut_runs(raw) if normalized else raw)
    return {"hash": {"log_block_size": log, "bh1": parts[0], "bh2": parts[1]}, "last_index": at, "error": None}


def to_string(h: dict) -> str:
    return f"{3 << h['log_block_size']}:{h['bh1']}:{h['bh2']}"


def normalize(text: str) -> str | None:
    h = parse(text, long=True)["hash"]
    return to_string(h) if h else None


def index_keys(text: str) -> list[int] | None:
    """Distinct index windows of a digest string, in order."""
    h = parse(text, long=True)["hash"]
    if h is None:
        return None
    out: dict[int, None] = {}
    for bh, log in ((h["bh1"], h["log_block_size"]), (h["bh2"], h["log_block_size"] + 1)):
        for i in range(len(bh) - WINDOW + 1):
            key = log
            for c in bh[i : i + WINDOW]:
                key = key << 6 | PLACE[c]
            out[key] = None
    return list(out)


def compare(a: str, b: str) -> dict:
    p, q = parse(a, long=True), parse(b, long=True)
    for side, x in (("Left", p), ("Right", q)):
        if x["error"]:
            return {"score": None, "side": side, "error": x["error"]}
    x, y = p["hash"], q["hash"]
    s = kernels.scores(np.array([x["log_block_size"]]), [x["bh1"]], [x["bh2"]], np.array([y["log_block_size"]]), [y["bh1"]], [y["bh2"]])
    return {"score": int(s[0]), "side": None, "error": None}
