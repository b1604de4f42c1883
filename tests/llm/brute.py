"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda raw: hashlib.sha256(raw).hexdigest()


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def strings(rows, length=50):
    """op5: rows of (doc_id, text)."""
    least: dict[bytes, int] = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        reach = 0
        for i in range(len(raw) - length + 1):
            if d is not None and least[raw[i : i + length]] < d:
                for k in range(max(i, reach), i + length):
                    gone[k] = True
                reach = i + length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g))))
    return out


def windows(rows, window=35):
    """op8: rows of (doc_id, text)."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def shingles(text, size=5):
    w = WORD.findall(lower_ascii(text or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def linked(rows, percent=80):
    """op1: rows of (doc_id, text) -> (doc_id, number of shingles, component, number of links)."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, has = Counter(), {}
    for i, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in has.get(x, ()))
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
        for x in s:
            has.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
        least.setdefault(r, None)
    return [(d, len(s), least[root(i)], links[i]) for i, (d, s) in enumerate(sets)]


def rules(text):
    """op7: the counts of one text."""
    w = WORD.findall(text or "")
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    gone = [False] * len(w)
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            gone[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": sum(gone),
        "base_failed": len(w) < 10 or 100 * sum(gone) > 20 * len(w),
    }


def archived(rows, least=1000):
    """op9: rows of (page_id, html)."""
    first: dict[bytes, int] = {}
    for p, h in rows:
        raw = (h or "").encode()
        if p is not None:
            first[raw] = max(first.get(raw, p), p)
    out = []
    for p, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= least and raw in first and p != first[raw]
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None))
    return out


def discounts(counts):
    c = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
    if not c[0] or not c[1]:
        return [0, 0.5, 0.5, 0.5]
    y = c[0] / (c[0] + 2 * c[1])
    d = [1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2] if c[2] else 1.5]
    return [0] + [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


class Smoothed:
    """Interpolated modified Kneser-Ney in dictionaries: counts of n-grams (tuples) of the highest order, and the
    probability of what no n-gram knows."""

    def __init__(self, top: Counter, order: int, unknown):
        self.order, self.unknown, self.counts = order, unknown, {order: top}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.less, self.contexts = {}, {}
        for n, counts in self.counts.items():
            self.less[n], self.contexts[n] = discounts(list(counts.values())), {}
            for g, x in counts.items():
                self.contexts[n].setdefault(g[:-1], []).append(x)

    def __call__(self, gram: tuple, n: int | None = None) -> float:
        n = self.order if n is None else n
        if n == 0:
            return self.unknown(gram)
        key = gram[len(gram) - n :]
        follow = self.contexts[n].get(key[:-1])
        below = self(gram, n - 1)
        if not follow:
            return below
        count, less = self.counts[n].get(key, 0), self.less[n]
        return (max(count - less[min(count, 3)], 0) + sum(less[min(x, 3)] for x in follow) * below) / sum(follow)


def bits_a_word(rows, order=3, border_bits=8.0):
    """op7: rows of (text, lang, fold) -> the mean of -log2 of the probability of each word and of the end."""
    data = [b"\n\n" + (t or "").encode() for t, _, _ in rows]
    spelled = Smoothed(Counter(d[i - 2 : i + 1] for d in data for i in range(2, len(d))), 3, lambda g: 1 / 256)
    grams = []
    for t, _, _ in rows:
        w = WORD.findall(t or "")
        padded = [""] * (order - 1) + w + [""] if w else []
        grams.append([tuple(padded[i - order + 1 : i + 1]) for i in range(order - 1, len(padded))])
    models = {}
    for which in {(lang, fold) for _, lang, fold in rows}:
        mine = Counter(g for gs, (_, lang, fold) in zip(grams, rows, strict=True) if (lang, fold) == which for g in gs)
        models[which] = mine
    out, levels = [], {}
    for f in (0, 1):
        tops = {lang: m for (lang, fold), m in models.items() if fold == f}
        parts = {lang: Smoothed(m, order, None) for lang, m in tops.items()}
        for n in range(1, order + 1):
            # Discounts are those of all languages together.
            less = discounts([x for m in parts.values() for x in m.counts[n].values()])
            for m in parts.values():
                m.less[n] = less
        levels[f] = parts
    for d, (t, lang, fold), gs in zip(data, rows, grams, strict=True):
        total = 0.0
        places = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)]
        for k, g in enumerate(gs):
            if k < len(places):
                a, b = places[k]
                p = 1.0
                for i in range(a, min(b + 1, len(d))):
                    p *= spelled(d[i - 2 : i + 1])
            else:
                p = 2.0**-border_bits
            model = levels[1 - fold].get(lang)
            if model is not None:
                model.unknown = lambda _, p=p: p
                p = model(g)
            total -= math.log2(p)
        out.append(total / len(gs) if gs else None)
    return out


def tiff(data):
    """op4: the pages of a little-endian TIFF file of one-sample pages: (width, height, bytes), read a byte at a time."""
    u16 = lambda i: data[i] | data[i + 1] << 8
    u32 = lambda i: u16(i) | u16(i + 2) << 16
    assert data[:4] == b"II*\0"
    at, pages = u32(4), []
    while at:
        n, f = u16(at), {}
        for e in range(at + 2, at + 2 + 12 * n, 12):
            tag, size, count = u16(e), {3: 2, 4: 4}[u16(e + 2)], u32(e + 4)
            where = e + 8 if size * count <= 4 else u32(e + 8)
            f[tag] = [(u16 if size == 2 else u32)(where + size * k) for k in range(count)]
        at = u32(at + 2 + 12 * n)
        w, h, kind, predictor = f[256][0], f[257][0], f[259][0], f.get(317, [1])[0]
        tiled = 322 in f
        tw, th = (f[322][0], f[323][0]) if tiled else (w, f[278][0])
        image = [bytearray(w) for _ in range(h)]
        places = [(y, x) for y in range(0, h, th) for x in range(0, w, tw)]
        for (y, x), offset, size in zip(places, f[324 if tiled else 273], f[325 if tiled else 279], strict=True):
            raw = {1: bytes, 5: tiff_lzw, 8: zlib.decompress, 32773: tiff_bits}[kind](data[offset : offset + size])
            for r in range(th if tiled else min(th, h - y)):
                row = bytearray(raw[r * tw : (r + 1) * tw])
                for k in range(1, tw if predictor == 2 else 0):
                    row[k] = (row[k] + row[k - 1]) % 256
                if y + r < h:
                    image[y + r][x : x + tw] = row[: w - x]
        pages.append((w, h, b"".join(image)))
    return pages


def tiff_bits(raw):
    out, i = b"", 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out, i = out + raw[i + 1 : i + 2 + n], i + 2 + n
        elif n > 128:
            out, i = out + raw[i + 1 : i + 2] * (257 - n), i + 2
        else:
            i += 1
    return out


def tiff_lzw(raw):
    bits, at, out, table, width, last = "".join(f"{b:08b}" for b in raw), 0, b"", [], 9, None
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + entry[:1])
        out, last = out + entry, entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def tiff_feature(payload, n_pages):
    """op4: pages, size, mean, variance and the means of 8 bands of columns, in hundredths, rounded down."""
    n, total = len(payload), sum(payload)
    bands = [[b for i, b in enumerate(payload) if i % 64 // 8 == k] for k in range(8)]
    variance = (sum(b * b for b in payload) * n - total * total) * 100 // (n * n)
    return f"{n_pages}x64x{n // 64};{total * 100 // n};{variance};" + ",".join(str(sum(b) * 100 // len(b)) for b in bands)


def statistics(text):
    """op3: the statistics of one text."""
    t = text or ""
    raw, w = t.encode(), WORD.findall(t)
    size, n = max(1, len(raw)), max(1, len(w))
    has = lambda chars: sum(t.count(c) for c in chars)
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    letters = max(1, upper + lower)
    symbols = has("#*$%&|<>{}[]\\^~_=+@/")
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() and c not in "#*$%&|<>{}[]\\^~_=+@/!?.,;:" for c in t)
    lines = [x for x in t.split("\n") if x.strip()] if w else []
    control = sum((ord(c) < 32 and c not in "\t\n\r") or ord(c) == 127 for c in t)
    top = max(Counter(w).values()) if w else 0
    return [
        math.log1p(len(w)), min(sum(map(len, w)) / n, 50), len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:])) / n, upper / letters, sum("0" <= c <= "9" for c in t) / size,
        min(symbols / n, 4), min(has("!?") / n, 4), min(t.count(".") / n, 4), min(has(",;:") / n, 4), min(marks / n, 4),
        float(letters <= 1), len(lines) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), has(" \t") / size, sum(b > 127 for b in raw) / size, min(1, top / n), control / size,
    ]


def classifier(rows, x, features=256, seed=11, ridge=1e-3, bins=4000):
    """op3: rows of (doc_id, label or None) with their statistics x -> scores, all rows at once."""
    fold = np.array([zlib.crc32(str(d).encode()) % 4 for d, _ in rows])
    label = np.array([-1 if q is None else q for _, q in rows])
    fit, check = (label >= 0) & (fold < 2), (label >= 0) & (fold == 3)
    rng, d = np.random.default_rng(seed), x.shape[1]
    mean, scale = x[fit].mean(0), np.sqrt(np.maximum(x[fit].var(0), 1e-6))
    directions, shifts = rng.normal(size=(d, features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, features)
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ directions + shifts) * np.sqrt(2 / features)
    z = np.concatenate([z, np.ones((len(x), 1))], axis=1)
    weights = np.linalg.solve(z[fit].T @ z[fit] + ridge * fit.sum() / features * np.eye(features + 1), z[fit].T @ label[fit])
    raw = z @ weights
    # Isotonic regression of bins by the min-max formula.
    at = ((np.clip(raw, -0.999, 1.999) + 1) * (bins / 3)).astype(int)
    used = np.unique(at[check])
    n, ones, sums = (np.array([f(check & (at == b)) for b in used], float) for f in (np.sum, lambda m: label[m].sum(), lambda m: np.clip(raw, -0.999, 1.999)[m].sum()))
    value = np.array([max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))])
    knots = [sums[value == v].sum() / n[value == v].sum() for v in np.unique(value)]
    return 0.999 * np.interp(raw, knots, np.unique(value)) + 0.001 * np.clip((raw + 1) / 3, 0, 1)
