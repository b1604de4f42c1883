"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a pre-token has one last token in its BPE encoding. The tokens that end at a prefix are the suffix
matches of an automaton over the vocabulary; such a token t is the last one if the last token of the prefix before it and
t are compatible, that is if BPE leaves the two side by side. Back-pointers from the end give the ids. Results equal those
of merging by rank, which tests check against the tokenizers library.

Nulls are empty texts; an empty text has no ids. Strings of special tokens in a text become their ids. Repeated rows give
rows each, an empty table an empty result; other columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from blockprint.llm.common import binary, column, in_small_batches

#: Pre-tokens whose ids a worker keeps, in each of two generations.
CACHE = 160_000
#: Pairs of tokens that a worker remembers.
MOST_FITS = 200_000
#: Fixed values of byte-level BPE: the pattern that splits text, and the bytes that stand for themselves in vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VISIBLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_of_char() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(VISIBLE)]
    return {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Text -> packed ids. Missing ones are encoded; the oldest generation goes when the newest is full."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class PreTokens:
    """Ids of whole texts from a function for single pre-tokens. Texts of plain Latin characters are split by the same
    pattern with its classes written out, which the standard library's engine runs faster."""

    def __init__(self, encode, most: int):
        latin = "A-Za-zÀ-ÖØ-öø-ſ"
        self.odd = re.compile(rf"[^\t\n\r -~{latin}]").search
        self.latin = re.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^\s0-9{latin}]").replace(r"\p{L}", f"[{latin}]").replace(r"\p{N}", "[0-9]")).findall
        self.any = regex.compile(SPLIT).findall
        self.pieces = Pieces(encode, most)

    def __call__(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[w] for w in (self.any if self.odd(text) else self.latin)(text)])


def vocabulary(path: str) -> tuple[dict, dict[str, int], dict[int, bytes]]:
    """The vocabulary file, its special tokens, and the bytes of each id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    to_byte = byte_of_char()
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in special}
    return spec, special, bytes_of | {i: s.encode() for s, i in special.items()}


def decode(ids: bytes, bytes_of: dict[int, bytes]) -> str:
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class PrefixBpe:
    def __init__(self, path: str, cache: int = CACHE * 3 // 4):
        spec, self.special, self.bytes_of = vocabulary(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: rank of each merge of two ids; the two parts of each merged id and its rank. Single bytes have rank -1.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank[vocab[a], vocab[b]] = r
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.matcher = ahocorasick.Automaton()
        for s, i in vocab.items():
            if s not in self.special and (len(self.bytes_of[i]) == 1 or i in self.parts):
                self.matcher.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.matcher.make_automaton()
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.plain = PreTokens(self.encode_piece, cache)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes ends with just these two.

        The merges inside left and right happen by rank. Undo them from the last one; at every stage the two tokens that
        face each other across the border must not have been merged before the merge that consumed one of them.
        """
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        a, b, until, fits = left, right, 1 << 60, True
        while True:
            r = self.rank.get((a, b))
            # Of merges of one rank the left one goes first, so a tie is lost to the left part and won against the right.
            if r is not None and r < until:
                fits = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or pa_ is not None and pa_[2] > pb[2]:
                a, until = pa_[1], pa_[2]
            else:
                b, until = pb[0], pb[2] + 1
        if len(self.fits) >= MOST_FITS:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_piece(self, piece: str) -> bytes:
        """Packed ids of one pre-token. last[i] is the last token of the first i bytes."""
        data = piece.encode().decode("latin-1")
        last: list[int] = [-1] * (len(data) + 1)
        compatible, lengths = self.compatible, [0] * (len(data) + 1)
        for end, (length, token) in self.matcher.iter(data):
            end += 1
            if last[end] < 0 and (end == length or last[end - length] >= 0 and compatible(last[end - length], token)):
                last[end], lengths[end] = token, length
        ids, at = array("I"), len(data)
        while at:
            ids.append(last[at])
            at -= lengths[at]
        ids.reverse()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.plain(x) for x in self.at_special.split(text))


@functools.lru_cache(maxsize=2)
def model(path: str) -> PrefixBpe:
    return PrefixBpe(path)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return vocabulary(path)[2]


def encode_documents(docs: DataFrame, path: str, digests: bool = False, ids: bool = True) -> DataFrame:
    """doc_id and ids: the whole text's ids as little-endian unsigned 32-bit integers. With digests also n_tokens,
    ids_sha256 and decoded_sha256, that of the text to which the ids decode; one task then encodes and decodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for part in slices(batch):
                raw = [bpe.encode(t or "") for t in column(part, "text").to_pylist()]
                out = {"doc_id": column(part, "doc_id")}
                if digests:
                    out |= {
                        "n_tokens": pa.array([len(x) // 4 for x in raw], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(decode(x, bpe.bytes_of).encode()).hexdigest() for x in raw], pa.string()),
                    }
                yield pa.record_batch(out | ({"ids": pa.array(raw, pa.binary())} if ids else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}" + ", n_tokens long, ids_sha256 string, decoded_sha256 string" * digests + ", ids binary" * ids)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = token_bytes(path)
        for batch in batches:
            yield pa.record_batch({"doc_id": column(batch, "doc_id"), "text": pa.array([decode(x, bytes_of) for x in binary(column(batch, "ids")).to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
