"""Vectorised word and n-gram hashing over Arrow string columns.

A word is a maximal run of characters other than space and U+0009 to U+000D.
Those separators are single bytes in UTF-8, so words are found on the bytes.
Word hashes are differences of one running polynomial sum, so a text of any
length is hashed in pieces of bounded size with a constant number of numpy calls.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
SEPARATORS = b" \t\n\x0b\x0c\r"

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
#: Everything in ASCII but letters and digits, for words without their punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE = _stream(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_GRAM = _stream(64, 12) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """_BASE ** i and its inverse, modulo 2 ** 64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        n = max(n, PIECE_BYTES + 1)
        out = np.empty(n, _U)
        out[0], filled, step = 1, 1, base
        while filled < n:
            more = min(filled, n - filled)
            out[filled : filled + more] = out[:more] * _U(pow(base, filled, 1 << 64))
            filled += more
        _powers[kind] = have = out
    return have


class Words(NamedTuple):
    """Words of several texts in order: their text's number, byte range in ``data``, hash.

    ``prefix`` has a row of hashes for each length that was asked for; words that
    aren't longer than it have 0 there.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_docs: int
    prefix: np.ndarray | None = None


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE_BYTES that end where a text or a separator ends."""
    at, total = 0, int(offsets[-1])
    while at < total:
        to = min(total, at + PIECE_BYTES)
        if to < total:
            cut = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if cut <= at:
                gaps = np.flatnonzero(sep[data[at:to]])
                if len(gaps):
                    cut = at + int(gaps[-1]) + 1
                else:  # one word longer than a piece
                    more = np.flatnonzero(sep[data[to : int(offsets[np.searchsorted(offsets, at, "right")])]])
                    cut = to + int(more[0]) + 1 if len(more) else int(offsets[np.searchsorted(offsets, at, "right")])
            to = cut
        yield at, to
        at = to


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, sep: np.ndarray = _IS_SEP, prefixes: tuple[int, ...] = ()) -> Words:
    """All words; ``fold`` lower-cases A-Z, and nothing else. ``sep`` marks the bytes between words."""
    table = _FOLDED if fold else _BYTE
    starts, ends, hashes, heads = [], [], [], []
    for a, b in _pieces(data, offsets, sep):
        part = data[a:b]
        word = np.empty(len(part) + 2, bool)
        word[0] = word[-1] = False
        word[1:-1] = ~sep[part]
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        s = word[1:-1] & ~word[:-2]
        e = word[1:-1] & ~word[2:]
        if len(inner):
            s[inner] = word[1:-1][inner]
            e[inner - 1] = word[1:-1][inner - 1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(table[part] * _power("up", len(part) + 1)[: len(part)], out=total[1:])
        h = (total[e] - total[s]) * _power("down", len(part) + 1)[s]
        hashes.append(mix64(h + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)))
        if prefixes:
            down, head = _power("down", len(part) + 1)[s], np.zeros((len(prefixes), len(s)), _U)
            for row, k in zip(head, prefixes, strict=True):
                longer = e - s > k
                row[longer] = mix64((total[s[longer] + k] - total[s[longer]]) * down[longer] + _U(k))
            heads.append(head)
        starts.append(s + a)
        ends.append(e + a)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    start = cat(starts, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    prefix = (np.concatenate(heads, axis=1) if heads else np.zeros((len(prefixes), 0), _U)) if prefixes else None
    return Words(doc.astype(np.int64), start, cat(ends, np.int64), cat(hashes, _U), len(offsets) - 1, prefix)


def hash_ngrams(words: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words within a text, with their text's number and first word.

    With ``short`` a text of 1 to n - 1 words has its whole sequence as one gram.
    """
    doc, h = words.doc, words.hash
    m = max(0, len(h) - n + 1)
    grams = np.zeros(m, _U)
    for i in range(n):
        grams += h[i : i + m] * _GRAM[i]
    whole = doc[:m] == doc[n - 1 :] if m else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    grams, owner = mix64(grams[at] + _U(n)), doc[at]
    if short and len(h):
        counts = np.bincount(doc, minlength=words.n_docs)
        few = np.flatnonzero((counts > 0) & (counts < n))
        if len(few):
            firsts = np.searchsorted(doc, few)
            sums = np.zeros(len(few), _U)
            for i in range(n - 1):
                has = counts[few] > i
                sums[has] += h[firsts[has] + i] * _GRAM[i]
            extra = mix64(sums + _U(n) + counts[few].astype(_U) * _U(0xA0761D6478BD642F))
            grams, owner, at = np.concatenate([grams, extra]), np.concatenate([owner, few]), np.concatenate([at, firsts])
            order = np.argsort(owner, kind="stable")
            grams, owner, at = grams[order], owner[order], at[order]
    return grams, owner, at


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most about ``limit`` bytes of text and ``rows`` rows each."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < len(offsets) - 1:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to
