"""Vectorised word and shingle hashing shared by the text operators.

A word is a run of letters or digits of the NFKC-normalised, lower-cased text;
a CJK ideograph is a word of its own.  Everything here works on one batch of
texts at a time with NumPy, so a Spark task pays a few dozen vector operations
per batch instead of a Python loop per word.  All hashes are 64-bit, seedless
and equal on every executor.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_CHAR_BASE = 0xD1342543DE82EF95
_TABLE_END = 0x32400
#: Characters handled per inner chunk; keeps the temporaries inside the CPU caches.
_CHUNK_CHARS = 1 << 19


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0: separator, 1: letter or digit, 2: CJK ideograph, by code point."""
    table = np.zeros(_TABLE_END, np.uint8)
    for cp in range(_TABLE_END):
        if unicodedata.category(chr(cp))[0] == "L" or unicodedata.category(chr(cp)) == "Nd":
            table[cp] = 1
    for lo, hi in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)):
        table[lo : hi + 1] = 2
    return table


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, _U)
    x = 1
    for i in range(n):
        out[i] = x
        x = (x * _CHAR_BASE) & 0xFFFFFFFFFFFFFFFF
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def strip_markup(text: str) -> str:
    """Drops tags, character references and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else text.translate(_INVISIBLE)


def fold(text: str | None) -> str:
    """NFKC and lower case; null becomes the empty text."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).lower()


def words(text: str | None) -> list[str]:
    """The words of one text as strings: the plain form of what word_hashes does."""
    return WORD.findall(fold(text))


WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U000323AF]|[^\W_㐀-䶿一-鿿豈-﫿\U00020000-\U000323AF]+")


def word_hashes(texts: Sequence[str | None], folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, flat, and the offsets of each text (n + 1)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    parts: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        chunk: list[str] = []
        size = 0
        first = at
        while at < len(texts) and (size < _CHUNK_CHARS or not chunk):
            t = texts[at] or ""
            t = t if folded else fold(t)
            chunk.append(t)
            size += len(t) + 1
            at += 1
        h, counts = _chunk_hashes(chunk)
        parts.append(h)
        offsets[first + 1 : at + 1] = counts
    np.cumsum(offsets, out=offsets)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), offsets


def _chunk_hashes(chunk: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\n".join(chunk) + "\n"
    if joined.isascii():
        cp = np.frombuffer(joined.encode("ascii"), np.uint8)
        cls = _classes()[:256][cp]
    else:
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = _classes()[np.minimum(cp, _TABLE_END - 1)]
    starts_mask = np.empty(len(cls), bool)
    starts_mask[0] = cls[0] > 0
    np.logical_and(cls[1:] > 0, (cls[1:] == 2) | (cls[:-1] != 1), out=starts_mask[1:])
    word_chars = np.flatnonzero(cls > 0)
    n = len(word_chars)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in chunk), np.int64, len(chunk)))
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(chunk), np.int64)
    is_start = starts_mask[word_chars]
    starts = np.flatnonzero(is_start)  # within word_chars
    lengths = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, lengths)
    pw = _powers(1 << int(max(6, int(lengths.max()).bit_length())))
    val = (cp[word_chars].astype(_U) + _U(0x51ED)) * _MULT
    val *= pw[place]
    h = mix64(np.add.reduceat(val, starts))
    at = word_chars[starts]
    upto = np.searchsorted(at, ends, side="left")
    return h, np.diff(np.concatenate(([0], upto)))


def shingle_hashes(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words and the offsets of each text.

    A text of fewer than k words has none.
    """
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    total = int(out[-1])
    if total == 0:
        return np.zeros(0, _U), out
    first = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(total)
    acc = h[first].copy()
    for i in range(1, k):
        acc *= _MULT
        acc += h[first + i]
        acc ^= acc >> _U(29)
    return mix64(acc), out


def distinct_by_text(s: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text (flat) and the offsets."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    s = s.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        s[a:b].sort()  # many small sorts beat one sort over (text, hash)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[keep], owner[keep]
    return s, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def set_hashes(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each text's set of hashes (order-free; the sets must be distinct)."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    a, b = np.zeros(n, _U), np.zeros(n, _U)
    np.add.at(a, owner, mix64(s ^ _U(0xA5A5A5A5A5A5A5A5)))
    np.bitwise_xor.at(b, owner, mix64(s * _MULT))
    return mix64(a * _MULT + b + np.diff(offsets).astype(_U))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit integers, as Spark's BIGINT holds them."""
    return x.view(np.int64)
