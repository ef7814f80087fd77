"""Words of whole Arrow batches as numpy arrays: spans in characters, 64-bit hashes, hashes of word windows.

A word is a maximal run of letters, marks and digits, lower-cased character by character; ideographs, kana and the
letters of scripts without spaces are words of their own. No step loops over words or characters in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters handled at once; a longer text is handled alone.
CHUNK_CHARS = 1 << 18
_TOP = 0x20000
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class (0 between words, 1 in a word, 2 a word by itself) and lower case of each code point."""
    kind = np.zeros(0x110000, np.uint8)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(_TOP):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LNM":
            kind[c] = 1
            x = ch.lower()
            if len(x) == 1:
                low[c] = ord(x)
    kind[_TOP:0x32000] = 2
    for a, b in _ALONE:
        kind[a : b + 1] = np.where(kind[a : b + 1] > 0, 2, 0)
    return kind, low


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        have = _powers[base] = (made[0], made[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span, alike wherever the span lies."""
    n = len(values)
    up, down = _power(base, n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Words of some texts. start and end are character places within the text; first[i]:first[i+1] are text i's words."""

    def __init__(self, texts: list[str | None]):
        kind, low = tables()
        self.texts = ["" if t is None else t for t in texts]
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        base = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 1, out=base[1:])
        code = np.frombuffer("\n".join([*self.texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32) if self.texts else np.zeros(0, np.uint32)
        k = kind[code]
        inside, alone = k == 1, k == 2
        before = np.zeros(len(k), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero((inside & ~before) | alone)
        after = np.zeros(len(k), bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero((inside & ~after) | alone) + 1
        self.hash = _spans_hash(low[code].astype(np.uint64) + np.uint64(1), starts, ends, _P) if len(code) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(starts, base)
        self.row = np.repeat(np.arange(len(sizes)), np.diff(self.first))
        self.start = starts - base[self.row] if len(starts) else starts
        self.end = ends - base[self.row] if len(ends) else ends
        self._code, self._low, self._base = code, low, base

    def __len__(self) -> int:
        return len(self.hash)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> str:
        r = self.row[i]
        a, b = self._base[r] + self.start[i], self._base[r] + self.end[i]
        return self._low[self._code[a:b]].tobytes().decode("utf-32-le", "surrogatepass")

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words in lower case, each with a space after it, as UTF-8, and the place where each begins."""
        size = self.end - self.start
        if not len(size):
            return b"", np.zeros(0, np.int64)
        offset = np.cumsum(size + 1) - (size + 1)
        out = np.full(int(offset[-1] + size[-1] + 1), 32, np.uint32)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        source = np.repeat(self._base[self.row] + self.start, size) + inner
        out[np.repeat(offset, size) + inner] = self._low[self._code[source]]
        wide = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
        begin = np.cumsum(wide) - wide
        return out.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), begin[offset]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window of n words within a text, and the window's hash."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(len(self) - n + 1)
        at = at[self.row[at] == self.row[at + n - 1]]
        return at, self.spans(at, at + n)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of words."""
        return spans_hash(self.hash, start, end)


def cuts(texts: pa.Array, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of an array of texts of about so many bytes together, a longer text alone."""
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chars, "right")) - 1)
        yield at, to
        at = to


def pieces(batch: pa.RecordBatch, column: str, chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with about so many bytes of text together. The texts of one slice at a time become strings."""
    texts = batch.column(batch.schema.get_field_index(column))
    for at, to in cuts(texts, chars):
        yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()


def spans_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, given the words' hashes; as Words.spans() gives them."""
    return _spans_hash(hashes, start, end, _Q)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
