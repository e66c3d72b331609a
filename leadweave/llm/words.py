"""Words of Arrow string batches as numpy arrays: offsets and 64-bit hashes, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier and its inverse modulo 2**64.
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)
GAMMA = np.uint64(P)
#: Text bytes that are worked on at once (a longer text is one chunk).
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, stream: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(P) + np.uint64((stream * 0xD1342543DE82EF95 + 1) % (1 << 64)))


BYTE_VALUE = seeds(256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: digits, letters, and all of other characters.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.concatenate([[0], np.cumsum(lengths)]) // size
        cuts = np.flatnonzero(np.diff(part[:-1])) + 1 if len(lengths) > 1 else np.array([], dtype=np.int64)
        at = 0
        for end in [*cuts.tolist(), len(lengths)]:
            if end > at:
                yield batch.slice(at, end - at)
            at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and the rows' offsets in them; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none over a row's end, and the index of each row's first run."""
    n = len(inside)
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts_flag = after & ~before
    starts_flag[edge] = after[edge]
    ends_flag = before & ~after
    ends_flag[edge] = before[edge]
    starts, ends = np.flatnonzero(starts_flag), np.flatnonzero(ends_flag)
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of 64-bit symbol values: equal stretches have equal hashes."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(P, len(values)), out=total[1:])
    sums = (total[ends] - total[starts]) * powers(P_INVERSE, len(values) + 1)[starts]
    return mix64(sums + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """hashes of all words of the rows; first[i]:first[i+1] are those of row i."""

    hashes: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def positions(self) -> np.ndarray:
        return np.arange(len(self.hashes)) - np.repeat(self.first[:-1], np.diff(self.first))


def split_words(texts: pa.Array) -> Words:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of each text, A-Z lower-cased; null has none."""
    raw, offsets = text_bytes(texts)
    starts, ends, first = runs(_WORD[raw], offsets)
    return Words(run_hashes(BYTE_VALUE[_LOWER[raw]], starts, ends), first)


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words within a row, and the first index of each row's.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    h, counts = words.hashes, np.diff(words.first)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(P, len(h)), out=total[1:])
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    start = np.arange(first[-1]) - np.repeat(first[:-1], made) + np.repeat(words.first[:-1], made)
    width = np.repeat(np.minimum(counts, n), made)
    sums = (total[start + width] - total[start]) * powers(P_INVERSE, len(h) + 1)[start]
    return mix64(sums + width.astype(np.uint64)), first
