"""Vectorised byte kernels that the text operators run inside Arrow batches.

Texts stay what Arrow holds: one byte array with offsets. A kernel sees a chunk of
whole documents of about ``CHUNK_BYTES`` (one longer document makes a chunk of its
own), so its working memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker, which outlives its task, hands the memory that it freed back to the machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(ends) == 0:
        ends = np.zeros(1, np.int64)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``most`` bytes."""
    begin, count = 0, len(offsets) - 1
    while begin < count:
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), count)
        yield begin, end
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At every place the eight bytes from there on as a long (zeros after the end)."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    out = np.empty(len(data), np.uint64)
    for k in range(8):
        # Every eighth place is an aligned view of the bytes moved by k.
        out[k::8] = wide[k : k + (len(data) - k + 7) // 8 * 8].view(np.uint64) if k < len(data) else []
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, eight bytes at a time; spans over 256 bytes by BLAKE2b.

    Each step is a bijection of the state followed by a mix, so no structure of the bytes
    (repeats, complements) makes two spans collide more often than chance.
    """
    size = ends - starts
    state = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if len(size) == 0:
        return state
    blocks = eight_bytes(data)
    live = np.flatnonzero((size > 0) & (size <= 256))
    done = 0
    while len(live):
        rest = np.minimum(size[live] - done, 8).astype(np.uint64)
        block = blocks[starts[live] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        state[live] = mix((state[live] ^ block) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x2545F4914F6CDD1D))
        done += 8
        live = live[size[live] > done]
    for k in np.flatnonzero(size > 256).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
        state[k] = np.frombuffer(digest, np.uint64)[0]
    return state


class SpanHasher:
    """Polynomial hashes of any spans of one byte array, from prefix sums modulo 2**64.

    A span's symbols are mixed runs of eight bytes, not bytes, without which words such as
    the Thue-Morse sequence and its complement collide under any base. Spans have at least eight bytes.
    """

    def __init__(self, data: np.ndarray) -> None:
        up, self._down = _power_tables(len(data))
        self._sums = np.zeros(max(len(data) - 7, 0) + 1, np.uint64)
        count = len(self._sums) - 1
        np.cumsum(mix(eight_bytes(data)[:count] + np.uint64(_BASE)) * up[:count], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal bytes give equal values; the length enters the value."""
        raw = (self._sums[ends - 7] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def every(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length, by start."""
        width = length - 7
        count = len(self._sums) - width
        if count <= 0:
            return np.empty(0, np.uint64)
        return mix((self._sums[width:] - self._sums[:count]) * self._down[:count])


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of bytes that ``in_word`` (256 flags) accepts."""
    inside = in_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
