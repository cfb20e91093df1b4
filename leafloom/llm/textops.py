"""Vectorised text primitives over Arrow string buffers.

A batch of strings is one byte buffer with offsets, so words, windows and
lines of a whole batch are found with a few numpy passes and no loop over
documents or words.

Spans of bytes are told apart by ``span_hashes`` (eight bytes at a time,
mixed after each; longer than ``LONG_SPAN``: BLAKE2b), and where a result must
be exact, by their bytes too: ``classes`` and ``same_spans``. Hashes that
leave the batch are ``strong_hashes``: injective up to eight bytes, BLAKE2b
beyond, so that no text can be built whose words collide.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# freed batches go back to the system at once: a worker's memory is shared with the executor's
pa.set_memory_pool(pa.system_memory_pool())

try:
    trim = ctypes.CDLL(None).malloc_trim  # gives freed memory back
except (AttributeError, OSError):  # another C library than glibc
    trim = int

U64 = np.uint64
#: ASCII white space between words: space and \t to \r.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Spans of more bytes are hashed and compared one by one.
LONG_SPAN = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets as int64, bytes) of a string array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw


def slices(batch: pa.RecordBatch, text: int, budget: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``budget`` text bytes; a longer text is a part by itself."""
    n = batch.num_rows
    if n == 0:
        return
    offsets, _ = strings(batch.column(text))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + budget, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to
    trim(0)


class Words:
    """Words (maximal runs without ASCII white space) of a batch of texts.

    start, end: byte positions; doc: row of the text; hashes: 64-bit ids.
    """

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, lower: bool = False) -> None:
        self.offsets, self.n_docs = offsets, len(offsets) - 1
        if lower:
            raw = _LOWER[raw]
        self.raw = raw
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = ~_IS_SPACE[raw]
        begins = np.flatnonzero(np.diff(inside) == 1)
        ends = np.flatnonzero(np.diff(inside) == -1)
        # a text boundary also ends a word
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
        if len(cuts):
            inner = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
            if len(inner):
                begins = np.sort(np.concatenate([begins, inner]))
                ends = np.sort(np.concatenate([ends, inner]))
        self.start, self.end = begins, ends
        self.doc = np.searchsorted(offsets, begins, side="right") - 1
        #: first word of each text, and the number of all words at the end
        self.first = np.searchsorted(begins, offsets, side="left")

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit identities that hold across batches."""
        return strong_hashes(self.raw, self.start, self.end)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of ``size`` words within one text."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        acc = np.zeros(len(at), dtype=U64)
        for k in range(size):
            acc = chained(acc, hashes[at + k])
        return at, acc


def chained(acc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of sequences that are one item longer."""
    return mix(acc * U64(0xD6E8FEB86659FD93) + hashes)


def _lanes(raw: np.ndarray) -> np.ndarray:
    """For each position, the eight bytes from there on as one number; zeros after the end."""
    held = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=held, strides=(1,))


def _masked(lane: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` bytes of each lane; sizes of eight and more leave it whole."""
    return lane & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * np.minimum(size, 8).astype(U64)))


def _digest(data: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, none of them empty but for the caller's own meaning of 0."""
    size = end - start
    lanes = _lanes(raw)
    out = size.astype(U64) * U64(0xA24BAED4963EE407)
    left = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(left):
        rest = size[left] - at
        out[left] = mix(out[left] * U64(0x9E3779B97F4A7C15) ^ _masked(lanes[start[left] + at], rest))
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = _digest(raw[start[i] : end[i]])
    return out


def same_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span has the same bytes as the other one of its place."""
    size = end - start
    same = size == other_end - other_start
    lanes, others = _lanes(raw), _lanes(other) if other is not raw else None
    others = lanes if others is None else others
    left = np.flatnonzero(same & (size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(left):
        rest = size[left] - at
        same[left] = _masked(lanes[start[left] + at] ^ others[other_start[left] + at], rest) == 0
        at += 8
        left = left[(rest > 8) & same[left]]
    for i in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
        same[i] = np.array_equal(raw[start[i] : end[i]], other[other_start[i] : other_end[i]])
    return same


def classes(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each row, first row of each class): equal keys and the same by ``same``, which compares rows at two arrays of places."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    each = np.arange(len(keys))
    again = np.flatnonzero(first[inverse] != each)
    todo = again[~same(again, first[inverse[again]])]
    while len(todo):  # rows that only share the key of their class's first row
        _, lead, within = np.unique(keys[todo], return_index=True, return_inverse=True)
        hit = same(todo, todo[lead][within])
        inverse[todo[hit]] = len(first) + within[hit]
        first = np.concatenate([first, todo[lead]])
        todo = todo[~hit]
    return inverse, first


def span_classes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each span, first span of each class) by their bytes."""
    return classes(span_hashes(raw, start, end), lambda i, j: same_spans(raw, start[i], end[i], raw, start[j], end[j]))


def strong_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a bijection of up to eight bytes, else BLAKE2b, taken once for each distinct span."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    inverse, first = span_classes(raw, start, end)
    s, e = start[first], end[first]
    size = e - s
    out = mix(_masked(_lanes(raw)[s], size))
    # zero bytes at the end would look like a shorter span
    for i in np.flatnonzero((size > 8) | (raw[np.maximum(e, 1) - 1] == 0) | (size == 0)).tolist():
        out[i] = _digest(raw[s[i] : e[i]])
    return out[inverse]


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte boundary, the number of code points before it."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
