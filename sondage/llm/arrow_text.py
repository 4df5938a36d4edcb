"""Whole texts as byte buffers: words, their 64-bit hashes and word shingles, by numpy over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; arrays of eight times the size are made of them.
CHUNK = 1 << 19
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
#: The bytes of a lane that belong to a span with so many bytes left.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
#: Spans of more bytes are hashed one by one.
_LONG = 4096
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table that is False for the bytes of the given spans (both ends included)."""
    out = np.ones(256, bool)
    for low, high in spans:
        out[low : high + 1] = False
    return out


#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of texts in lower case.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK, most: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of up to ``most`` texts of about ``size`` bytes: first and last + 1 text, their bytes and offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(first + most, max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the text that each is in."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes in any process.

    Lanes of eight bytes are taken in one after the other, each mixed with all before it.
    """
    size = (ends - starts).astype(np.int64)
    h = mix(size.astype(_U) * _U(_P))
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -_LONG, "left"))
    for i in order[:long].tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, "<u8")[0]
    live, at = order[long:], 0
    while len(live):
        lane = lanes[starts[live] + at] & _MASK[np.minimum(size[live] - at, 8)]
        h[live] = mix((h[live] ^ lane) + _U(_P))
        at += 8
        live = live[: int(np.searchsorted(-size[live], -at, "left"))]
    return h


def shingles(words: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted hashes, and the n_texts + 1 offsets of the texts.

    A text of 1 to k - 1 words has one shingle, its whole sequence; one without words has none.
    """
    count = np.bincount(text, minlength=n_texts)
    ends = np.cumsum(count)
    begins = ends - count
    whole = np.zeros(0, _U), np.zeros(0, np.int64)
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, _U)
        for i in range(k):
            h = mix(h + words[i : len(words) - k + 1 + i] * _U(_P) + _U(i + 1))
        ok = text[: len(h)] == text[k - 1 :]
        whole = h[ok], text[: len(h)][ok]
    short = np.flatnonzero((count > 0) & (count < k))
    extra = np.zeros(len(short), _U)
    for i in range(k - 1):
        has = count[short] > i
        at = np.minimum(begins[short] + i, max(len(words) - 1, 0))
        extra = np.where(has, mix(extra + words[at] * _U(_P) + _U(i + 1)), extra) if len(short) else extra
    extra = mix(extra ^ _U(0x5851F42D4C957F2D))
    h, t = np.concatenate([whole[0], extra]), np.concatenate([whole[1], short])
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[new], t[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n_texts))])


def texts_shingles(column: pa.Array, table: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, last + 1, sorted shingle hashes and offsets; A-Z in lower case."""
    data, offsets = buffers(column)
    for first, last, part, cut in chunks(data, offsets):
        part = LOWER[part]
        starts, ends, text = word_bounds(part, cut, table)
        yield first, last, *shingles(span_hashes(part, starts, ends), text, last - first, k)


def binary_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The runs of ``values`` between ``offsets`` as binary values."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def by_groups(batches: Iterable[pa.RecordBatch], keys: list[str], act: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Calls ``act(table, starts)`` with whole groups of rows that follow each other with equal integer keys.

    ``starts`` are the first rows of the groups and the number of rows. The rows must be sorted by the keys; what is
    held is one group and ``rows`` rows at most.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            x = table[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        whole = len(table) if last else int(starts[-1])
        rest = table.slice(whole)
        held, n = rest.to_batches(), len(rest)
        if whole:
            yield from act(table.slice(0, whole), np.append(starts[starts < whole], whole))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from cut(False)
    if held:
        yield from cut(True)
