"""Words of texts as arrays: their places and 64-bit hashes, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once, and multipliers for the bytes of a word.
BLOCK, MULTIPLIERS = 1 << 21, 1 << 16
_TABLES: dict[int, np.ndarray] = {}


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _multipliers(lane: int) -> np.ndarray:
    if lane not in _TABLES:
        _TABLES[lane] = np.random.PCG64(lane).random_raw(MULTIPLIERS).astype(np.uint64)
    return _TABLES[lane]


def places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the text it is in: texts that begin at at[:-1] (at[-1]: the end), words separated by one space."""
    spaces = np.flatnonzero(data == 32)
    full = np.flatnonzero(np.diff(at))
    begins = np.sort(np.concatenate([at[full], spaces + 1]), kind="stable")
    ends = np.sort(np.concatenate([spaces, at[full + 1]]), kind="stable")
    return begins, ends, np.searchsorted(at, begins, "right") - 1


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of each word: the sum of its bytes (plus one), each times a random multiplier of its place, mixed. Lanes are independent."""
    table, out, first = _multipliers(lane), np.empty(len(begins), np.uint64), 0
    while first < len(begins):
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + BLOCK)))
        low = begins[first]
        block = data[low : ends[last - 1]]
        own = begins[first:last] - low
        place = np.arange(len(block)) - np.repeat(own, np.diff(own, append=len(block)))
        values = block.astype(np.uint64)
        values += np.uint64(1)
        values[block == 32] = 0  # what separates words adds nothing
        if len(block) > MULTIPLIERS and place.max() >= MULTIPLIERS:
            values *= mixed(table[place & (MULTIPLIERS - 1)], (place >> 16).astype(np.uint64))
        else:
            values *= table[place]
        out[first:last] = np.add.reduceat(values, own)
        first = last
    return mixed(out, np.full(1, lane, np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and the place where each text begins and the last one ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Batches put together until their texts have size bytes or more."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.column(column).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
