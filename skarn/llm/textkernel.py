"""Arrow and numpy kernels over whole batches of texts, used inside tasks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one kernel call works on, about; a longer text is a call of its own.
CHUNK_BYTES = 1 << 20


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES, rows: int = 1 << 40) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``most`` bytes, of ``rows`` rows at most; at least one row each."""
    size = np.diff(texts(batch.column(column))[1])
    at = np.concatenate(([0], np.cumsum(size)))
    start = 0
    while start < len(size):
        end = min(start + rows, max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1))
        yield start, end
        start = end


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of sorted rows, cut between groups of equal keys."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        last = np.ones(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            last &= c == c[-1]
        cut = table.num_rows - int(last[::-1].argmin() if not last.all() else table.num_rows)
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


#: Lower case for A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def encoded(flat: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values among byte strings that lie one after the other, and the number of each string's value: equal bytes, equal number."""
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


class Words:
    """The words of a chunk of texts: runs without ASCII white space, or of the bytes that ``inside`` marks.

    start, end: byte places; doc: the text of each word; first: index of each text's first word, and
    the number of all words at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marked: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        self.marked = ~SPACE[data] if marked is None else marked
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = self.marked
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        cut = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[cut] = inside[cut]  # a word ends with its text
        ends = inside[:-1] & ~inside[1:]
        if len(cut):
            last = cut[cut > 0] - 1
            ends[last] |= inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def numbered(self, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and the number of each word among them."""
        flat = self.data[self.marked]
        return encoded(LOWER[flat] if lower else flat, self.end - self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words: XXH64 of each distinct one."""
        from xxhash import xxh64_intdigest

        words, number = self.numbered()
        return np.fromiter((xxh64_intdigest(w, 20240229) for w in words.to_pylist()), np.uint64, len(words))[number]


def windows(values: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n values from each place on that lie in one text, and the places."""
    count = np.diff(first)
    many = np.maximum(count - n + 1, 0)
    total = int(many.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(many)
    place = np.arange(total) + np.repeat(first[:-1] - (ends - many), many)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + values[place + k])
    return out, place
