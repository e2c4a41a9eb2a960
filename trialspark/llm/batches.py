"""Arrow batches as flat numpy arrays: text bytes, words, shingles and rolling hashes.

Everything here works on one batch inside a task. A text column is read as the
batch's own byte buffer with offsets, so no text becomes a Python string unless
an operator asks for it. Words are runs of bytes other than ``\\x20`` and
``\\x09-\\x0D``; that is the same as on characters, because those bytes never
occur inside a longer UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts handled at once inside a task; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_tables: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(n + n // 2, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


class RollingHash:
    """Hashes of any range of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        powers, self._inverse = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + length)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each row; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text, their bytes and offsets."""
    data, at = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_BYTES = np.arange(256)
#: Bytes between words: white space, or all of ASCII but letters and digits.
SPACES = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
NOT_ALPHANUMERIC = (_BYTES < 128) & ~np.array([chr(b).isalnum() for b in range(256)])


# Code points of scripts that are written without blanks between words.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF),
    (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9DF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
# Their punctuation, and full-width punctuation.
_MARKS = ((0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0xFE30, 0xFE4F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _within(code: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    place = np.searchsorted([a for a, _ in ranges], code, "right") - 1
    return (place >= 0) & (code <= np.array([b for _, b in ranges])[place])


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where a character of a script without blanks starts or ends, and bytes of its punctuation."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return lead, lead
    size = np.where(data[lead] >= 0xF0, 4, 3)
    byte = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & 0x3F for i in range(1, 4)]
    three = (data[lead].astype(np.int64) & 0x0F) << 12 | byte[0] << 6 | byte[1]
    four = (data[lead].astype(np.int64) & 0x07) << 18 | byte[0] << 12 | byte[1] << 6 | byte[2]
    code = np.where(size == 4, four, three)
    own, marks = _within(code, _UNSPACED), _within(code, _MARKS)
    return np.concatenate([lead[own], lead[own] + size[own]]), np.concatenate([lead[marks] + i for i in range(3)])


class Words:
    """The words of a chunk: byte ranges, and for each row the range of its words.

    With ``split`` each character of a script without blanks is a word.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, between: np.ndarray = SPACES, split: bool = False):
        space = between[data]
        cuts = at
        if split:
            more, marks = unspaced(data)
            cuts = np.concatenate([at, more])
            space[marks] = True
        before = np.ones(len(data) + 1, bool)
        before[1:] = space
        before[cuts] = True
        after = np.ones(len(data) + 1, bool)
        after[:-1] = space
        after[cuts] = True
        self.starts = np.flatnonzero(~space & before[:-1])
        self.ends = np.flatnonzero(~space & after[1:]) + 1
        self.rows = np.searchsorted(self.starts, at)
        self.data = data

    def hashes(self) -> np.ndarray:
        return RollingHash(_BYTE_VALUES[self.data]).of(self.starts, self.ends)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row, the distinct shingles of ``size`` words, sorted.

    A row with fewer words has one shingle, its whole word sequence; a row
    without words has none.
    """
    rolling = RollingHash(hashes)
    out = []
    for start, end in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if end - start >= size:
            first = np.arange(start, end - size + 1)
            out.append(distinct(rolling.of(first, first + size)))
        else:
            ends = np.array([start, end] if end > start else [], np.int64)
            out.append(rolling.of(ends[:1], ends[1:]))
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value of each window; the leftmost of equal ones.

    Values are compared by their upper 40 bits; the lower ones hold the index,
    so longer sequences are taken in overlapping parts.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    if n > 1 << 24:
        part = (1 << 24) - width
        return np.concatenate([s + sliding_argmin(values[s : s + part + width - 1], width) for s in range(0, n - width + 1, part)])
    low = np.uint64(0xFFFFFF)
    packed = (values & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low).astype(np.int64)


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(values.view(np.int64))


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of equal ``key`` from batches sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[start] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            held_key = keys[start]
    if held:
        yield pa.Table.from_batches(held)


def span_lists(batch: pa.RecordBatch) -> list[dict[str, np.ndarray]]:
    """The starts and ends of each row's ``spans``; an empty dict for a null."""
    lists = batch.column("spans")
    at = lists.offsets.to_numpy()
    s, e = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e"))
    some = lists.is_valid().to_numpy(zero_copy_only=False)
    return [{"s": s[at[i] : at[i + 1]], "e": e[at[i] : at[i + 1]]} if some[i] else {} for i in range(len(lists))]
