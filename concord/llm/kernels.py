"""NumPy kernels over Arrow string columns: words, 64-bit word hashes and rolling window hashes.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 never uses those bytes inside a
longer character, so splitting bytes equals splitting characters.  A word's hash is a multilinear
hash of its bytes with fixed random tables, finished by a 64-bit mixer; texts are worked through in
bounded segments, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 21
_PERIOD = 1 << 16
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, _PERIOD, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different salts give independent values."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, dtype=np.uint8)
    offsets = offsets.astype(np.int64) if len(offsets) else np.zeros(1, dtype=np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts come to about ``limit`` bytes; a longer text makes a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _segment(raw: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in ``raw``; no word crosses a place in ``cuts``."""
    word = ~_SPACE[raw]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[cuts] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.concatenate([place[: starts[0]], np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    values = table[raw] * _PLACE[place & (_PERIOD - 1)]
    if (ends - starts).max() > _PERIOD:
        values *= ((place >> 16) * 2 + 1).astype(np.uint64)
    return starts, ends, mix(np.add.reduceat(values, starts))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False):
    """Hashes of all words of all rows and each row's first word: ``(hashes, firsts)``.

    With ``spans`` also each word's byte start and end.  ``lower`` takes A-Z as a-z.
    """
    table = _LOWER if lower else _BYTE
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, rows = 0, offsets[:-1]
    while at < len(raw):
        to = at + SEGMENT
        while to < len(raw):
            gap = np.flatnonzero(_SPACE[raw[to : to + SEGMENT]])
            row = np.searchsorted(rows, to)
            edge = int(rows[row]) if row < len(rows) else len(raw)
            to = min(edge, to + int(gap[0])) if len(gap) else min(edge, to + SEGMENT)
            if len(gap) or to == edge:
                break
        to = min(to, len(raw))
        lo, hi = np.searchsorted(rows, [at, to])
        s, e, h = _segment(raw[at:to], rows[lo:hi] - at, table)
        parts.append((s + at, e + at, h))
        at = to
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts, ends, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    firsts = np.searchsorted(starts, offsets)
    return (hashes, firsts, starts, ends) if spans else (hashes, firsts)


def runs(firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words that stay within a row, and each one's row."""
    count = np.maximum(np.diff(firsts) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    shift = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(shift, count) + np.repeat(firsts[:-1], count), row


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        n = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 2**64)):
            factors = np.full(n, b, dtype=np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors))
        _powers[base] = (both[0], both[1])
    return _powers[base]


#: Odd multipliers of the rolling hashes: fixed values.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def windows(hashes: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hash of the ``size`` words that begin at each place (``len - size + 1`` of them)."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    chunk, out = 1 << 20, []
    up, down = _power(BASES[family], chunk + size)
    for at in range(0, len(hashes) - size + 1, chunk):
        part = hashes[at : at + chunk + size - 1]
        part = mix(part, 17) if family else part
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        n = len(part) - size + 1
        out.append(mix((total[size : size + n] - total[:n]) * down[:n], family + 1))
    return np.concatenate(out)
