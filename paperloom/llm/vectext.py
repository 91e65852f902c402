"""Vectorised text primitives over Arrow batches: words, hashes, shingles.

Everything works on the raw UTF-8 buffer of a block of documents, so the cost
per byte is a handful of numpy passes.  Blocks are bounded in bytes (one longer
document forms a block of its own), so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once.
BLOCK_BYTES = 1 << 20
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64


def _odd_constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | _U(1)


_BYTE_CODES = {k: np.random.default_rng(100 + k).integers(1, 1 << 63, 256, dtype=np.uint64) for k in (0, 1)}
_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
_POSITION = _odd_constants(7, 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words (splitmix finaliser); returns a new array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n; kept only up to the size of a block."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        base = _BASE[which]
        inverse = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inverse):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done = 1
            step = _U(b)
            while done < size:  # doubling: out[done:2*done] = out[:done] * b**done
                take = min(done, size - done)
                np.multiply(out[:take], step, out=out[done : done + take])
                step = _U((int(step) * int(step)) & ((1 << 64) - 1))
                done += take
            tables.append(out)
        have = tables[0], tables[1]
        if size <= BLOCK_BYTES + 1:
            _powers[which] = have
    return have


class Hasher:
    """Hashes of byte ranges of one buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        forward, self._back = _power_tables(len(data), which)
        sums = np.empty(len(data) + 1, dtype=np.uint64)
        sums[0] = 0
        codes = _BYTE_CODES[which][data]
        codes *= forward[: len(data)]
        np.cumsum(codes, out=sums[1:])
        self._sums = sums

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._back[start]
        return mix64(raw + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = BLOCK_BYTES) -> np.ndarray:
    """Hashes of words in order, as ``Hasher(data).ranges(start, end)`` gives them.

    A long text is hashed in segments of ``limit`` bytes, a longer word piece by
    piece: memory follows the number of words, not of bytes.
    """
    if len(data) <= limit:
        return Hasher(data).ranges(start, end)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + limit, side="right"))
        if j > i:
            base = int(start[i])
            out[i:j] = Hasher(data[base : int(end[j - 1])]).ranges(start[i:j] - base, end[i:j] - base)
        else:  # one word of more than limit bytes
            j, size = i + 1, int(end[i] - start[i])
            raw, shift = 0, 1
            for at in range(int(start[i]), int(end[i]), limit):
                piece = data[at : min(at + limit, int(end[i]))]
                forward, _ = _power_tables(len(piece), 0)
                raw += shift * int((_BYTE_CODES[0][piece] * forward[: len(piece)]).sum(dtype=np.uint64))
                shift = shift * pow(_BASE[0], len(piece), 1 << 64) % (1 << 64)
            out[i : i + 1] = mix64(np.array([(raw + size * 0xA24BAED4963EE407) % (1 << 64)], np.uint64))
        i = j
    return out


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split an Arrow string column into blocks of at most ``limit`` bytes.

    Yields (first row, row after the last, bytes, offsets of the rows in bytes);
    a null text counts as an empty one.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offsets_buf, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-space bytes inside a row."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    word = ~IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[:-1][(offsets[:-1] < len(data))]
    begins[heads] = word[heads]
    start = np.flatnonzero(begins)
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = word[tails]
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def shingles(token_hash: np.ndarray, row: np.ndarray, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and its row.

    A row with fewer words (but at least one) gives one shingle: all of them.
    """
    n = len(token_hash)
    counts = np.bincount(row, minlength=rows) if n else np.zeros(rows, dtype=np.int64)
    out_h, out_r = [], []
    if n >= size:
        total = token_hash[: n - size + 1] * _POSITION[0]
        for k in range(1, size):
            total += token_hash[k : n - size + 1 + k] * _POSITION[k]
        inside = row[: n - size + 1] == row[size - 1 :]
        out_h.append(mix64(total[inside]))
        out_r.append(row[: n - size + 1][inside])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[short]
        hashes = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            hashes[has] += token_hash[first[has] + k] * _POSITION[k]
        out_h.append(mix64(hashes + counts[short].astype(np.uint64) * _POSITION[40]))
        out_r.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    if len(out_h) == 2:
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def distinct_sorted(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted inside the row; and row offsets (rows + 1)."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    h = h.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    if len(h) > 1:
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    cum = np.concatenate(([0], np.cumsum(keep)))
    return h[keep], cum[bounds]


def shingle_sets(column, size: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows: (first row, last row, distinct shingle hashes, row offsets)."""
    for first, last, data, offsets in text_blocks(column):
        low = LOWER[data]
        start, end, row = words(low, offsets)
        tokens = word_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
        h, r = shingles(tokens, row, last - first, size)
        sets, bounds = distinct_sorted(h, r, last - first)
        yield first, last, sets, bounds
