"""Vectorised text kernels over Arrow string buffers.

Every function works on a slice of a batch: ``data`` is the UTF-8 bytes of some
consecutive rows and ``off`` the row offsets into it. A null text is an empty
one. Slices hold about ``CHUNK_BYTES`` (or one longer text), so temporaries stay
small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_quick: dict[str, np.ndarray] = {}

#: Bytes of words between ASCII white space (space, \t, \n, \v, \f, \r).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII digits and letters and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Maps A-Z to a-z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_P = _U((1 << 31) - 1)
#: Residue fields are 31 bits wide; two bases make a hash, a second pair of bases an independent one.
_BASES = ((0x3A8F05C5, 0x51E7B2D3), (0x1F6A9C8B, 0x6C9E3777))
_STEP = 1 << 12
_STRETCH = 1 << 14


def _folded(x: np.ndarray) -> np.ndarray:
    """A value congruent modulo 2**31 - 1, below 2**33."""
    return (x & _P) + (x >> _U(31))


def _residue(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.where(x >= _P, x - _P, x)


def _series(first: int, base: int, n: int) -> np.ndarray:
    """first * base**i for i < n, modulo 2**31 - 1."""
    out = np.empty(max(n, 1), _U)
    out[0] = first
    size, step = 1, base % int(_P)
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = _residue(out[:more] * _U(step))
        size, step = size + more, step * step % int(_P)
    return out[:n]


class _Powers:
    """Powers of a base, and of its inverse as products of two short tables."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(_P))
        self.rising = np.empty(0, _U)
        self.low, self.high = _series(1, self.inverse, _STEP), np.empty(0, _U)

    def up(self, n: int) -> np.ndarray:
        if self.rising.size < n:
            self.rising = _series(1, self.base, 1 << max(16, n.bit_length()))
        return self.rising[:n]

    def down(self, at: np.ndarray, most: int) -> np.ndarray:
        if self.high.size <= most // _STEP:
            self.high = _series(1, pow(self.inverse, _STEP, int(_P)), max(1 << 10, most // _STEP + 1))
        return _residue(self.low[at % _STEP] * self.high[at // _STEP])


_powers = [[_Powers(b) for b in pair] for pair in _BASES]
_TABLES = [[_residue(mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95 + 2 * (2 * i + j)))) for j in range(2)] for i in range(2)]


class Running:
    """Sums over a sequence whose differences hash any range of it; see ``range_hash``. ``fields`` gives the residues of a stretch by base."""

    def __init__(self, size: int, fields, second: bool):
        self.second, self.size = second, size + 1
        self.sums = [np.zeros(size + 1, np.uint64) for _ in range(2)]
        rising = [x.up(size) for x in _powers[second]]
        for a in range(0, size, _STRETCH):  # stretches that stay in the cache
            b = min(a + _STRETCH, size)
            for j, values in enumerate(fields(a, b)):
                x = values * rising[j][a:b]
                low = x & _P
                x >>= _U(31)
                x += low  # below 2**32
                x[0] += self.sums[j][a]
                np.cumsum(x, out=self.sums[j][a + 1 : b + 1])


def string_slices(column, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(column, pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + chunk, side="right")) - 1, i + 1), n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (one more at the end)."""
    n = data.size
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(off.size, np.int64)
    is_word = table[data]
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_hash(data: np.ndarray, second: bool = False) -> Running:
    """For hashes of ranges of bytes. ``second``: an independent hash."""
    return Running(data.size, lambda a, b: [table[data[a:b]] for table in _TABLES[second]], second)


def value_prefix_hash(values: np.ndarray, second: bool = False) -> Running:
    """As ``prefix_hash``, for a sequence of 64-bit values."""
    values = mix(values ^ _U(0x5851F42D4C957F2D)) if second else values
    return Running(values.size, lambda a, b: [_residue(values[a:b] & _U(0xFFFFFFFF)), _residue(values[a:b] >> _U(32))], second)


def range_hash(running: Running, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges, alike for equal content wherever it lies: two polynomials modulo 2**31 - 1, and the length."""
    fields = []
    for sums, powers in zip(running.sums, _powers[running.second], strict=True):
        fields.append(_residue(_residue(_residue(sums[ends] - sums[starts]) * powers.down(starts, running.size))))
    return mix(((fields[0] << _U(31)) | fields[1]) ^ mix((ends - starts).astype(np.uint64) + _U(0xA24BAED4963EE407)))


def window_hash(values: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each ``size`` consecutive 64-bit values."""
    if values.size < size:
        return values[:0]
    out, width = mix(values), 1
    while width < size:
        step = min(width, size - width)  # the last step may overlap
        out = mix(out[: out.size - step] * _U(0x9E3779B97F4A7C15) + (out[step:] ^ _U(width + step)))
        width += step
    return out


#: Spread values of bytes, for ``rolling``.
SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x8EBC6AF09C88C6E3))


def rolling(values: np.ndarray, size: int, order: int = 0) -> np.ndarray:
    """A quick hash of each ``size`` consecutive values (themselves hashes), to choose minimisers with, under several orders: unequal content may well collide."""
    n = values.size - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    if "up" not in _quick or _quick["up"].size <= values.size:
        most = 1 << max(16, int(values.size + 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(most, base, np.uint64)
            steps[0] = 1
            _quick[name] = np.multiply.accumulate(steps)
    running = np.zeros(values.size + 1, np.uint64)
    for a in range(0, values.size, _STRETCH):
        x = values[a : a + _STRETCH] * _quick["up"][a : min(a + _STRETCH, values.size)]
        x[:1] += running[a : a + 1]  # modulo 2**64
        np.cumsum(x, out=running[a + 1 : a + 1 + x.size])
    out = np.empty(n, np.uint64)
    salt = _U(order * 0x9E3779B97F4A7C15 % 2**64)
    for a in range(0, n, _STRETCH):
        b = min(a + _STRETCH, n)
        x = running[a + size : b + size] - running[a:b]
        x *= _quick["down"][a:b]
        x ^= salt
        out[a:b] = mix(x)
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted; a row with fewer words has its whole sequence as one."""
    all_of = window_hash(hashes, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(all_of[a : b - size + 1]))
        elif b > a:
            out.append(mix(window_hash(hashes[a:b], b - a) ^ _U(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum (``pick``) of each ``width`` consecutive values."""
    if values.size < width:
        return values[:0]
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:-rest], out[rest:]) if rest else out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units lie in a window of ``width`` units at one of ``starts``."""
    steps = np.zeros(n + width + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps)[:n] > 0


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    running = np.zeros(values.size + 1, np.int64)
    np.cumsum(values, out=running[1:])
    return running[off[1:]] - running[off[:-1]]
