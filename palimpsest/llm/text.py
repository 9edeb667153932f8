"""Vectorised byte kernels over Arrow string columns: words, word hashes, code-point offsets."""

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column) -> pa.Array:
    """A plain string array without nulls (null: empty)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    return a.cast(pa.large_string()).fill_null("")


def chunks(a: pa.Array, most: int = 1 << 20):
    """Slices (from, to) of whole texts of about `most` bytes together, one text at least."""
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, len(a))
        i = min(j, len(a))


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and its offsets into them."""
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


_powers: dict = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get("p")
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[:] = _P
        down[:] = _PINV
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        got = (up, down)
        if size <= 1 << 22:
            _powers["p"] = got
    return got


class Words:
    """The words of a slice of texts. doc: index of the text; start, end: byte positions; hash: 64 bits."""

    def __init__(self, a: pa.Array, lower: bool = True, separator: np.ndarray = SEPARATOR):
        data, off = raw(a)
        self.off, self.n_docs = off, len(off) - 1
        if lower:
            data = LOWER[data]
        self.data = data
        n = len(data)
        if not n:
            self.doc = self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(self.n_docs + 1, np.int64)
            self._sum = np.zeros(1, np.uint64)
            return
        sep = separator[data]
        edge = np.empty(n, bool)
        edge[0] = True
        edge[1:] = sep[:-1]
        edge[off[:-1][off[:-1] < n]] = True
        begin = ~sep & edge
        last = np.empty(n, bool)
        last[:-1] = sep[1:]
        last[-1] = True
        ends = off[1:]
        last[ends[ends > 0] - 1] = True
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(~sep & last) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        up, _ = _power(n + 1)
        s = np.empty(n + 1, np.uint64)
        s[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=s[1:])
        self._sum = s
        self.hash = self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _power(len(self.data) + 1)
        return mix64((self._sum[end] - self._sum[start]) * down[start] + (end - start).astype(np.uint64))


def hash_of(words: list[str]) -> np.ndarray:
    """The same 64-bit hashes for single words."""
    if not words:
        return np.zeros(0, np.uint64)
    w = Words(pa.array(words, pa.large_string()), lower=False, separator=np.zeros(256, bool))
    out = np.zeros(len(words), np.uint64)
    out[w.doc] = w.hash
    return out
