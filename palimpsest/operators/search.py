"""Which of many values stand in which texts: exact substring search that shuffles no text."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = 8  # a value's first bytes, by which places in a text are told apart first
BITS = 26  # either filter has 2 ** BITS bits, 8 MB, whatever the number of values
SLICE = 1 << 20  # bytes of text looked at at a time
BASE, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Places in a filter from 64-bit numbers."""
    h = h + np.uint64(BASE * (seed + 1) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(64 - BITS)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _heads(raw: bytes, n: int) -> np.ndarray:
    """The HEAD bytes from each of n places on, as numbers; raw goes on for HEAD bytes behind the last place."""
    return np.ndarray((n,), "<u8", raw, 0, (1,)).copy()


def _places(raw: bytes) -> list[tuple[int, int]]:
    """(filter, place) of a value: one by its first bytes, two by all of it."""
    n = min(HEAD, len(raw))
    head = np.array([int.from_bytes(raw[:n], "little")], np.uint64)
    x = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    whole = np.array([(x * _powers(BASE, len(x))).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(raw))
    return [(0, int(_mixed(head, n)[0])), (1, int(_mixed(whole, 100)[0])), (1, int(_mixed(whole, 200)[0]))]


def _summary(batches):
    for b in batches:
        out = []
        for v in b.column(0).to_pylist():
            out += [(f, p >> 6, 1 << (p & 63)) for f, p in _places(v)]
            out.append((2, len(v), 0))
        f, at, bits = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(at, pa.int32()), pa.array(np.array(bits, np.uint64).view(np.int64))], ["filter", "at", "bits"])


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1


def _finder(heads: np.ndarray, wholes: np.ndarray, lengths: list[int]):
    """A function from texts, an Arrow array without nulls, to the (row, value) pairs that may be values of the filters."""
    longest = max(lengths)
    up, down = _powers(BASE, SLICE + max(longest, HEAD)), _powers(BACK, SLICE)

    def find(texts: pa.Array) -> set[tuple[int, bytes]]:
        bodies = [t.as_buffer() for t in texts]
        ends, raw = np.cumsum([len(t) for t in bodies]), b"".join(bodies)
        found = set()
        for a in range(0, len(raw), SLICE):
            n = min(SLICE, len(raw) - a)
            part = raw[a : a + n + max(longest, HEAD)]
            first = _heads(part + bytes(HEAD), n)
            sums = None
            for k in sorted({min(HEAD, m) for m in lengths}):
                at = np.flatnonzero(_has(heads, _mixed(first & np.uint64((1 << 8 * k) - 1), k)))
                if not len(at):
                    continue
                if sums is None:
                    x = (np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(part)]
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                row = np.searchsorted(ends, at + a, side="right")
                room = ends[row] - a - at
                for m in [m for m in lengths if min(HEAD, m) == k]:
                    p, r = at[room >= m], row[room >= m]
                    h = (sums[p + m] - sums[p]) * down[p] + np.uint64(m)
                    hit = _has(wholes, _mixed(h, 100)) & _has(wholes, _mixed(h, 200))
                    found.update((int(i), part[q : q + m]) for i, q in zip(r[hit], p[hit].tolist()))
        return found

    return find


def held(texts: DataFrame, text: str, values: DataFrame) -> DataFrame:
    """The rows of texts (without the column text) with each of values (value: distinct strings, none empty) that it holds.

    values are read once, now, for two filters of fixed size and once for the join. Every
    place of a text is tried by the first bytes of the values, then by all bytes for each of their lengths; what passes
    is joined with the values as it stands in the text, so the filters lose nothing and the join decides. What is
    shuffled grows with the values found (and beyond some 5 million values with what passes by chance), not with the texts.
    """
    needles = values.select(F.col("value").cast("binary").alias("value"))
    marks = needles.mapInArrow(_summary, "filter int, at int, bits long").groupBy("filter", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    which, at, bits = (marks.column(c).to_numpy() for c in ("filter", "at", "bits"))
    filters = [np.zeros(1 << BITS - 6, np.uint64) for _ in range(2)]
    for k, f in enumerate(filters):
        f[at[which == k]] = bits[which == k].view(np.uint64)
    lengths = sorted(at[which == 2].tolist())
    keys = [c for c in texts.columns if c != text]
    if not lengths:
        return texts.select(*keys, F.lit(None).cast("string").alias("value")).where("false")
    schema = T.StructType([*[texts.schema[c] for c in keys], T.StructField("value", T.BinaryType())])

    def run(batches):
        find = _finder(*filters, lengths)
        for b in batches:
            found = sorted(find(b.column(b.num_columns - 1)))
            rows = b.select(keys).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([v for _, v in found], pa.binary())], [*keys, "value"])

    near = texts.where(F.col(text).isNotNull()).select(*keys, text).mapInArrow(run, schema)
    return near.join(needles, "value", "left_semi").select(*keys, F.col("value").cast("string").alias("value"))
