"""Benchmark decontamination: CGK embeddings of windows, bit-sampling LSH, exact edit verification."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, named, plain, small_batches
from .text import SEPARATOR, Words, chunks, mix64, strings

#: Words end at ASCII marks as well as at whitespace.
BOUNDS = SEPARATOR.copy()
BOUNDS[:128] = True
BOUNDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: Words that no item has share this many symbols.
OTHERS = 1024
#: Items of so many words or more are found by pieces: few walks as long survive the edits allowed.
LONG = 128
#: Cells of the edit distance's table that are held at a time.
CELLS = 1 << 21


def edits_allowed(n: int, similarity: float) -> int:
    """Word edits within which a passage counts as a copy of an item of n words."""
    return int((1 - similarity) * n + 1e-9)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A key for each run of n words."""
    m = max(0, len(words) - n + 1)
    key = words[:m]
    for k in range(1, n):
        key = mix64(key) + words[k : m + k]
    return key


class Scheme:
    """One repetition for items of a length class: a CGK walk and the sampled steps.

    The CGK embedding reads a string with a pointer: step j emits the symbol under it and moves on by a random bit
    of (j, symbol). Strings at edit distance k become sequences at Hamming distance O(k^2) with constant
    probability. An LSH key is the symbols at a few sampled steps, all within the item-sized window. The first
    sampled step is 0: the walk of an item begins at one of its rarer words (its anchor, another one in each
    repetition), so a window whose first symbol begins no item's walk is dropped before it walks.
    """

    def __init__(self, salt: int, steps: np.ndarray, anchors: dict):
        self.salt, self.steps, self.anchors = salt, steps, anchors

    def bits(self, j: int, symbols: int) -> np.ndarray:
        return (mix64(np.arange(symbols, dtype=np.uint64) + np.uint64((self.salt * 4096 + j) << 32)) & np.uint64(1)).astype(np.int32)


class Index:
    """The items' symbols and, for each length class and repetition, the sorted LSH keys.

    A class whose copies the repetitions do not find with the wanted recall, and every class of LONG words or more, is
    found by pieces: an item cut into one piece more than the edits allowed has one that no edit touches.
    """

    def __init__(self, ids: list, texts: list[str], similarity: float, recall: float, samples: int = 3, most: int = 24, seed: int = 5):
        w = Words(strings(pa.array(texts, pa.string())), separator=BOUNDS)
        self.similarity = similarity
        self.ids, self.items = [], []
        for k, i in enumerate(ids):
            words = w.hash[w.first[k] : w.first[k + 1]]
            if len(words):  # an item without words is contained in nothing
                self.ids.append(i)
                self.items.append(words)
        self.vocabulary = np.unique(np.concatenate(self.items)) if self.items else np.zeros(0, np.uint64)
        self.symbols = len(self.vocabulary) + OTHERS
        self.count = np.zeros(self.symbols, np.int64)
        for x in self.items:
            np.add.at(self.count, self.symbol(x), 1)
        self.classes, pieced = [], []
        sizes = np.array([len(x) for x in self.items], np.int64)
        r = np.random.default_rng(seed)
        low = 1
        while len(sizes) and low <= sizes.max():
            own = np.flatnonzero((sizes >= low) & (sizes < 2 * low))
            if len(own):
                reps = self._repetitions(own, low, recall, samples, most, r) if low < LONG else None
                if reps is None:
                    pieced += own.tolist()
                else:
                    self.classes.append(reps)
            low *= 2
        self.pieces = self._pieces(pieced)

    def symbol(self, hashes: np.ndarray) -> np.ndarray:
        v = len(self.vocabulary)
        at = np.searchsorted(self.vocabulary, hashes)
        known = self.vocabulary[np.minimum(at, v - 1)] == hashes if v else np.zeros(len(hashes), bool)
        return np.where(known, at, v + (hashes & np.uint64(OTHERS - 1)).astype(np.int64)).astype(np.int32)

    def _repetitions(self, own: np.ndarray, low: int, recall: float, samples: int, most: int, r) -> list:
        """Adds repetitions until `recall` of items with as many random edits as allowed share a key; None if `most` do not do.

        Walks start early enough to stay within their item; the copies are followed by other words.
        """
        span = int(0.6 * low)
        reps, probes = [], []
        for i in own:
            for _ in range(-(-1000 // len(own))):
                probes.append((i, self.symbol(self._edited(self.items[i], edits_allowed(len(self.items[i]), self.similarity), r))))
        rare = {}
        for i in own:
            n = len(self.items[i])
            x = self.symbol(self.items[i])[: max(1, min(int(0.6 * n), n - span))]
            rare[int(i)] = np.argsort(self.count[x], kind="stable")[:8]
        hit = np.zeros(len(probes), bool)
        recall = min(1.0, recall + 2 * (recall * (1 - recall) / len(probes)) ** 0.5)  # two deviations over, as the probes decide when to stop
        pad = (self.symbols - 1 - r.integers(0, OTHERS, 2 * low + 8)).astype(np.int32)
        while len(reps) < most and hit.mean() < recall:
            anchors = {i: int(x[len(reps) % len(x)]) for i, x in rare.items()}
            steps = np.unique(np.concatenate([[0], 1 + r.choice(span, min(samples - 1, span), replace=False)]))
            s = Scheme(int(r.integers(1, 1 << 20)), steps, anchors)
            key = np.array([self.walk(s, np.concatenate([self.symbol(self.items[i]), pad]), np.array([anchors[int(i)]]))[0] for i in own])
            wanted = dict(zip(map(int, own), key))
            for k, (i, x) in enumerate(probes):
                hit[k] = hit[k] or wanted[int(i)] in self.walk(s, np.concatenate([x, pad]), np.arange(len(x)))
            order = np.argsort(key, kind="stable")
            reps.append((s, key[order], own[order], np.array([anchors[int(i)] for i in own[order]])))
        return reps if hit.mean() >= recall else None

    def _pieces(self, own: list) -> dict:
        """For each length of a piece: sorted keys, their items and places in the item."""
        found: dict = {}
        for i in own:
            x = self.items[i]
            cut = np.arange(edits_allowed(len(x), self.similarity) + 2) * len(x) // (edits_allowed(len(x), self.similarity) + 1)
            for n in np.unique(np.diff(cut)):
                at = cut[:-1][np.diff(cut) == n]
                found.setdefault(int(n), []).append((runs(x, n)[at], np.full(len(at), i), at))
        for n, parts in found.items():
            key, item, at = map(np.concatenate, zip(*parts))
            order = np.argsort(key, kind="stable")
            found[n] = (key[order], item[order], at[order])
        return found

    def _edited(self, words: np.ndarray, edits: int, r) -> np.ndarray:
        out = list(words)
        for _ in range(edits):
            kind, at = int(r.integers(3)), int(r.integers(len(out)))
            if kind == 0:
                out[at] = np.uint64(r.integers(1 << 62))
            elif kind == 1 and len(out) > 1:
                del out[at]
            else:
                out.insert(at, np.uint64(r.integers(1 << 62)))
        return np.array(out, np.uint64)

    def walk(self, s: Scheme, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The keys of the windows that start at the given places."""
        key, j = np.zeros(len(at), np.int64), 0
        for step in s.steps:
            while j < step:
                at = at + s.bits(j, self.symbols)[flat[at]]
                j += 1
            key = key * self.symbols + flat[at]
        return key

    def candidates(self, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, anchor place) of windows among the first n words that share a key with an item's walk."""
        items, starts, places = [], [], []
        begins = np.zeros(self.symbols, bool)
        for reps in self.classes:
            for s, keys, *_ in reps:
                begins[keys // self.symbols ** (len(s.steps) - 1)] = True
        first = np.flatnonzero(begins[flat[:n]])
        opening = flat[first]
        for reps in self.classes:
            for s, keys, owner, offset in reps:
                own = np.zeros(self.symbols, bool)
                own[keys // self.symbols ** (len(s.steps) - 1)] = True
                place = first[own[opening]]
                at, key, j = place, flat[place].astype(np.int64), 0
                for k, step in enumerate(s.steps[1:], 1):
                    while j < step:
                        at = at + s.bits(j, self.symbols)[flat[at]]
                        j += 1
                    key = key * self.symbols + flat[at]
                    prefixes = np.unique(keys // self.symbols ** (len(s.steps) - 1 - k))
                    spot = np.searchsorted(prefixes, key)
                    ok = prefixes[np.minimum(spot, len(prefixes) - 1)] == key
                    place, at, key = place[ok], at[ok], key[ok]
                a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                m = b - a
                take = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                items.append(owner[take])
                places.append(np.repeat(place, m))
                starts.append(places[-1] - offset[take])
        if not items:
            return (np.zeros(0, np.int64),) * 3
        item, start, place = map(np.concatenate, (items, starts, places))
        _, first = np.unique(np.stack([item, start, place - start]), axis=1, return_index=True) if len(item) else (None, np.zeros(0, int))
        return item[first], start[first], place[first]

    def rows(self, item: int) -> int:
        """Windows of the item to be verified at a time."""
        return max(1, min(4096, CELLS // (2 * len(self.items[item]) + 1)))

    def in_pieces(self, w: Words) -> np.ndarray:
        """Columns (item, text, stretch) where a piece of the item occurs; stretches of edits + 1 starts are tested at once."""
        stretch = np.array([edits_allowed(len(x), self.similarity) + 1 for x in self.items], np.int64)
        out = [np.zeros((3, 0), np.int64)]
        for n, (keys, owner, offset) in self.pieces.items():
            key = runs(w.hash, n)
            a = np.searchsorted(keys, key)
            place = np.flatnonzero(keys[np.minimum(a, len(keys) - 1)] == key)
            a, m = a[place], np.searchsorted(keys, key[place], "right") - a[place]
            ends = np.cumsum(m)
            p = 0
            while p < len(place):  # about CELLS pairs at a time, as a repetitive text and item make very many alike
                q = max(p + 1, int(np.searchsorted(ends, (ends[p - 1] if p else 0) + CELLS, "right")))
                b, c = m[p:q], a[p:q]
                take = np.repeat(c - np.cumsum(b) + b, b) + np.arange(b.sum())
                at = np.repeat(place[p:q], b)
                out.append(np.unique(np.stack([owner[take], w.doc[at], (at - offset[take]) // stretch[owner[take]]]), axis=1))
                p = q
        return np.unique(np.concatenate(out, 1), axis=1)

    def distance(self, item: int, words: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, more: int = 0) -> np.ndarray:
        """Least edit distance between the item and any run of words that lies near each start or the `more` after it, within [low, high)."""
        pattern = self.items[item]
        k = edits_allowed(len(pattern), self.similarity)
        width = len(pattern) + 3 * k + 1 + more
        pos = starts[:, None] - k + np.arange(width)[None, :]
        inside = (pos >= low[:, None]) & (pos < high[:, None])
        text = np.where(inside, words[np.clip(pos, 0, len(words) - 1)], 0)
        ramp = np.arange(width + 1)
        row = np.zeros((len(starts), width + 1), np.int32)
        for i, c in enumerate(pattern):
            same = (text == c) & inside
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, :-1] + ~same, row[:, 1:] + 1)
            row = np.minimum.accumulate(new - ramp, 1) + ramp
        return row.min(1)


def find(index: Index, a: pa.Array) -> list[dict]:
    """For each text the items found in it: item number -> least distance."""
    out: list[dict] = [{} for _ in range(len(a))]
    pad = 2 * max((len(x) for x in index.items), default=1) + 8
    for i, j in chunks(a):
        w = Words(a.slice(i, j - i), separator=BOUNDS)
        n = len(w.hash)
        if not n or not index.items:
            continue
        flat = np.concatenate([index.symbol(w.hash), np.full(pad, index.symbols - 1, np.int32)])
        item, start, place = index.candidates(flat, n)
        order = np.argsort(item, kind="stable")
        item, start, place = item[order], start[order], place[order]
        edges = np.flatnonzero(np.diff(item, prepend=-1))
        for p, q in zip(edges, [*edges[1:], len(item)]):
            t, most = int(item[p]), edits_allowed(len(index.items[int(item[p])]), index.similarity)
            for x in range(p, q, rows := index.rows(t)):
                s = start[x : min(q, x + rows)]
                doc = w.doc[place[x : x + len(s)]]
                d = index.distance(t, w.hash, s, w.first[doc], w.first[doc + 1])
                for k in np.flatnonzero(d <= most):
                    got = out[i + int(doc[k])]
                    got[t] = min(int(d[k]), got.get(t, 1 << 30))
        item, doc, stretch = index.in_pieces(w)
        edges = np.flatnonzero(np.diff(item, prepend=-1))
        for p, q in zip(edges, [*edges[1:], len(item)]):
            t, most = int(item[p]), edits_allowed(len(index.items[int(item[p])]), index.similarity)
            for x in range(p, q, rows := index.rows(t)):
                y = min(q, x + rows)
                d = index.distance(t, w.hash, stretch[x:y] * (most + 1), w.first[doc[x:y]], w.first[doc[x:y] + 1], most)
                for k in np.flatnonzero(d <= most):
                    got = out[i + int(doc[x + k])]
                    got[t] = min(int(d[k]), got.get(t, 1 << 30))
    return out


FOUND = "n_items int, item_ids string, min_edits int, contaminated boolean"


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    recall: float = 0.99,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 32 << 20,
    keep: bool = False,
) -> DataFrame:
    """Marks texts that hold a passage within word edit distance (1 - similarity) * words of a benchmark item.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A window starts at every word of every
    text. Repetitions of CGK walk and bit sampling are added until, on copies of the items with as many random edits
    as allowed, the target recall is reached; exact copies always share all keys. Where it is not, and for items of
    LONG words or more, the candidates share a piece that no edit touches, so none is missed. All are verified by the
    exact edit distance, so what is found is right. Items of less than 1 / (1 - similarity) words must match exactly.

    Returns (id, n_items, item_ids, min_edits, contaminated), or with keep all columns before these; item_ids are
    joined by commas in order; min_edits is null where nothing was found. The items' texts are measured first: up to
    block_bytes they make one broadcast index; more are dealt into blocks by a hash of the text, of which each makes
    its own index and pass, and the passes' findings are merged by row. Null or empty texts and items hold nothing;
    an item with a null id appears as 'null'. Repeated rows, and null ids, pass through; an empty table gives none.
    With keep, columns of the same names as the new ones are replaced; others may have any.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs if keep else docs.select(id_col, text_col)
    base, (text,) = plain(docs, text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    marked = base
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).toArrow()  # about block_bytes
        index = Index([x if x is not None else "null" for x in part.column(0).to_pylist()], part.column(1).to_pylist(), similarity, recall)
        marked = _pass(marked, spark.sparkContext.broadcast(index), text, f"_found{k}")
    names = [f"_found{k}" for k in range(blocks)]
    every = F.array_sort(F.flatten(F.array(*[F.col(c) for c in names])))
    marked = marked.withColumn("_all", every).drop(*names)
    marked = marked.withColumn("n_items", F.size("_all")).withColumn("item_ids", F.array_join(F.transform("_all", lambda x: x["id"]), ","))
    marked = marked.withColumn("min_edits", F.array_min(F.transform("_all", lambda x: x["edits"]))).withColumn("contaminated", F.col("n_items") > 0)
    out = named(marked, docs, [f.name for f in T.StructType.fromDDL(FOUND).fields])
    return out if keep else out.drop(text_col)


def _pass(df: DataFrame, shared, text_col: str, name: str) -> DataFrame:
    at = df.columns.index(text_col)
    kind = pa.list_(pa.struct([("id", pa.string()), ("edits", pa.int32())]))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StructType.fromDDL("id string, edits int")))])

    def run(batches):
        index = shared.value
        for b in batches:
            found = [[{"id": index.ids[t], "edits": d} for t, d in sorted(x.items())] for x in find(index, strings(b.column(at)))]
            yield pa.record_batch([*b.columns, pa.array(found, kind)], names=schema.names)

    return df.mapInArrow(lean(run), schema)
