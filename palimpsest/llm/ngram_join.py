"""N-gram Jaccard join with count-vector R-trees."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, durable, lean, lean_group, small_batches
from .suffix_tree import Tally, common_rows
from .text import Words, chunks, mix64, strings

_K = np.uint64(0xD6E8FEB86659FD93)
#: Keys that a task holds to count them; sorting takes some 60 bytes for each.
HELD = 1 << 20
#: Bytes of texts whose keys are made at a time.
PIECE = 1 << 18


def shingle_runs(a: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hash) of each shingle as it occurs, by text; a text of fewer words is one shingle; and the number of texts."""
    w = Words(a)
    size = np.diff(w.first)
    doc, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    m = len(w.hash) - words + 1
    if m > 0:
        h = np.full(m, words, np.uint64)
        for k in range(words):
            h = mix64(h * _K + w.hash[k : m + k])
        inside = w.doc[:m] == w.doc[words - 1 :]
        doc.append(w.doc[:m][inside])
        out.append(h[inside])
    for n in range(1, words):
        own = np.flatnonzero(size == n)
        x = np.full(len(own), n, np.uint64)
        for k in range(n):
            x = mix64(x * _K + w.hash[w.first[own] + k])
        doc.append(own)
        out.append(x)
    return np.concatenate(doc), np.concatenate(out), w.n_docs


def flat_sets(a: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, ascending in each text, and where each text's begin; texts without words have none."""
    doc, h, n = shingle_runs(a, words)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n + 1))


def shingle_sets(a: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    h, first = flat_sets(a, words)
    return [h[i:j] for i, j in zip(first[:-1], first[1:])]


def set_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, and one of both; 0 for empty ones."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((3, len(first) - 1), np.uint64)
    if len(full):
        out[0, full] = np.bitwise_xor.reduceat(mix64(h + np.uint64(1)), first[full])
        out[1, full] = np.add.reduceat(mix64(h + np.uint64(2)), first[full])
        out[2, full] = mix64(out[0, full] * _K + out[1, full])
    return out[0], out[1], out[2]


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys, told by their differences, and counts; byte by byte, so that the zeros stand together."""
    planes = np.stack([np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64)]).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(both[:n], dtype=np.uint64), both[n:].astype(np.int64)


def counted(batches, shift: int, width: int):
    """Sorted runs (part, n, run) of the upper bits of the hashes in batches of arrays, each of a range of `width` keys."""
    tally, shift, width = Tally(HELD), np.uint64(shift), np.uint64(width)

    def out():
        found, n = tally.take()
        part = (found // width).astype(np.int64)
        at = np.flatnonzero(np.diff(part, prepend=-1))
        to = np.append(at[1:], len(part)) if len(at) else at
        return pa.record_batch([pa.array(part[at].astype(np.int32)), pa.array((to - at).astype(np.int32)), pa.array([pack(found[i:j], n[i:j]) for i, j in zip(at, to)], pa.binary())], names=["part", "n", "run"])

    for b in batches:
        flat = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(flat), HELD):
            tally.add(flat[i : i + HELD] >> shift)
            if tally.full():
                yield out()
    if tally.size:
        yield out()


def frequent(keys: DataFrame, total: int, least: int) -> tuple[DataFrame, int]:
    """(key, n) of what occurs `least` times or more in the arrays of hashes of a one-column table, and a shift.

    A key is the upper bits of the hash, which the shift leaves: six more than tell `total` hashes apart, so that few share
    one. Every partition counts for itself and hands on sorted runs of keys, packed, for each range of keys; a range's
    runs, about 2 million keys, are summed in one task. A frequent hash is one entry of each run.
    """
    bits = min(63, max(16, int(total).bit_length() + 6))
    shift = 64 - bits
    ranges = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // (1 << 21)), 1)
    width = -(-(1 << bits) // ranges)

    def add(table):
        tally = Tally()
        for n, blob in zip(table.column("n").to_pylist(), table.column("run")):
            tally.parts.append(unpack(blob.as_py(), n))
        found, n = tally.take()
        often = n >= least
        return pa.table({"key": pa.array(found[often].view(np.int64)), "n": pa.array(n[often])})

    runs = keys.mapInArrow(lean(lambda batches: counted(batches, shift, width)), "part int, n int, run binary")
    return runs.groupBy("part").applyInArrow(lean_group(add), "key long, n long"), shift


class Bands:
    """Keys by which any two linked sets meet.

    Two sets with Jaccard similarity t or more differ in at most r = (1-t)/(1+t) * (|A|+|B|) shingles. Shingles are
    hashed into p bands, of which a differing shingle changes one; a key is the hash of a band's contents. So of a
    set's k keys at least k - r are the other's too. All keys are ordered in one way, rare ones first; then the first
    r + 1 of either set have one in common. What many texts share is thereby no key of a text of which a quarter
    or more is its own. p is fixed for a range of sizes, sizes in reach of the next lower range use both, and a set
    with r keys or fewer adds levels of more bands until it has more: of two sets, the one that needs fewer
    levels is the guarantee. At t of a half and less r is no bound, and each shingle is a key.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.step = 1.5 if percent >= 83 else 2.0  # wide size ranges cost keys at their lower ends, narrow ones at overlaps
        self.ratio = math.log(self.step)

    def differ(self, n: int) -> int:
        """The most shingles in which a set of n can differ from a linked one."""
        return (100 - self.percent) * n // self.percent

    def needed(self, n: np.ndarray) -> np.ndarray:
        """How many keys of a level bring a set of n to all that it links with."""
        return (100 - self.percent) * n // (self.percent if self.percent > 50 else 100) + 1

    def classes(self, n: int) -> list[int]:
        """The size ranges in which a set of n meets others: its own, and that of its smallest partner."""
        own = math.floor(math.log(n) / self.ratio + 1e-9)
        low = math.floor(math.log(max(1, -(-n * self.percent // 100))) / self.ratio + 1e-9)
        return list(range(low, own + 1))

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a set, and for each the number of its level and (255 - its shingles), in one integer."""
        n = len(s)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        if self.percent <= 50:
            return s.view(np.int64), np.full(n, 254, np.int32)
        need = self.differ(n) + 1
        out, marks = [], []
        for cls in self.classes(n):
            p, level = max(1, math.ceil((self.differ(math.ceil(self.step ** (cls + 1))) + 1) * 2)), 0
            while True:
                salt = np.uint64((cls << 8 | level) + 1)
                h = mix64(s ^ mix64(np.array([salt]))[0])
                band = ((h >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(np.int64)
                count = np.bincount(band, minlength=p)
                full = np.flatnonzero(count)
                low = np.bincount(band, (h & np.uint64(0xFFFFFFF)).astype(np.float64), minlength=p)[full].astype(np.uint64)
                inner = mix64(h)
                high = np.bincount(band, (inner >> np.uint64(36)).astype(np.float64), minlength=p)[full].astype(np.uint64)
                marks.append((len(out) << 8 | 255 - np.minimum(count[full], 255)).astype(np.int32))
                out.append(mix64(mix64(low * _K + high) * _K + full.astype(np.uint64) * np.uint64(4096) + salt))
                if len(full) >= need:
                    break
                p, level = 2 * p, level + 1
        return np.concatenate(out).view(np.int64), np.concatenate(marks)


class RTree:
    """An R-tree over count vectors: each set's shingles hashed into groups and counted.

    |A and B| is at most the sum over groups of the smaller count; for a node it is at most the sum of the smaller of
    the query's count and the node's largest. Nodes also hold their sizes' range and the component their sets share, if
    they do. Built by sorting on the group of the largest spread and halving, down to leaves.
    """

    __slots__ = ("top", "low_n", "high_n", "parts", "rows")

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray, leaf: int = 16):
        self.rows = rows
        self.top = points[rows].max(0)
        self.low_n, self.high_n = int(sizes[rows].min()), int(sizes[rows].max())
        self.parts: list[RTree] = []
        if len(rows) > leaf:
            spread = np.concatenate([np.ptp(points[rows], 0), [self.high_n - self.low_n]])
            k = int(spread.argmax())
            by = points[rows, k] if k < points.shape[1] else sizes[rows]
            order = rows[np.argsort(by, kind="stable")]
            half = len(order) // 2
            self.parts = [RTree(points, sizes, order[:half], leaf), RTree(points, sizes, order[half:], leaf)]


def count_points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    out = np.zeros((len(sets), groups), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((mix64(s ^ np.uint64(0x5BD1E995)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return out


class Forest:
    """Components that grow as links are found; a pair within one need not be looked at."""

    def __init__(self, n: int, labels=None):
        self.parent = np.arange(n)
        if labels is not None:
            first: dict = {}
            for i, x in enumerate(labels):
                self.parent[i] = first.setdefault(x, i)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        r = self.parent[rows]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.edges.append((i, j))
        return True


def link_sets(sets: list[np.ndarray], percent: int, left: np.ndarray, right: np.ndarray | None, forest: Forest, groups: int = 64) -> int:
    """Joins in the forest whatever links between left and right (None: within left) connect; returns pairs verified.

    Every set of left queries an R-tree over the other side. Its largest bound decides which node comes first; nodes
    and sets in the query's own component are passed over; what the bound leaves is verified by exact intersection.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    left = left[sizes[left] > 0]
    other = left if right is None else right[sizes[right] > 0]
    if not len(left) or not len(other):
        return 0
    points = count_points(sets, groups)
    tree = RTree(points, sizes, other)
    verified = 0
    t = percent
    for q in left:
        n, point = int(sizes[q]), points[q]
        work = [tree]
        while work:
            node = work.pop()
            if 100 * min(n, node.high_n) < t * max(n, node.low_n):
                continue
            most = int(np.minimum(point, node.top).sum())
            # overlap o links a set of m if 100 o >= t (n + m - o); the node's smallest m asks least
            if (100 + t) * most < t * (n + max(node.low_n, most)):
                continue
            if node.parts:
                mine = forest.root(int(q))
                if (forest.roots(node.rows) == mine).all():
                    continue
                work += node.parts
                continue
            rows = node.rows
            m = sizes[rows]
            bound = np.minimum(points[rows], point).sum(1)
            ok = (100 + t) * bound >= t * (n + m)
            if right is None:
                ok &= rows > q
            for r in rows[ok]:
                if forest.root(int(q)) == forest.root(int(r)):
                    continue
                both = np.intersect1d(sets[q], sets[r], assume_unique=True)
                verified += 1
                if 100 * len(both) >= t * (n + sizes[r] - len(both)):
                    forest.join(int(q), int(r))
    return verified


def _tasks(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Runs link_sets in every task of members (id, task, side, label, comp), with texts (tid, t) joined; returns edges."""
    spark = members.sparkSession
    rows = members.join(texts, F.col("id") == F.col("tid")).select("task", "comp", "side", "label", "id", "t")
    id_type = members.schema["id"].dataType.simpleString()

    def solve(table):
        ids = table.column("id").combine_chunks()
        a = strings(table.column("t"))
        sets: list[np.ndarray] = []
        for i, j in chunks(a):
            sets += shingle_sets(a.slice(i, j - i), words)
        side, comp = table.column("side").to_numpy(), table.column("comp").to_numpy()
        out_a, out_b = [], []
        order = np.argsort(comp, kind="stable")
        edges = np.flatnonzero(np.diff(comp[order], prepend=comp[order[0]] - 1)) if len(order) else []
        for p, q in zip(edges, [*edges[1:], len(order)]):
            own = np.sort(order[p:q])
            labels = table.column("label").take(pa.array(own)).to_pylist()
            forest = Forest(len(own), labels)
            left, right = np.flatnonzero(side[own] == 0), np.flatnonzero(side[own] == 1)
            link_sets([sets[i] for i in own], percent, left, right if len(right) else None, forest)
            for i, j in forest.edges:
                out_a.append(own[i])
                out_b.append(own[j])
        return pa.table({"a": ids.take(pa.array(out_a, pa.int64())), "b": ids.take(pa.array(out_b, pa.int64()))})

    small_batches(spark)
    return rows.groupBy("task").applyInArrow(lean_group(solve), f"a {id_type}, b {id_type}")


def rarest(key: np.ndarray, mark: np.ndarray, first: np.ndarray, often: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of each set's first `needed` keys of each level: the least frequent, then those of most shingles, then by hash."""
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    level = mark >> 8
    order = np.lexsort((key, mark & 255, often, level, own))
    new = np.ones(len(key), bool)
    new[1:] = (own[1:] != own[:-1]) | (level[order][1:] != level[order][:-1])
    row = np.arange(len(key))
    keep = row - np.maximum.accumulate(np.where(new, row, 0)) < needed[own]
    return own[keep], key[order][keep]


def size_range(percent: int) -> float:
    """The width of a range of sizes, in logarithms: linked sets are in one range or in neighbouring ones."""
    return math.log(100 / percent) * 1.001 + 1e-9


def chain(batches, percent: int):
    """Edges between sets that share a key; batches: (key, na, node), sorted; a row with a key is an end of the partition.

    na is twice the set's size, plus 1 for a set that is no anchor: that cannot be the smaller of two that link.
    A set is tied to the first anchor of its key and range of sizes, and that one, like a set that stands before it, to
    the last anchor before, if their sizes allow a link. What links by this key is thereby connected, as the smaller
    of the two is an anchor. The first row counts as one, as its key may go on.
    """
    width = size_range(percent)
    held: list = []  # the first anchor of the range, and the last one: key, size, node
    first = last = None
    for b in batches:
        key, na, node = (b.column(k).to_numpy() for k in range(3))
        if not len(key):
            continue
        n, anchor = na >> 1, na & 1 == 0
        if first is None:
            first = int(key[0]), int(node[0])
            anchor[0] = True
        if held:
            k, m, x = zip(*held)
            key, n, node, anchor = np.r_[k, key], np.r_[m, n], np.r_[x, node], np.r_[[True] * len(held), anchor]
        row = np.arange(len(key))
        kind = np.floor(np.log(n) / width)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
        start = np.maximum.accumulate(np.where(new, row, 0))
        ahead = np.minimum.accumulate(np.where(anchor, row, len(row))[::-1])[::-1][start]  # the first anchor from the range's start on
        back = np.r_[-1, np.maximum.accumulate(np.where(anchor, row, -1))[:-1]]
        to = np.where(ahead < row, ahead, back)
        ok = (to >= 0) & (key[to] == key) & (node[to] != node) & (100 * n[to] >= percent * n)
        last = int(key[-1])
        held = [(int(key[i]), int(n[i]), int(node[i])) for i in dict.fromkeys((int(ahead[-1]), int(np.flatnonzero(anchor)[-1]))) if i < len(row)] if anchor.any() else []
        yield pa.record_batch([pa.array(node[to[ok]]), pa.array(node[ok]), pa.nulls(int(ok.sum()), pa.int64())], names=["a", "b", "key"])
    if first is not None:
        ends = [first] + [(k, x) for k, _, x in held[-1:] if k == last]
        yield pa.record_batch([pa.array([x for _, x in ends]), pa.nulls(len(ends), pa.int64()), pa.array([k for k, _ in ends])], names=["a", "b", "key"])


def jaccard_components(
    docs: DataFrame,
    words: int = 4,
    percent: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 512,
    near_task: int = 1024,
    broadcast_rows: int = 1_000_000,
    most_common: int = 1_000_000,
) -> DataFrame:
    """Components of documents under links 100 * |A and B| >= percent * |A or B| between their shingle sets, exact.

    1. Texts with the same set (128-bit hash of it) are one point, the smallest id standing for all.
    2. How often each band key (see Bands) occurs is counted over all texts. A point keeps its rarest keys, of which
       linked points always share one, so that a passage that many texts share brings no two of them together unless
       it is most of what there is of them. The order needs the frequent keys only: of those that occur eight
       times or more, the most_common most frequent are sent to all tasks.
    3. Points that share a key form rough groups, found over all keys at once: rows are range-partitioned by (key,
       size, point) and tied to their neighbours (see chain), so that a key of any number of rows is cut over many
       tasks; where a cut runs through a key, the ends are stitched together.
    4. Rough groups are searched by count-vector R-trees. Small ones share tasks of about near_task points. A larger
       one falls apart into pairs of neighbouring size ranges, and what is still larger is cut into blocks; each block,
       with the group's first point added, is a task. Then points outside their group's largest component meet, in
       blocks of their own, each other and all blocks of that component, so that no link between components is missed.
    5. Links found (spanning forests) give the components.

    Returns (id, n_shingles, component_id), one row for each row. Empty, null and wordless texts have no shingles and
    link with nothing. Rows with a null id are counted but link with nothing (null component). Rows that repeat an id
    are taken for one document if their texts agree; if not, all that links to one of them is joined. An empty table
    gives none; other columns are ignored. percent: 1 to 100.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = docs.sparkSession
    small_batches(spark)
    bands = Bands(percent)
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL("n long, h1 long, h2 long, point long, keys array<long>, marks array<int>").fields])

    def describe(batches):
        for b in batches:
            a = strings(b.column(1))
            for i, j in chunks(a, PIECE):
                h, first = flat_sets(a.slice(i, j - i), words)
                keys, marks = zip(*[bands.keys(h[p:q]) for p, q in zip(first[:-1], first[1:])])
                off = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x))) for x in (keys, marks)]
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(np.diff(first)), *[pa.array(x.view(np.int64)) for x in set_hashes(h, first)], *lists], names=schema.names)

    features = durable(docs.select(id_col, text_col).mapInArrow(lean(describe), schema))
    live = features.where("n > 0 and id is not null")
    reps = durable(live.groupBy("h1", "h2", "point").agg(F.min("id").alias("rep"), F.max("n").alias("n")))

    # keys
    total = features.agg(F.sum(F.size("keys"))).first()[0] or 0
    counts, shift = frequent(features.select("keys"), total, 8)
    _, often = common_rows(durable(counts), "n", most_common)
    known = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], often.column("n").to_numpy()[order]))

    def key_rows(batches):
        known, times = shared.value
        seen: set = set()  # points whose keys this task has given already
        for b in batches:
            n, point = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.zeros(len(point), bool)
            for k, x in enumerate(point.tolist()):
                new[k] = x not in seen
                seen.add(x)
            if len(seen) > 1 << 20:
                seen.clear()
            b = b.filter(pa.array(new))
            n, point = n[new], point[new]
            key, mark = (b.column(k).flatten().to_numpy() for k in (2, 3))
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))])
            short = key.view(np.uint64) >> np.uint64(shift)
            at = np.minimum(np.searchsorted(known, short), max(0, len(known) - 1))
            got = np.where(known[at] == short, times[at], 0) if len(known) else np.zeros(len(key), np.int64)
            own, kept = rarest(key, mark, first, got, bands.needed(n))
            yield pa.record_batch([pa.array(kept), pa.array(2 * n[own]), pa.array(point[own])], names=["key", "na", "node"])

    # rough groups
    n_parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # range boundaries come from a sample of the rows: the rows are written, so that they are made once
    keyed = durable(live.select("n", "point", "keys", "marks").mapInArrow(lean(key_rows), "key long, na long, node long"))
    pairs = keyed.repartitionByRange(n_parts, "key", "na", "node").sortWithinPartitions("key", "na", "node")
    pairs = pairs.mapInArrow(lean(lambda batches: chain(batches, percent)), "a long, b long, key long")
    pairs = durable(pairs.where("key is not null or a <> b").distinct())
    ends = pairs.where("key is not null")  # two for each partition
    stitched = ends.groupBy("key").agg(F.min("a").alias("b")).join(ends.select("key", "a"), "key").select("a", "b").where("a <> b")
    rough = durable(components(pairs.where("key is null").select("a", "b").union(stitched)))

    # R-trees over the rough groups
    members = rough.join(reps, F.col("node") == F.col("point")).groupBy("component", F.col("rep").alias("id")).agg(F.max("n").alias("n"), F.min("n").alias("least_n"))
    members = durable(members.withColumnRenamed("component", "comp"))
    sizes = durable(members.groupBy("comp").agg(F.count(F.lit(1)).alias("m")))
    sized = members.join(sizes, "comp")
    # linked sets are in the same or in neighbouring size ranges: large groups fall apart into pairs of ranges
    span = size_range(percent)
    at = lambda c: F.floor(F.log(c) / span).cast("int")
    ranges = F.explode(F.sequence(at("least_n"), at("n") + 1)).alias("range")
    pieces = durable(sized.where(F.col("m") > block).select("id", "comp", ranges).select("id", F.xxhash64("comp", "range").alias("comp")))
    piece_sizes = durable(pieces.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("head")))
    pieces = pieces.join(piece_sizes, "comp")
    sized = sized.where(F.col("m") <= block).select("id", "comp", "m", F.col("id").alias("head")).unionByName(pieces.select("id", "comp", "m", "head"))
    sized = durable(sized)
    total = sized.count()
    packs = max(1, -(-total // near_task))
    texts = docs.select(F.col(id_col).alias("tid"), F.col(text_col).alias("t"))
    if total <= broadcast_rows:  # else the join by id alone sorts the texts out
        texts = texts.join(F.broadcast(sized.select("id").distinct()), F.col("tid") == F.col("id"), "left_semi")
    small = sized.where(F.col("m") <= block)
    near = small.select("id", "comp", F.concat(F.lit("s"), F.pmod("comp", F.lit(packs))).alias("task"))
    large = sized.where(F.col("m") > block).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    large = large.withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    name = lambda *c: F.concat_ws(":", F.lit("l"), *c)
    within = large.select("id", "comp", F.explode(F.when(F.col("id") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("at"))).alias("b"))
    within = within.select("id", "comp", name("comp", "b").alias("task"))
    first = near.union(within).select("id", "comp", "task", F.lit(0).alias("side"), F.col("id").cast("string").alias("label"))
    edges = durable(_tasks(first, texts, words, percent))
    if large.limit(1).count():
        label = durable(components(edges))
        tagged = large.join(label, large.id == label.node, "left").select("id", "comp", "blocks", "at", F.coalesce("component", "id").alias("label"))
        tagged = durable(tagged)
        share = tagged.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("k"))
        main = share.groupBy("comp").agg(F.max(F.struct("k", "label")).alias("x"), F.sum("k").alias("all"))
        main = main.select(F.col("comp").alias("c"), F.col("x.label").alias("main"), F.ceil(F.col("x.k") / block).cast("int").alias("whole"), F.ceil((F.col("all") - F.col("x.k")) / block).cast("int").alias("rest"))
        main = durable(main.where("rest > 0"))
        tagged = durable(tagged.join(main, F.col("comp") == F.col("c")).drop("c"))
        dealt = lambda parts: F.pmod(F.xxhash64(F.lit(1), "id"), F.col(parts)).cast("int")
        upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        apart = tagged.where("label <> main").withColumn("g", dealt("rest"))
        # every two blocks of points apart meet once, in the task of both numbers; each meets all blocks of the largest component
        mutual = apart.withColumn("o", upto("rest")).select("id", "comp", "label", name(F.lit("a"), "comp", F.least("g", "o"), F.greatest("g", "o")).alias("task"), (F.col("g") > F.col("o")).cast("int").alias("side"))
        ask = apart.withColumn("b", upto("whole")).select("id", "comp", "label", name(F.lit("m"), "comp", "g", "b").alias("task"), F.lit(0).alias("side"))
        told = tagged.where("label = main").withColumn("b", dealt("whole")).withColumn("g", upto("rest")).select("id", "comp", "label", name(F.lit("m"), "comp", "g", "b").alias("task"), F.lit(1).alias("side"))
        second = mutual.unionByName(ask).unionByName(told).select("id", "comp", "task", "side", F.col("label").cast("string").alias("label"))
        edges = edges.union(durable(_tasks(second, texts, words, percent)))
    found = durable(components(edges))

    label = reps.join(found, reps.rep == found.node, "left").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("component", "rep").alias("component_id"))
    own = F.col("n") > 0
    lone = F.xxhash64(F.lit(9), "id")  # texts without shingles don't meet in one task
    marked = features.select("id", "n", F.when(own, F.col("h1")).otherwise(lone).alias("h1"), "h2")
    out = marked.join(label, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
