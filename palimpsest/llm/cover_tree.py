"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable

#: Distances come from single-precision inner products; bounds give way by this much before they decide.
SLACK = 2e-3
#: Nodes of so many points are compared point by point rather than split further.
SMALL = 256


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Nested levels with halving radii: a node at level l covers its subtree within radius 2**(1-l) of its own point.

    Each level's children of a node are chosen greedily, the node's point first, so that they are more than the
    level's radius apart; every other point goes to a child within the radius. `reach` is the true covering radius,
    at most the level's. Levels that do not split a node are skipped. A leaf is one point, or points all alike.
    Built from single-precision inner products, whose errors SLACK covers.
    """

    __slots__ = ("point", "reach", "children", "points")

    def __init__(self, dot: np.ndarray, base: np.ndarray, own: np.ndarray, radius: float = 1.0, depth: int = 0):
        """dot: inner products of a side's points; base: their numbers; own: the places in it of this node's points."""
        self.points = base[own]
        self.point = int(self.points[0])
        self.children: list[CoverTree] = []
        if len(own) == 1:
            self.reach = 0.0
            return
        self.reach = math.sqrt(max(0.0, 2 - 2 * float(dot[own[0], own].min()))) + SLACK
        if self.reach <= 2 * SLACK or depth > 60:
            return
        while radius >= self.reach:
            radius /= 2
        free = np.zeros(len(dot), bool)
        free[own] = True
        cut = 1 - radius * radius / 2
        whole = len(own) == len(dot)
        for i in own:
            if free[i]:
                if whole:
                    near = np.flatnonzero((dot[i] >= cut) & free)
                else:
                    near = own[(dot[i, own] >= cut) & free[own]]
                near = np.concatenate([[i], near[near != i]])
                free[near] = False
                self.children.append(CoverTree(dot, base, near, radius / 2, depth + 1))

    @classmethod
    def build(cls, x32: np.ndarray, points: np.ndarray) -> "CoverTree":
        side = x32[points]
        return cls(side @ side.T, points, np.arange(len(points)))


class Links:
    """Numbers of links of each point and a spanning forest of them."""

    def __init__(self, n: int, weight: np.ndarray):
        self.count, self.parent, self.weight, self.edges = np.zeros(n, np.int64), list(range(n)), weight, []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def bundle(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """All points of p link with all of q (same: all pairs within p)."""
        if same:
            self.count[p] += self.weight[p].sum() - self.weight[p]
        else:
            self.count[p] += self.weight[q].sum()
            self.count[q] += self.weight[p].sum()
        for i in p[1:] if same else p:
            self.join(int(p[0]) if same else int(q[0]), int(i))
        if not same:
            for j in q[1:]:
                self.join(int(p[0]), int(j))


def traverse(x: np.ndarray, x32: np.ndarray, a: CoverTree, b: CoverTree, cosine: float, links: Links) -> None:
    """Links all pairs of a point under a and one under b (a is b: pairs within) whose cosine is at least `cosine`.

    A pair of nodes whose points are farther apart than the threshold and both reaches is dropped; one so close that
    all its pairs must link is linked as a whole; others are split, the children of both sides against each other.
    Bounds use single precision and SLACK; single pairs are decided in double precision.
    """
    limit = math.sqrt(2 - 2 * cosine)
    cut = 1 - (limit + SLACK) ** 2 / 2
    work, single = [(a, b)], []
    while work:
        a, b = work.pop()
        if a is b and 2 * a.reach <= limit - SLACK:
            links.bundle(a.points, a.points, True)
            continue
        if not a.children and not b.children:
            u, v = np.repeat(a.points, len(b.points)), np.tile(b.points, len(a.points))
            single.append((u[u < v], v[u < v]) if a is b else (u, v))
            continue
        p, q = a.children or [a], b.children or [b]
        pr, qr = np.array([c.reach for c in p]), np.array([c.reach for c in q])
        pi, qi = np.array([c.point for c in p]), np.array([c.point for c in q])
        pn, qn = np.array([len(c.points) for c in p]), np.array([len(c.points) for c in q])
        wide_q = np.flatnonzero(qr)
        for k in range(0, len(p), 1024):
            dot = x32[pi[k : k + 1024]] @ x32[qi].T
            close = dot >= cut
            rows = np.flatnonzero(pr[k : k + 1024])  # few nodes have a reach; the others need no more than this
            bound = lambda d, room: d >= np.where(limit + room + SLACK >= 2, -2, 1 - (limit + room + SLACK) ** 2 / 2)
            if len(rows):
                close[rows] = bound(dot[rows], pr[k + rows][:, None] + qr[None, :])
            if len(wide_q):
                close[:, wide_q] = bound(dot[:, wide_q], pr[k : k + 1024, None] + qr[None, wide_q])
            i, j = np.nonzero(close)
            if a is b:
                i, j = i[k + i <= j], j[k + i <= j]
            lone = (pr[k + i] == 0) & (qr[j] == 0)
            lone &= (pi[k + i] != qi[j]) if a is b else True
            single.append((pi[k + i[lone]], qi[j[lone]]))
            # what lies under small nodes meets the points of all partners of a node at once
            same = (k + i == j) if a is b else np.zeros(len(i), bool)
            both = ~lone & (same | ((pn[k + i] > SMALL) & (qn[j] > SMALL)))
            half = ~lone & ~both
            left = half & (pr[k + i] > 0)
            for side, other, mine, theirs, ids in ((i[left] + k, j[left], p, q, 0), (j[half & ~left], k + i[half & ~left], q, p, 1)):
                order = np.argsort(side, kind="stable")
                side, other = side[order], other[order]
                edges = np.flatnonzero(side != np.concatenate([[-1], side[:-1]])) if len(side) else []
                for m, n in zip(edges, [*edges[1:], len(side)]):
                    under = mine[side[m]].points
                    points = np.concatenate([theirs[t].points for t in other[m:n]])
                    g, h = np.nonzero(x32[under] @ x32[points].T >= cut)
                    single.append((under[g], points[h]) if ids == 0 else (points[h], under[g]))
            for i, j in zip(i[both], j[both]):
                u, v = p[k + i], q[j]
                if u is v:
                    if u.reach:
                        work.append((u, u))
                elif math.sqrt(max(0.0, 2 - 2 * float(dot[i, j]))) + pr[k + i] + qr[j] <= limit - SLACK:
                    links.bundle(u.points, v.points, False)
                else:
                    work.append((u, v))
    for u, v in single:
        for k in range(0, len(u), 1 << 16):
            m, n = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", x[m], x[n]) >= cosine
            m, n = m[hit], n[hit]
            np.add.at(links.count, m, links.weight[n])
            np.add.at(links.count, n, links.weight[m])
            for i, j in zip(m.tolist(), n.tolist()):
                links.join(i, j)


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = 4096, most_cells: int = 1024
) -> DataFrame:
    """Exact links at cosine >= `cosine` (double precision), their number for each vector, and the components.

    Equal vectors are first brought together (by the vector itself; only one stands in for all, with their number),
    so that one very common vector is one point. The points are dealt to the nearest of k pivots, k in proportion to
    their number and at most most_cells; a point also visits each cell of a higher number that the threshold lets it
    reach over the bisecting plane. A cell's points and visitors are cut into blocks of at most about `cell` points by a
    hash, and each pair of blocks is one task of bounded size: it builds both cover trees and traverses them. A pair
    meets in exactly one task. Tasks return counts and a spanning forest, never all pairs.

    Returns (id, n_links, component_id, kept), one row for each row; n_links counts other vectors, equal ones too.
    Vectors that are null, empty, zero, or hold nulls or non-finite numbers link with nothing (n_links 0, own
    component, kept); so do vectors of different lengths with each other. Null ids have null component and are kept. Rows that repeat
    an id are vectors of their own. An empty table gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    fine = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, v).alias("v"))
    # 128 bits of the vector's hash stand for it, with -0.0 as 0.0
    v0 = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.select("id", "v", F.xxhash64(v0).alias("h1"), F.xxhash64(F.lit(1), v0).alias("h2"))
    real = rows.where("v is not null and id is not null")
    points = durable(real.groupBy("h1", "h2").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")))
    n_points = points.count()
    k = max(1, min(most_cells, n_points // cell))
    sample = points.orderBy(F.xxhash64(F.lit(3), "h1", "h2")).limit(k).select("v").toArrow().column(0).to_pylist()  # at most most_cells
    size = max((len(x) for x in sample), default=0)
    pivots = np.array([x for x in sample if len(x) == size], np.float64).reshape(-1, max(1, size))
    if len(pivots):
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(pivots)
    limit = math.sqrt(2 - 2 * cosine)

    def deal(batches):
        piv = shared.value
        gap = chords(piv, piv) if len(piv) else np.zeros((0, 0))
        for b in batches:
            out = [[], [], [], []]
            ids, vs, ns = b.column(0), b.column(1).to_pylist(), b.column(2)
            lens = np.array([len(x) for x in vs])
            for n in np.unique(lens):
                own = np.flatnonzero(lens == n)
                if n == size:
                    x = np.array([vs[i] for i in own])
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    dot = x @ piv.T
                    best = dot.argmax(1)
                    top = dot[np.arange(len(own)), best]
                    visits = (top[:, None] - dot) / np.maximum(gap[best], 1e-12) <= limit + SLACK
                    visits &= np.arange(len(piv))[None, :] > best[:, None]
                    out[0] += [own, own[np.nonzero(visits)[0]]]
                    out[1] += [best, np.nonzero(visits)[1]]
                    out[2] += [np.zeros(len(own), bool), np.ones(int(visits.sum()), bool)]
                else:  # of another length: a cell of their own
                    out[0].append(own)
                    out[1].append(np.full(len(own), -n))
                    out[2].append(np.zeros(len(own), bool))
            if out[0]:
                take = np.concatenate(out[0])
                packed = pa.array([np.array(x, np.float64).tobytes() for x in vs], pa.binary())
                yield pa.record_batch([pa.array(np.concatenate(out[1]).astype(np.int64)), pa.array(np.concatenate(out[2])), ids.take(pa.array(take)), ns.take(pa.array(take)), packed.take(pa.array(take))], names=["cell", "visitor", "pid", "n", "v"])

    id_type = points.schema["pid"].dataType.simpleString()
    dealt = points.select("pid", "v", "n").mapInArrow(deal, f"cell long, visitor boolean, pid {id_type}, n long, v binary")
    dealt = dealt.withColumn("half", F.xxhash64("pid"))
    # (cell, visitor): at most twice as many rows as cells
    sizes = dealt.groupBy("cell", "visitor").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("blocks"))
    sizes = durable(sizes.groupBy("cell").agg(F.max(F.when(~F.col("visitor"), F.col("blocks"))).alias("own"), F.coalesce(F.max(F.when(F.col("visitor"), F.col("blocks"))), F.lit(0)).alias("guests")))
    placed = dealt.join(F.broadcast(sizes.withColumnRenamed("cell", "c")), F.col("cell") == F.col("c"))
    own = F.coalesce("own", F.lit(0))
    at = F.pmod("half", F.when(F.col("visitor"), F.col("guests")).otherwise(own)).cast("int")
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    as_member = F.concat(
        F.transform(upto(F.lit(0), own), lambda o: F.when(o >= at, task("m", at, o, 0)).otherwise(task("m", o, at, 1))),
        F.transform(upto(F.lit(0), F.col("guests")), lambda g: task("g", at, g, 0)),
    )
    as_guest = F.transform(upto(F.lit(0), own), lambda o: task("g", o, at, 1))
    tasks = placed.select("cell", "pid", "n", "v", F.explode(F.when(F.col("visitor"), as_guest).otherwise(as_member)).alias("t")).select("cell", "pid", "n", "v", "t.*")

    def solve(key, table):
        side = table.column("side").to_numpy()
        pid, n, v = (table.column(c).combine_chunks() for c in ("pid", "n", "v"))
        total = len(side)
        x = np.frombuffer(b"".join(y.as_py() for y in v)).reshape(total, -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        x32 = x.astype(np.float32)
        links = Links(total, n.to_numpy())
        kind, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        if len(left):
            a = CoverTree.build(x32, left)
            if kind == "m" and i == j:
                traverse(x, x32, a, a, cosine, links)
            elif len(right):
                traverse(x, x32, a, CoverTree.build(x32, right), cosine, links)
        hit = np.flatnonzero(links.count)
        e = np.array(links.edges, np.int64).reshape(-1, 2)
        ids = pa.concat_arrays([pid.take(pa.array(hit)), pid.take(pa.array(e[:, 0]))])
        other = pa.concat_arrays([pa.nulls(len(hit), pid.type), pid.take(pa.array(e[:, 1]))])
        return pa.table({"a": ids, "b": other, "n": pa.array(np.concatenate([links.count[hit], np.zeros(len(e), np.int64)]))})

    found = durable(tasks.groupBy("cell", "kind", "i", "j").applyInArrow(solve, f"a {id_type}, b {id_type}, n long"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    parts = components(found.where("b is not null"), "a", "b")
    label = points.join(counts, points.pid == counts.a, "left").join(parts, points.pid == parts.node, "left").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "pid").alias("component_id")
    )
    ok = F.col("v").isNotNull() & F.col("id").isNotNull()
    # a row that links with nothing carries a key of its own, so that such rows don't meet in one task
    keyed = rows.select("id", ok.alias("ok"), F.when(ok, F.col("h1")).otherwise(F.xxhash64(F.lit(9), "id")).alias("h1"), F.when(ok, F.col("h2")).otherwise(F.lit(0)).alias("h2"))
    out = keyed.join(label, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("ok"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
