"""Language-model scores: word unigram base and a probabilistic suffix tree over bytes."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, small_batches
from .text import LOWER, Words, chunks, mix64, raw, strings

#: Bytes that no UTF-8 text holds: one stands before a text's first byte, one after its last.
PAD, END = 0xFE, 0xFF


def padded(a: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts lower-cased (A-Z), each with `depth` PADs before and one END after; begin and end of each."""
    data, off = raw(a)
    n = len(off) - 1
    begin = off[:-1] + np.arange(n) * (depth + 1)
    out = np.full(len(data) + n * (depth + 1), PAD, np.uint8)
    keep = np.ones(len(out), bool)
    end = off[1:] + np.arange(1, n + 1) * (depth + 1)
    for k in range(depth):
        keep[begin + k] = False
    keep[end - 1] = False
    out[keep] = LOWER[data]
    out[end - 1] = END
    return out, begin, end


#: Contexts of at most so many bytes need no test.
SHORT = 2


def held_out(ids, parts: int, part: int) -> np.ndarray:
    """crc32 of the id as text, modulo parts, is part; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % parts == part for i in ids], bool)


class Tally:
    """Counts of 64-bit keys, merged by sorting."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.size += len(k)

    def full(self) -> bool:
        if self.size > self.most and len(self.parts) > 1:
            self.take(keep=True)
        return self.size > self.most

    def take(self, keep: bool = False):
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        self.parts, self.size = [], 0
        k, inv = np.unique(keys, return_inverse=True)
        c = np.bincount(inv, counts, minlength=len(k)).astype(np.int64)
        if keep:
            self.parts, self.size = [(k, c)], len(k)
        return k, c


def grams(a: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of depth + 1 bytes that end at each byte and at the END of each text, as integers; the text of each."""
    flat, begin, end = padded(a, depth)
    code = np.zeros(max(0, len(flat) - depth), np.uint64)
    for k in range(depth + 1):
        code = code << np.uint64(8) | flat[k : len(flat) - depth + k]
    whole = np.ones(len(code), bool)
    for k in range(1, depth + 1):  # strings that begin in one text and end in the next
        at = begin[1:] - k
        whole[at[(at >= 0) & (at < len(code))]] = False
    return code[whole], np.repeat(np.arange(len(begin)), end - begin - depth)


def gather(docs: DataFrame, id_col: str, text_col: str, depth: int, parts: int, part: int) -> DataFrame:
    """(kind, key, n, seen): kind 0, word hashes; kind 1, byte strings of depth + 1; kind 2, texts.

    n counts in the training texts, seen for byte strings in all texts: those of the other texts alone have n = 0.
    Every partition counts for itself and hands on sums; Spark adds them up by key.
    """
    small_batches(docs.sparkSession)
    names = ["kind", "key", "n", "seen"]

    def run(batches):
        words, known, other, texts = Tally(), Tally(), Tally(), 0

        def out(kind, tally, trained=True):
            k, c = tally.take()
            for i in range(0, len(k), 1 << 17):
                m = len(k[i : i + (1 << 17)])
                n = pa.array(c[i : i + m])
                yield pa.record_batch([pa.array(np.full(m, kind, np.int8)), pa.array(k[i : i + m].view(np.int64)), n if trained else pa.array(np.zeros(m, np.int64)), n], names=names)

        for b in batches:
            train = ~held_out(b.column(0).to_pylist(), parts, part)
            texts += int(train.sum())
            for rows, tally in ((train, known), (~train, other)):
                a = strings(b.column(1).filter(pa.array(rows)))
                for i, j in chunks(a):
                    piece = a.slice(i, j - i)
                    if tally is known:
                        words.add(Words(piece).hash)
                    tally.add(grams(piece, depth)[0])
            for kind, tally in ((0, words), (1, known), (1, other)):
                if tally.full():
                    yield from out(kind, tally, tally is not other)
        yield from out(0, words)
        yield from out(1, known)
        yield from out(1, other, False)
        yield pa.record_batch([pa.array([2], pa.int8()), *[pa.array([x], pa.int64()) for x in (0, texts, texts)]], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, "kind byte, key long, n long, seen long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def lengthen(key: np.ndarray, n: np.ndarray, p: np.ndarray, lengths: range, least: int, divergence: float, strength: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the last byte of each key by its longer and longer contexts; rows: distinct keys, counts, p by the shorter context.

    Returns the probability by the longest context that occurs at least `least` times, and by the longest one that is
    kept too. Rows that share a context of the first of `lengths` must come together.
    """
    if not len(key):
        return p, p
    levels, best = [], p
    for k in lengths:
        pair = key & np.uint64((1 << 8 * (k + 1)) - 1)
        _, first, own = np.unique(pair, return_index=True, return_inverse=True)
        _, at = np.unique(pair >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, n)
        enough, below = total >= least, p
        if k == 0:
            p = (np.bincount(own, n)[own] + 1) / (total[at] + 257)
            levels.append((p, at, np.ones(len(total), bool)))
            continue
        p = (np.bincount(own, n)[own] + strength * below) / (total[at] + strength)
        first = first[np.bincount(own, n) > 0]
        rest = strength / (total + strength)  # what a byte that never follows keeps of its probability
        far = np.bincount(at[first], p[first] * np.log(p[first] / below[first]), minlength=len(total))
        far += np.maximum(0, 1 - np.bincount(at[first], below[first], minlength=len(total))) * rest * np.log(rest)
        p = np.where(enough[at], p, below)
        levels.append((p, at, enough & ((far >= divergence) | (k <= SHORT))))
    closed, longer = [], np.zeros(len(key), bool)
    for _, at, keep in reversed(levels):  # suffixes of kept contexts are kept
        longer = (keep | (np.bincount(at, longer, minlength=len(keep)) > 0))[at]
        closed.append(longer)
    for (by, _, _), kept in zip(levels, reversed(closed)):
        best = np.where(kept, by, best)
    return p, best


def predict(counts: DataFrame, depth: int, least: int, divergence: float, block: int = 1 << 19) -> DataFrame:
    """(key, seen, logp): log10 probability of each gathered byte string's last byte after the bytes before it.

    A context counts when it occurs `least` times in the training texts; it is kept when its distribution diverges from
    its suffix's by `divergence` nats, when a kept one ends in it, or when it has at most SHORT bytes. The longest kept
    one speaks, smoothed by its suffixes. The short ones, at most 256^SHORT with at most 257 next bytes each, are
    sent to all tasks; the longer ones meet by their last SHORT + 1 bytes, about `block` strings in a task.
    """
    whole = counts.where("kind = 1").select("key", "n", "seen")
    mask = (1 << 8 * (min(SHORT, depth) + 1)) - 1
    few = whole.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).toArrow()
    key, n = few.column("key").to_numpy().view(np.uint64), few.column("n").to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    shared = counts.sparkSession.sparkContext.broadcast((key, lengthen(key, n, np.zeros(len(key)), range(min(SHORT, depth) + 1), least, divergence)[1]))
    tasks = -(-int(few.column("m").to_numpy().sum()) // block) or 1

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            k, n, seen = (t.column(x).to_numpy() for x in ("key", "n", "seen"))
            k = k.view(np.uint64)
            pairs, p = shared.value
            logp = np.log10(lengthen(k, n, p[np.searchsorted(pairs, k & np.uint64(mask))], range(min(SHORT, depth) + 1, depth + 1), least, divergence)[1])
            for i in range(0, len(k), 1 << 17):
                j = i + (1 << 17)
                yield pa.record_batch([pa.array(k[i:j].view(np.int64)), pa.array(seen[i:j]), pa.array(logp[i:j])], names=["key", "seen", "logp"])

    ends = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    return whole.repartition(tasks, ends).mapInArrow(run, "key long, seen long, logp double")


class SuffixTree:
    """Contexts of up to `depth` bytes, each with a smoothed next-byte distribution, run as an automaton.

    The state after some text is its longest suffix among the contexts. `move` and `logp` have a row for each state
    and a column for each byte in use; the other bytes share the last column.
    """

    def __init__(self, move: np.ndarray, logp: np.ndarray, column: np.ndarray, start: int, depth: int, contexts: list):
        self.move, self.logp, self.column, self.start, self.depth, self.contexts = move, logp, column, start, depth, contexts

    @classmethod
    def grow(cls, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray, length: np.ndarray, depth: int, divergence: float = 0.003, strength: float = 8.0) -> "SuffixTree":
        """Keeps a context when its next-byte distribution diverges from its suffix's, or a kept one needs it.

        Rows: context (big-endian in an integer), its length, next byte, count. The test: Kullback-Leibler divergence
        from the next shorter suffix of at least `divergence` nats. Suffixes and beginnings of kept contexts are kept
        too, which makes the automaton exact. Smoothing: each distribution is its counts plus `strength` times its
        suffix's distribution; the empty context's counts get one for each of 257 outcomes.
        """
        used = np.unique(symbols[length == 0]) if len(symbols) else np.zeros(0, np.int64)
        column = np.full(256, len(used), np.int64)
        column[used] = np.arange(len(used))
        width = len(used) + 1
        table: dict[tuple[int, int], np.ndarray] = {(0, 0): np.zeros(width)}
        order = np.lexsort((contexts, length))
        contexts, symbols, counts, length = contexts[order], symbols[order], counts[order], length[order]
        edges = np.flatnonzero(np.diff(contexts, prepend=-1).astype(bool) | np.diff(length, prepend=-1).astype(bool))
        for i, j in zip(edges, [*edges[1:], len(contexts)]):
            row = np.zeros(width)
            row[column[symbols[i:j]]] = counts[i:j]
            table[(int(length[i]), int(contexts[i]))] = row
        dist: dict[tuple[int, int], np.ndarray] = {}
        keep = {(0, 0)}
        shorter = lambda c: (c[0] - 1, c[1] & ((1 << 8 * (c[0] - 1)) - 1))  # noqa: E731  the suffix
        for c in sorted(table):
            n = table[c].sum()
            if c[0] == 0:
                base = table[c] + 1.0
                base[-1] = 257 - len(used)
                dist[c] = base / base.sum()
                continue
            below = dist.get(shorter(c))
            if below is None:  # rarer than what was gathered: cannot be, as a suffix is no rarer
                continue
            dist[c] = (table[c] + strength * below) / (n + strength)
            if np.sum(dist[c] * np.log(dist[c] / below)) >= divergence:
                keep.add(c)
        todo = list(keep)
        while todo:
            c = todo.pop()
            if c[0]:
                for d in (shorter(c), (c[0] - 1, c[1] >> 8)):
                    if d not in keep and d in dist:
                        keep.add(d)
                        todo.append(d)
        states = sorted(c for c in keep)
        number = {c: i for i, c in enumerate(states)}
        logp = np.stack([np.log10(dist[c]) for c in states])
        logp[:, -1] -= np.log10(257 - len(used))  # what unused bytes have together, shared alike
        move = np.zeros((len(states), width), np.int32)
        for i, c in enumerate(states):
            for s in range(width - 1):
                d = (c[0] + 1, c[1] << 8 | int(used[s]))
                while d not in number:
                    d = shorter(d)
                move[i, s] = number[d]
        start = (0, 0)
        for k in range(1, depth + 1):
            c = (k, int.from_bytes(bytes([PAD] * k), "big"))
            start = c if c in number else start
        return cls(move, logp, column, number[start], depth, states)

    def score(self, a: pa.Array, span: int = 192) -> np.ndarray:
        """log10 probability of each text and its end.

        The bytes of all texts run in lanes of `span` bytes side by side; a lane first takes in the `depth` bytes
        before it, which fix its state.
        """
        flat, begin, end = padded(a, self.depth)
        if not len(flat):
            return np.zeros(0)
        d = self.depth
        lanes = -(-len(flat) // span)
        line = np.full(d + lanes * span, PAD, np.uint8)
        line[d : d + len(flat)] = flat
        code = self.column[line].astype(np.int32)
        width = self.logp.shape[1]
        move, logp = self.move.ravel(), self.logp.ravel()
        state = np.zeros(lanes, np.int64)
        out = np.empty((span, lanes))
        first = np.arange(lanes) * span
        for t in range(span + d):
            c = code[first + t]
            at = state * width + c
            if t >= d:
                out[t - d] = logp[at]
            state = move[at].astype(np.int64)
        each = out.T.ravel()[: len(flat)]
        each[flat == PAD] = 0.0
        return np.add.reduceat(each, begin) if len(begin) else np.zeros(0)


def grow_tree(counts: DataFrame, depth: int, min_share: float = 1e-5, divergence: float = 0.003) -> SuffixTree:
    """A tree in the driver from the gathered byte strings, of contexts that make up min_share of all positions.

    At most 1 / min_share of each length: for small tables. score_texts, which drops no such contexts, uses predict.
    """
    whole = counts.where("kind = 1 and n > 0").select("key", "n")
    total = whole.agg(F.sum("n")).first()[0] or 0
    rows = []
    for k in range(depth + 1):
        mask = (1 << 8 * k) - 1
        pair = whole.select(F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(mask)).alias("c"), F.col("key").bitwiseAND(F.lit(255)).alias("s"), "n").groupBy("c", "s").agg(F.sum("n").alias("n"))
        if k:
            often = pair.groupBy("c").agg(F.sum("n").alias("all")).where(F.col("all") >= max(2.0, min_share * total)).select("c")
            pair = pair.join(often, "c")
        rows.append(pair.select(F.lit(k).alias("k"), "c", "s", "n"))
    got = rows[0]
    for r in rows[1:]:
        got = got.union(r)
    t = got.toArrow()
    c, s, n, k = (t.column(x).to_numpy().astype(np.int64) for x in ("c", "s", "n", "k"))
    return SuffixTree.grow(c, s, n, k, depth, divergence)


def common_rows(df: DataFrame, count: str, most: int) -> tuple[int, pa.Table]:
    """The least power of two that at most `most` rows' counts reach, and these rows."""
    steps = [1 << k for k in range(0, 40)]
    seen = df.agg(*[F.count(F.when(F.col(count) >= s, 1)).alias(f"s{s}") for s in steps]).first()
    least = next(s for s in steps if seen[f"s{s}"] <= most)
    return least, df.where(F.col(count) >= least).toArrow()


def score_texts(
    docs: DataFrame,
    depth: int = 5,
    parts: int = 7,
    part: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_common: int = 1_000_000,
    min_count: int = 2,
    divergence: float = 0.003,
    most_strings: int = 1 << 21,
) -> DataFrame:
    """Scores every whole text with a unigram base and a probabilistic suffix tree, both learned from a part.

    Trains on the rows whose crc32(id as text) mod parts is not part (a null id counts as ''). Base: the sum over
    the text's words, A-Z lower-cased, and one end, of log10((c + 1) / (N + V + 1)). The counts of the common words
    (at most most_common of them, all over some count) are broadcast; the occurrences of the others, few for each
    word, are joined with the word counts by key. So neither a hot word nor a large vocabulary meets in one task.
    Score: log10 probability of the text's bytes and its end under the tree, which keeps every context of up to depth
    bytes that occurs min_count times and diverges from its suffix (see predict). It is a table of byte strings with
    the probability of each one's last byte, and is treated like the words: the common ones are broadcast (at most
    most_strings), the occurrences of the others are joined.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row. Words are told
    apart by 64-bit hashes. Null and empty texts consist of the end alone. Repeated rows count and return each for
    itself. An empty table gives none; with nothing to train on every probability is the smoothing's.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = durable(gather(docs, id_col, text_col, depth, parts, part))
    model = durable(predict(counts, depth, min_count, divergence))
    words = counts.where("kind = 0").select("key", "n")
    seen = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    n_train, vocabulary = (seen["n"] or 0) + ends, seen["v"] + (1 if ends else 0)

    def table(rows, logs):
        key = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        return key[order], logs[order]

    least, common = common_rows(words, "n", most_common)
    word_table = table(common, np.log10((common.column("n").to_numpy() + 1) / (n_train + vocabulary + 1)))
    least_seen, common = common_rows(model, "seen", most_strings)
    shared = spark.sparkContext.broadcast((word_table, table(common, common.column("logp").to_numpy())))
    unknown = float(np.log10(1 / (n_train + vocabulary + 1)))
    end_score = float(np.log10((ends + 1) / (n_train + vocabulary + 1)))
    ends_known = int(ends > 0)
    # The row of a text carries a key of its own, so that these rows spread over all tasks like the words.
    schema = T.StructType([*T.StructType.fromDDL("uid long, kind byte, key long").fields, docs.schema[id_col], *T.StructType.fromDDL("tf long, held_out boolean, n_tokens long, n_known long, base double, score double").fields])

    def probe(table, doc, keys, m):
        """Sums of the known keys' logs and their number for each of m texts; (text, key, times) of the others."""
        known, logs = table
        o = np.argsort(keys)
        doc, keys = doc[o], keys[o]
        at = np.searchsorted(known, keys)
        hit = known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
        total, number = np.bincount(doc[hit], logs[at[hit]], minlength=m) + 0.0, np.bincount(doc[hit], minlength=m)
        doc, keys = doc[~hit], keys[~hit]
        o = np.lexsort((keys, doc))
        doc, keys = doc[o], keys[o]
        first = np.flatnonzero(np.diff(doc, prepend=-1).astype(bool) | np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        return total, number, doc[first], keys[first], np.diff(np.r_[first, len(keys)])

    def run(batches):
        word_table, string_table = shared.value
        ctx = TaskContext.get()
        row = (ctx.partitionId() if ctx else 0) << 40
        for b in batches:
            ids = b.column(0).to_pylist()
            out = held_out(ids, parts, part)
            a = strings(b.column(1))
            for i, j in chunks(a):
                piece = a.slice(i, j - i)
                w = Words(piece)
                m = j - i
                base, known, *rare = probe(word_table, w.doc, w.hash, m)
                code, doc = grams(piece, depth)
                score, _, *rare_strings = probe(string_table, doc, code, m)
                uid = row + np.arange(m)
                row += m
                yield pa.record_batch([pa.array(uid), pa.array(np.full(m, 2, np.int8)), pa.array(mix64(uid).view(np.int64)), b.column(0).slice(i, m), pa.array(np.zeros(m, np.int64)), pa.array(out[i:j]), pa.array(np.diff(w.first) + 1), pa.array(known + ends_known), pa.array(base + end_score), pa.array(score)], names=schema.names)
                for kind, (of, key, times) in enumerate((rare, rare_strings)):
                    for x in range(0, len(key), 1 << 17):
                        y = min(len(key), x + (1 << 17))
                        none = lambda t: pa.nulls(y - x, t)
                        yield pa.record_batch([pa.array(uid[of[x:y]]), pa.array(np.full(y - x, kind, np.int8)), pa.array(key[x:y].view(np.int64)), none(b.column(0).type), pa.array(times[x:y]), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())], names=schema.names)

    # written once: a lost task would number the rows of a shuffled input otherwise
    rows = durable(docs.select(id_col, text_col).mapInArrow(run, schema))
    log = F.log10((F.col("n") + 1) / F.lit(float(n_train + vocabulary + 1)))
    rare = words.where(F.col("n") < least).select(F.lit(0).cast("byte").alias("kind"), "key", log.alias("log"))
    rare = rare.unionByName(model.where(F.col("seen") < least_seen).select(F.lit(1).cast("byte").alias("kind"), "key", F.col("logp").alias("log")))
    joined = rows.join(rare, ["kind", "key"], "left")
    word, string, text = F.col("kind") == 0, F.col("kind") == 1, F.col("kind") == 2
    known = F.when(word & F.col("log").isNotNull(), F.col("tf")).when(text, F.col("n_known")).otherwise(0)
    base = F.when(word, F.col("tf") * F.coalesce("log", F.lit(unknown))).when(text, F.col("base")).otherwise(0.0)
    score = F.when(string, F.col("tf") * F.col("log")).when(text, F.col("score")).otherwise(0.0)
    got = joined.select("uid", F.when(text, F.struct(F.col(id_col).alias("id"), "held_out", "n_tokens")).alias("row"), known.alias("known"), base.alias("base"), score.alias("score"))
    got = got.groupBy("uid").agg(F.first("row", ignorenulls=True).alias("row"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return got.select(F.col("row.id").alias(id_col), "row.held_out", "row.n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
