"""Toxicity by cumulative-link ordinal regression over sparse text features."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, named, plain, small_batches
from .text import SEPARATOR, Words, chunks, mix64, strings

#: Words end at anything ASCII but letters and digits.
BOUNDS = SEPARATOR.copy()
BOUNDS[:128] = True
BOUNDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
PREFIXES = (4, 5, 6)


def features(a: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: whole words and word beginnings of 4 to 6 bytes.

    Returns (doc, feature) pairs sorted by doc, and each text's number of words. wanted: a flag for each feature;
    the others are left out (their weights are 0).
    """
    w = Words(a, separator=BOUNDS)
    size = w.end - w.start
    hashes, docs = [w.hash], [w.doc]
    for k in PREFIXES:
        long = size > k
        hashes.append(mix64(w.hashes(w.start[long], w.start[long] + k) + np.uint64(k)))
        docs.append(w.doc[long])
    parts = []
    for h, d in zip(hashes, docs):
        f = (h >> np.uint64(64 - bits)).astype(np.int64)
        if wanted is not None:
            f, d = f[(has := wanted[f])], d[has]
        parts.append(d << bits | f)
    code = np.unique(np.concatenate(parts))
    return code >> bits, code & ((1 << bits) - 1), np.diff(w.first)


class Sample:
    """Training rows: (doc, feature) pairs, sorted by doc, and each row's label."""

    def __init__(self, doc: np.ndarray, feat: np.ndarray, label: np.ndarray, bits: int):
        self.doc, self.feat, self.label, self.bits = doc, feat, label, bits

    @classmethod
    def of(cls, texts: list[str], label, bits: int = 18) -> "Sample":
        docs, feats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, x in enumerate(texts):
            feats.append(features(strings(pa.array([x], pa.string())), bits)[1])
            docs.append(np.full(len(feats[-1]), k))
        return cls(np.concatenate(docs), np.concatenate(feats), np.asarray(label, np.int64), bits)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def severities(sample: Sample, grades: int) -> np.ndarray:
    """Grades for rows that are labelled 0 or 1 only: 0 for clean ones, 1 to grades - 1 for toxic ones.

    A toxic text's grade is the quantile, among the toxic ones, of the number of its features that are far
    more frequent in toxic than in clean texts (ties share the lower grade).
    """
    doc, feat, toxic, bits = sample.doc, sample.feat, sample.label, sample.bits
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(toxic) - n1)
    d1 = np.bincount(feat[toxic[doc] == 1], minlength=1 << bits)
    d0 = np.bincount(feat[toxic[doc] == 0], minlength=1 << bits)
    marked = (d1 >= 3) & ((d1 + 0.5) / n1 > 10 * (d0 + 0.5) / n0)
    dense = np.bincount(doc, marked[feat], minlength=len(toxic))
    cuts = np.quantile(dense[toxic == 1], np.arange(1, grades - 1) / (grades - 1)) if toxic.any() else []
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, dense, "left"), 0)


class OrdinalModel:
    """P(grade > k) = sigmoid(x.w - threshold_k): one weight vector for all thresholds, which ascend in k."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    @classmethod
    def fit(cls, sample: Sample, grades: np.ndarray, l1: float = 1.5e-3, rounds: int = 300, min_docs: int = 3, n_grades: int | None = None, weight: np.ndarray | None = None) -> "OrdinalModel":
        """Maximum likelihood with an L1 penalty by projected gradient steps.

        A feature can have a weight only if the likelihood's slope at the empty model exceeds the penalty.

        Weights are not negative, so that no amount of harmless words offsets a toxic one. weight: the rows' weights.
        Only features in min_docs training texts or more have a weight, so that what was hardly seen says nothing.
        Without rows, or with one grade only, all weights are 0 and the thresholds give that grade.
        """
        grades = np.asarray(grades, np.int64)
        top = (int(grades.max(initial=0)) if n_grades is None else n_grades - 1) or 1
        doc, feat, bits = sample.doc, sample.feat, sample.bits
        df = np.bincount(feat, minlength=1 << bits)
        use = df[feat] >= min_docs
        doc, feat = doc[use], feat[use]
        n = max(1, len(grades))
        weight = np.ones(len(grades)) if weight is None else np.asarray(weight, float) * n / max(1e-9, np.sum(weight))
        share = np.array([(np.sum(weight[grades > k]) + 0.5) / (n + 1) for k in range(top)])
        start = np.log((1 - share) / share)
        gap = np.log(np.maximum(np.diff(start), 1e-3))
        row = np.arange(len(grades))

        def loss(x, theta):
            """The negative log-likelihood and its gradients by row and by threshold."""
            up = np.concatenate([np.ones((1, n)), _sigmoid(x[None, :] - theta[:, None]), np.zeros((1, n))])
            p = np.maximum(up[grades, row] - up[grades + 1, row], 1e-12)
            d = up * (1 - up)
            slope = d / p * weight
            gt = np.array([np.sum(slope[k + 1][grades == k + 1]) - np.sum(slope[k + 1][grades == k]) for k in range(top)])
            return -np.sum(weight * np.log(p)), -(slope[grades, row] - slope[grades + 1, row]), gt

        ids, w, theta = np.zeros(0, np.int64), np.zeros(0), start
        if len(np.unique(grades)) > 1:
            _, gx, _ = loss(np.zeros(n), start)
            ids = np.flatnonzero(-np.bincount(feat, gx[doc], minlength=1 << bits) > l1 * n)  # what the penalty lets in
            place = np.full(1 << bits, -1)
            place[ids] = np.arange(len(ids))
            doc, col = doc[place[feat] >= 0], place[feat[place[feat] >= 0]]
            m, penalty = len(ids), l1 * n / 20

            def value(v):
                theta = v[m] + np.concatenate([[0.0], np.cumsum(np.exp(v[m + 1 :]))])
                f, gx, gt = loss(np.bincount(doc, v[col], minlength=n), theta)
                back = np.cumsum(gt[::-1])[::-1]
                return f + penalty * v[:m].sum(), np.concatenate([np.bincount(col, gx[doc], minlength=m) + penalty, back[:1], back[1:] * np.exp(v[m + 1 :])])

            v = np.concatenate([np.zeros(m), start[:1], gap])
            f, g = value(v)
            step = 1.0 / n
            for _ in range(rounds):  # projected gradient, steps after Barzilai and Borwein, halved until they help
                for _ in range(40):
                    new = v - step * g
                    new[:m] = np.maximum(new[:m], 0)
                    f2, g2 = value(new)
                    if f2 <= f - 1e-4 / step * np.sum((new - v) ** 2):
                        break
                    step /= 2
                else:
                    break
                dv, dg = new - v, g2 - g
                step = float(np.clip(dv @ dv / max(dv @ dg, 1e-12), 1e-8, 1e3))
                done = f - f2 < 1e-7 * abs(f)
                v, f, g = new, f2, g2
                if done:
                    break
            w, theta = v[:m], v[m] + np.concatenate([[0.0], np.cumsum(np.exp(v[m + 1 :]))])
        full = np.zeros(1 << bits, np.float32)
        full[ids] = w
        return cls(full, np.asarray(theta), bits)

    def exceed(self, a: pa.Array) -> np.ndarray:
        """P(grade > k) for each text (rows) and threshold (columns)."""
        out = np.empty((len(a), len(self.thresholds)))
        wanted = self.weights != 0
        for i, j in chunks(a):
            doc, feat, _ = features(a.slice(i, j - i), self.bits, wanted)
            x = np.bincount(doc, self.weights[feat], minlength=j - i)
            out[i:j] = _sigmoid(x[:, None] - self.thresholds[None, :])
        return out


def training_sample(docs: DataFrame, labels: DataFrame, most: int, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Sample:
    """The features of at most `most` labelled texts (a documented bound), up to a half of them toxic, chosen by a hash of the id.

    Texts count whatever their length: their features, at most 2^bits of each, are made in the tasks. An id that
    repeats counts once, with its highest label and its first text in order of code points; labels but 0 and 1, and
    null ids, not at all. So the sample depends on the rows only.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    order = F.xxhash64(F.lit(17), id_col)
    chosen = rows.where("y = 1").orderBy(order, id_col).limit(most // 2).union(rows.where("y = 0").orderBy(order, id_col).limit(most // 2))
    # at most `most` ids and labels; and as many texts
    got = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen.select(F.col(id_col).alias("i"), "y")), "i").groupBy("i").agg(F.min("t").alias("t"), F.first("y").alias("y"))

    def run(batches):
        for b in batches:
            feats = [features(strings(b.column(1).slice(k, 1)), bits)[1].astype(np.int32) for k in range(b.num_rows)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(feats, pa.list_(pa.int32()))], names=["i", "y", "f"])

    kind = got.schema["i"].dataType.simpleString()
    t = got.select("i", "t", "y").mapInArrow(lean(run), f"i {kind}, y int, f array<int>").orderBy("i").toArrow()
    f = t.column("f").combine_chunks()
    f = pa.concat_arrays(f.chunks) if isinstance(f, pa.ChunkedArray) else f
    size = np.diff(f.offsets.to_numpy())
    return Sample(np.repeat(np.arange(len(size)), size), f.flatten().to_numpy().astype(np.int64), t.column("y").to_numpy().astype(np.int64), bits)


NEW = ["expected_severity", "grade", "p_toxic", "is_toxic"]


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Scores every whole text: (id, expected_severity, grade, p_toxic, is_toxic), or with keep all columns before.

    expected_severity is the sum of P(grade > k); grade the number of those over 1/2; a text is rejected (is_toxic)
    when P(grade > 0) >= 1/2. Null and empty texts have no features. Null ids and repeated rows pass through; an
    empty table gives none. With keep, columns of the same names as the new ones are replaced; others may have any.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs if keep else docs.select(id_col, text_col)
    base, (text,) = plain(docs, text_col)
    at = base.columns.index(text)
    schema = T.StructType(base.schema.fields + T.StructType.fromDDL("expected_severity double, grade int, p_toxic double, is_toxic boolean").fields)

    def run(batches):
        m = shared.value
        for b in batches:
            p = m.exceed(strings(b.column(at)))
            cols = [pa.array(p.sum(1)), pa.array((p > 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)]
            yield pa.record_batch([*b.columns, *cols], names=schema.names)

    out = named(base.mapInArrow(lean(run), schema), docs, NEW)
    return out if keep else out.drop(text_col)
