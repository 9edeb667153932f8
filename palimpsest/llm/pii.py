"""Personal data by a character-level bidirectional LSTM with CRF transitions, trained in numpy."""

import bisect
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .spans import PII_KINDS, digest, is_card, is_ip, is_phone, joined, luhn, ordered, pii_spans

#: Character classes: digits apart from 0-2 and 3-5 and 6-9, letters by case, single marks, other.
_MARKS = "@.-+() _%:/,"
N_CLASSES = 8 + len(_MARKS)
_CLASS = np.full(128, 0, np.int8)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s in "012" else 2 if _s in "345" else 3 if _s in "6789" else 4 if "a" <= _s <= "z" else 5 if "A" <= _s <= "Z" else 6 if _s.isspace() and _s != " " else 8 + _MARKS.index(_s) if _s in _MARKS else 0
TAGS = ["O"] + [f"{p}-{k}" for k in PII_KINDS for p in "BI"]
N_TAGS = len(TAGS)
#: A span of any kind holds a digit or an '@'; windows without either can hold none.
_ANCHOR = np.zeros(128, bool)
_ANCHOR[[*range(48, 58), 64]] = True


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(points: np.ndarray) -> np.ndarray:
    out = np.full(len(points), 7, np.int8)
    ascii_ = points < 128
    out[ascii_] = _CLASS[points[ascii_]]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """A BiLSTM over character classes, a linear layer to tag scores, and CRF transitions between tags."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        h = hidden
        self.h = h
        self.p = {"T": np.where(allowed(), 0.0, -30.0), "S": np.where([t.startswith("I") for t in TAGS], -30.0, 0.0)}
        for d in "fb":
            self.p |= {f"E{d}": r.normal(0, 0.3, (N_CLASSES, 4 * h)), f"U{d}": r.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"V{d}": r.normal(0, 1 / np.sqrt(h), (h, N_TAGS))}
            self.p[f"E{d}"][:, h : 2 * h] += 1.0  # forget gates start open
        self.p["c"] = np.zeros(N_TAGS)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction over windows x (time, batch)."""
        h, (e, u) = self.h, (self.p[f"E{d}"], self.p[f"U{d}"])
        n, b = x.shape
        hs, gates, cs = np.zeros((n + 1, b, h)), [], [np.zeros((b, h))]
        state = np.zeros((b, h))
        for k in range(n):
            t = k if d == "f" else n - 1 - k
            z = e[x[t]] + state @ u
            g = _sigmoid(z[:, : 3 * h])
            a = np.tanh(z[:, 3 * h :])
            c = g[:, h : 2 * h] * cs[-1] + g[:, :h] * a
            state = g[:, 2 * h :] * np.tanh(c)
            hs[t] = state
            if keep:
                gates.append((t, g, a, c))
                cs.append(c)
            else:
                cs[-1] = c
        return hs[:n], gates, cs

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (time, batch, tag)."""
        return self._run(x, "f", False)[0] @ self.p["Vf"] + self._run(x, "b", False)[0] @ self.p["Vb"] + self.p["c"]

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        """The best tag path of each window (time, batch)."""
        n, b, _ = s.shape
        best = s[0] + self.p["S"]
        back = np.zeros((n, b, N_TAGS), np.int8)
        for t in range(1, n):
            step = best[:, :, None] + self.p["T"]
            back[t] = step.argmax(1)
            best = step.max(1) + s[t]
        path = np.zeros((n, b), np.int64)
        path[-1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t][np.arange(b), path[t]]
        return path

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag paths y under the CRF, and its gradients."""
        p, h = self.p, self.h
        n, b = x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        s = runs["f"][0] @ p["Vf"] + runs["b"][0] @ p["Vb"] + p["c"]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha = np.zeros((n, b, N_TAGS))
        alpha[0] = s[0] + p["S"]
        for t in range(1, n):
            alpha[t] = lse(alpha[t - 1][:, :, None] + p["T"], 1) + s[t]
        z = lse(alpha[-1], 1)
        beta = np.zeros((n, b, N_TAGS))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        cols = np.arange(b)
        for t in range(n - 2, -1, -1):
            beta[t] = lse(p["T"] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        ds = np.exp(alpha + beta - z[:, None])
        for t in range(n - 1):
            g["T"] += np.exp(alpha[t][:, :, None] + p["T"] + (s[t + 1] + beta[t + 1])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(g["T"], (y[:-1].ravel(), y[1:].ravel()), -1.0)
        gold = p["S"][y[0]] + s[np.arange(n)[:, None], cols, y].sum(0) + p["T"][y[:-1], y[1:]].sum(0)
        ds[np.arange(n)[:, None], cols, y] -= 1
        g["S"] = ds[0].sum(0)
        g["c"] = ds.sum((0, 1))
        for d in "fb":
            hs, gates, cs = runs[d]
            g[f"V{d}"] = np.einsum("tbh,tbk->hk", hs, ds)
            dh_all, dh, dc = ds @ p[f"V{d}"].T, np.zeros((b, h)), np.zeros((b, h))
            for k in range(n - 1, -1, -1):
                t, gate, a, c = gates[k]
                i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                up = dh + dh_all[t]
                tc = np.tanh(c)
                dc = dc + up * o * (1 - tc * tc)
                dz = np.concatenate([dc * a * i * (1 - i), dc * cs[k] * f * (1 - f), up * tc * o * (1 - o), dc * i * (1 - a * a)], 1)
                np.add.at(g[f"E{d}"], x[t], dz)
                if k:
                    g[f"U{d}"] += hs[gates[k - 1][0]].T @ dz
                dh, dc = dz @ p[f"U{d}"].T, dc * f
        return float((z - gold).mean()), {k: v / b for k, v in g.items()}


def allowed() -> np.ndarray:
    """Which tag may follow which: I of a kind only after B or I of that kind."""
    ok = np.ones((N_TAGS, N_TAGS), bool)
    for j, t in enumerate(TAGS):
        if t.startswith("I"):
            ok[:, j] = [u[2:] == t[2:] and u != "O" for u in TAGS]
    return ok


def tags_of(length: int, spans) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for s, e, k in spans:
        y[s] = TAGS.index(f"B-{k}")
        y[s + 1 : e] = TAGS.index(f"I-{k}")
    return y


def train(examples: list[tuple[str, list]], width: int = 96, rounds: int = 160, batch: int = 48, rate: float = 0.02, hidden: int = 24, seed: int = 7) -> Tagger:
    """Trains a tagger from labelled spans: (text, [(start, end, kind)]). Texts are padded or cut to width."""
    model, r = Tagger(hidden, seed), np.random.default_rng(seed)
    xs, ys = np.full((width, len(examples)), 6, np.int8), np.zeros((width, len(examples)), np.int64)
    for i, (text, spans) in enumerate(examples):
        x = classes(codes(text))[:width]
        xs[: len(x), i] = x
        ys[: len(x), i] = tags_of(len(text), spans)[:width]
    hard = ~allowed()
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for t in range(1, rounds + 1):
        pick = r.choice(len(examples), min(batch, len(examples)), replace=False)
        _, g = model.gradients(xs[:, pick], ys[:, pick])
        g["T"][hard] = 0
        g["S"][model.p["S"] < -20] = 0
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1.0, 3 * (1 - t / (rounds + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            model.p[k] = model.p[k] - lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)
    return model


def training_spans(n: int = 900, seed: int = 11) -> list[tuple[str, list]]:
    """Labelled texts made by rule: personal data in usual and unusual forms among words, and numbers that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    word = lambda: letters(2, 9) if r.random() < 0.8 else letters(2, 9).capitalize() + r.choice([".", ",", ""])

    def card() -> str:
        while True:
            d = digits(r.choice([14, 15, 16, 16, 16, 19]))
            for c in "0123456789":
                if luhn(d[:-1] + c):
                    d = d[:-1] + c
            sep = r.choice(["", "", " ", "-", ".", "/"])
            return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1{a}{b}{c}", f"({a}){b}-{c}"])

    def email() -> str:
        at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("@", " . ")])
        return letters(2, 8) + r.choice(["", "." + digits(2), "_" + letters(1, 4), digits(2)]) + at + letters(3, 9) + r.choice(["", digits(1)]) + r.choice(["", dot + letters(3, 7)]) + dot + r.choice(["com", "org", "net", "de"])

    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    other = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: digits(r.randint(1, 8)),
        lambda: f"{r.randint(1, 999)},{digits(3)}.{digits(2)}", lambda: f"{r.randint(1, 99)}%", lambda: f"#{digits(5)}",
        lambda: f"{r.randint(1, 12)}:{r.randint(10, 59)}", lambda: "@" + letters(3, 8), lambda: f"{letters(2, 4)}-{digits(4)}-{letters(2, 3)}",
        lambda: letters(3, 5) + "=" + "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 30))), lambda: digits(r.randint(20, 30)),
    ]
    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 6))), []
        for _ in range(r.randint(1, 2)):
            text += r.choice([" ", " ", "\n", ": "]) if text else ""
            if r.random() < 0.7:
                k = r.choice(PII_KINDS)
                v = made[k]()
                spans.append((len(text), len(text) + len(v), k))
            else:
                v = r.choice(other)()
            text += v + r.choice(["", "", ".", ","]) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((text, [s for s in spans if s[1] <= 96]))
    return out


_CHECKS = {
    "email": lambda s: s.count("@") == 1 and "." in s[s.index("@") :] and len(s) >= 6,
    "ip": lambda s: len(q := [x.strip() for x in s.split(".")]) == 4 and all(x.isascii() and x.isdigit() for x in q) and is_ip(".".join(q)),
    "card": is_card,
    "phone": lambda s: is_phone(s) and sum(c in " .-()+" for c in s) >= 2,
}
_EDGE = {"email": " .,;:", "ip": " .,;:", "card": " .,;:-/", "phone": " .,;:-"}


def added_spans(texts: list[str], base: list[list], model: Tagger, width: int = 128, group: int = 512) -> list[list]:
    """Spans that the tagger adds to the base spans of each text.

    A text is cut into windows of `width` code points that overlap by half; windows without a digit or an '@'
    can hold no span of any kind and are left out. Windows are decoded in groups. A text's candidates from all
    its windows are then reconciled together: one that touches a window's inner edge may be cut off and counts
    only if no other window has it whole; the rest are taken in order of their distance from the window's edge,
    then by place, where free. Trimmed of marks at the ends, a candidate stays if it passes its kind's check and
    touches no base span.
    """
    half = width // 2
    owner, starts, rows, points = [], [], [], []
    for i, text in enumerate(texts):
        pts = codes(text)
        points.append(len(pts))
        anchor = np.flatnonzero((pts < 128) & _ANCHOR[np.minimum(pts, 127)])
        if not len(anchor):
            continue
        marks = np.unique(np.concatenate([anchor // half, np.maximum(anchor // half - 1, 0)]))
        for s in marks * half:
            owner.append(i)
            starts.append(int(s))
            x = np.full(width, 6, np.int8)
            part = classes(pts[s : s + width])
            x[: len(part)] = part
            rows.append(x)
    found: dict[int, dict] = {}
    for g in range(0, len(rows), group):
        x = np.stack(rows[g : g + group], 1)
        path = model.viterbi(model.scores(x))
        kind = (path + 1) // 2  # 0: none
        for b in np.flatnonzero(kind.any(0)):
            i, s = owner[g + b], starts[g + b]
            k, begin = kind[:, b], path[:, b] % 2 == 1
            cut = np.flatnonzero((np.diff(k, prepend=0) != 0) | (begin & (k > 0)))
            for a, e in zip(cut, [*cut[1:], width]):
                if k[a]:
                    inner_left, inner_right = a == 0 and s > 0, e == width and s + width < points[i]
                    margin = -1 if inner_left or inner_right else min(a if s else width, width - e if s + width < points[i] else width)
                    key = (s + int(a), s + int(e), PII_KINDS[k[a] - 1])
                    found.setdefault(i, {})[key] = max(margin, found.get(i, {}).get(key, -1))
    out: list[list] = [[] for _ in texts]
    for i, spans in found.items():
        taken = [(s, e) for s, e, _ in base[i]]
        reach = max((e - s for s, e in taken), default=0)
        taken.sort()
        for (s, e, k), _ in sorted(spans.items(), key=lambda x: (-x[1], x[0][0], x[0][0] - x[0][1], x[0][2])):
            e = min(e, points[i])
            piece = texts[i][s:e]
            s += len(piece) - len(piece.lstrip(_EDGE[k]))
            e -= len(piece) - len(piece.rstrip(_EDGE[k]))
            if e <= s or not _CHECKS[k](texts[i][s:e]):
                continue
            if texts[i][s - 1 : s].isalnum() or texts[i][e : e + 1].isalnum():  # a part of a longer token
                continue
            at = bisect.bisect_left(taken, (e, 0))
            near = taken[max(0, bisect.bisect_left(taken, (s - reach, 0))) : at]
            if any(a < e and s < b for a, b in near):
                continue
            bisect.insort(taken, (s, e))
            reach = max(reach, e - s)
            out[i].append((s, e, k))
    return out


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text", width: int = 128) -> DataFrame:
    """Finds personal data in every whole text; one row out for each row in.

    Returns (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); the counts and the digest are of
    the base spans, `spans` has those of the tagger too. Null and empty texts have no spans (the digest is then
    that of the empty string). Null ids and repeated rows pass through; an empty table gives none; other columns
    are ignored. Each row is judged alone, so a lost executor costs only its tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(RESULT).fields])

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            base = [pii_spans(x) for x in texts]
            more = added_spans(texts, base, shared.value, width)
            counts = [[sum(k == kind for *_, k in s) for s in base] for kind in PII_KINDS]
            cols = [b.column(0), *[pa.array(c, pa.int64()) for c in counts]]
            cols += [pa.array([digest(s) for s in base], pa.string()), pa.array([joined(ordered(s + m, PII_KINDS)) for s, m in zip(base, more)], pa.string())]
            yield pa.record_batch([*cols, pa.array([len(m) for m in more], pa.int64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
