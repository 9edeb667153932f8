import base64
import gzip
import re
import tracemalloc
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common, cover_tree, decontam, mixing, ngram_join, pii, secrets, sharding, spans, suffix_tree, text, toxicity, url_filter

DOCS = "doc_id long, text string, source string, shard int, n long, extra string"
LONG = "lorem ipsum dolor " * 20000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "a", 0, 1, "x"), (2, None, "a", 0, None, None), (3, "", None, 0, 1, "y"), (4, LONG, "b", 0, 1, "z"), (None, "orphan text", "b", 1, 1, None),
    (5, "The quick brown fox jumps over the lazy dog again and again", "b", 1, 1, None), (5, "The quick brown fox jumps over the lazy dog again and again", "b", 1, 1, None), (6, " \t\n", "c", 1, 1, None), (7, "one two", None, 1, 1, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes():
    w = text.Words(pa.array(["Ab c", "", "ab", "é  x"], pa.large_string()))
    assert list(w.doc) == [0, 0, 2, 3, 3] and w.hash[0] == w.hash[2]
    assert list(text.hash_of(["ab", "c"])) == list(w.hash[:2])


def test_sharding(docs, none):
    got = sharding.shard(docs, 4).toPandas()
    assert len(got) == len(ROWS) and got["size"].sum() == sum(len((r[1] or "").encode()) + 1 for r in ROWS)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard(none, 4).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(ROWS) and (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2
    assert sorted(map(tuple, got[["size", "taken"]].values)) == sorted(map(tuple, mixing.mix(docs).toPandas()[["size", "taken"]].values))
    assert mixing.mix(none).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    q = spark.createDataFrame([("a", 100), ("b", 37), (None, 7)], "source string, quota int")
    got = mixing.splitting_tree(q, 8).toPandas()
    assert dict(got.fillna("-").groupby("source").quota.sum()) == {"a": 100, "b": 37, "-": 7}
    assert set(got.groupby("shard").quota.sum()) == {18}


def test_pii(docs, none):
    model = pii.train(pii.training_spans(300), rounds=40)
    assert {r.spans for r in pii.find_pii(docs, model).collect()} == {""} and pii.find_pii(none, model).count() == 0
    s = "mail x.y@a.example.com, 10.0.0.1, 4111 1111 1111 1111, +1 (555) 010-1234 and 300.1.1.1"
    assert spans.joined(spans.pii_spans(s)) == "email:5:22,ip:24:32,card:34:53,phone:55:72"


@pytest.mark.parametrize("s", ["", "a@b@c.d.e", "1.2.3.4.5.6", "+1 2", "x@y", "@a.b", "1" * 5000, "4111-1111 11111111 1"])
def test_pii_matches_plain_patterns(s):
    email = re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)
    ip = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if len(s) < 1000 else []
    want = [(m.start(), m.end(), "email") for m in email] + [(m.start(), m.end(), "ip") for m in ip if all(int(p) <= 255 for p in m.group().split("."))]
    assert [x for x in spans.pii_spans(s) if x[2] in ("email", "ip")] == sorted(want)


def test_tagger_gradients():
    m = pii.Tagger(4)
    ex = pii.training_spans(4)
    x = np.stack([np.pad(pii.classes(pii.codes(t))[:20], (0, 0)) for t, _ in ex if len(t) >= 20], 1)
    y = np.zeros(x.shape, int)
    _, g = m.gradients(x, y)
    for k in ("Ef", "Ub", "Vf", "c"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m.p[k][i]
        m.p[k][i] = old + 1e-5
        up = m.gradients(x, y)[0]
        m.p[k][i] = old - 1e-5
        assert abs((up - m.gradients(x, y)[0]) / 2e-5 - g[k][i]) < 1e-4 * max(1, abs(g[k][i]))
        m.p[k][i] = old


SECRET = "password=abcdef1234567890"


@pytest.mark.parametrize("wrap", [
    quote, lambda s: quote(quote(s, safe=""), safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(), lambda s: base64.b64encode(gzip.compress(quote(s).encode())).decode(),
])
def test_secrets_in_layers(wrap):
    s = "see " + wrap(SECRET) + " end"
    base, added, _ = secrets.scan(s)
    assert any(k == "assign" for *_, k in base + added) and all(4 <= a < b <= len(s) - 4 for a, b, _ in base + added)


def lines(s, n):
    return "\n".join(s[i : i + n] for i in range(0, len(s), n))


@pytest.mark.parametrize("payload", [
    gzip.compress(b"a" * (17 << 20) + b" " + SECRET.encode()), gzip.compress(b"nothing here") + gzip.compress(SECRET.encode()), gzip.compress(b"x") + gzip.compress(gzip.compress(SECRET.encode())),
    b"\x01 " + SECRET.encode(), b"\xff\xfe " + SECRET.encode() + b" \x00", gzip.compress(b"\x00\xff " + SECRET.encode()), b"fifty bytes of text before the one that matters: " + SECRET.encode(),
    gzip.compress(np.random.default_rng(0).bytes(3000) + SECRET.encode()), zlib.compress(b"x^ " + SECRET.encode()),
])
@pytest.mark.parametrize("width", [64, 76, 1 << 30])
@pytest.mark.parametrize("before", ["see ", "a line of words\n", "word\n"])
def test_secrets_in_layers_that_are_large_broken_or_wrapped(payload, width, before):
    s = before + lines(base64.b64encode(payload).decode(), width) + "\nend"
    base, added, _ = secrets.scan(s)
    assert not base and [k for *_, k in added if k == "assign"] == ["assign"] and all(0 <= a < b <= len(s) for a, b, _ in added)


def test_secrets_in_many_layers():
    many = single = SECRET.encode()
    for _ in range(1000):
        single = zlib.compress(single)
    for _ in range(90):
        many = gzip.compress(b"x") + gzip.compress(many)
    for data in (single, many, gzip.compress(b"x") + gzip.compress(b"y" * 1000)[:20]):
        assert [k for *_, k in secrets.scan("see " + base64.b64encode(data).decode())[1] if k == "assign"] == ["assign"] * (data in (single, many))


def test_secrets_in_invalid_url_escapes():
    assert [k for *_, k in secrets.scan("%ff%00" + "".join(f"%{b:02x}" for b in SECRET.encode()))[1] if k == "assign"] == ["assign"]


def test_secrets_edges(docs, none):
    assert {r.spans for r in secrets.scan_secrets(docs).collect()} == {""} and secrets.scan_secrets(none).count() == 0


def test_toxicity(docs, none):
    texts = [f"fine words here {i} and more" for i in range(60)] + [f"you idiot {'moron ' * (i % 3)} go {i}" for i in range(60)]
    y = np.array([0] * 60 + [1] * 60)
    sample = toxicity.Sample.of(texts, y, 16)
    m = toxicity.OrdinalModel.fit(sample, toxicity.severities(sample, 4), n_grades=4)
    p = m.exceed(text.strings(pa.array(["an idiot moron", "fine words", "", None])))
    assert (np.diff(m.thresholds) >= 0).all() and p[0, 0] > 0.5 > p[1, 0] and p[2, 0] < 0.5
    assert toxicity.score_toxicity(docs, m).count() == len(ROWS) and toxicity.score_toxicity(none, m, keep=True).count() == 0


def test_decontamination(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "unseen words only here for nothing at all")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x y " + item.upper() + " z"), (2, item.replace("zeta ", "")), (3, "alpha beta gamma other words"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: (r.item_ids, r.min_edits) for r in decontam.decontaminate(d, bench).collect()} == {1: ("1", 0), 2: ("1", 1), 3: ("", None), 4: ("", None)}
    assert {r.item_ids for r in decontam.decontaminate(d, bench, block_bytes=40).collect()} == {"1", ""}
    assert decontam.decontaminate(docs, bench).where("contaminated").count() == 0 and decontam.decontaminate(none, bench, keep=True).count() == 0


def test_decontamination_finds_edited_copies_of_any_length():
    r = np.random.default_rng(3)
    sizes = [1] * 12 + [2, 3, 4, 5, 7, 12, 20, 40, 100, 130, 243, 256, 300] + [512, 700, 1024, 1500, 2000]
    items = [[f"w{x}" for x in r.integers(0, 5000, n)] for n in sizes]
    index = decontam.Index(list(range(len(items))), [" ".join(x) for x in items], 0.8, 0.99)
    lost = tried = 0
    for i, x in enumerate(items):
        for _ in range(2 if len(x) > 500 else 8):
            y = list(x)
            for _ in range(decontam.edits_allowed(len(x), 0.8)):
                at, kind = int(r.integers(len(y))), int(r.integers(3))
                y[at : at + (kind < 2)] = [f"v{r.integers(99)}"] * (kind != 1)
            words = [f"u{k}" for k in r.integers(0, 99, 9)] + y + [f"u{k}" for k in r.integers(0, 99, 9)]
            found = decontam.find(index, text.strings(pa.array(["x", " ".join(words), ""])))
            row = np.zeros(len(words) + 1, int)  # the least distance to any run of words
            number: dict = {}
            code = np.array([number.setdefault(c, len(number)) for c in words])
            for k, c in enumerate(x):
                new = np.r_[k + 1, np.minimum(row[:-1] + (code != number.get(c, -1)), row[1:] + 1)]
                row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
            assert found[0] == found[2] == {} and found[1].get(i, row.min()) == row.min()
            lost += i not in found[1]
            tried += 1
            assert i in found[1] or 4 < len(x) < decontam.LONG  # exact words, and pieces, lose nothing
    assert lost <= 0.03 * tried
    same = decontam.Index([0], ["a " * 600], 0.8, 0.99)
    assert decontam.find(same, text.strings(pa.array(["a " * 3000, "a " * 400])))  == [{0: 0}, {}]


def test_ngram_join(spark, docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {(1, 9, 1), (5, 9, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (6, 0, 6), (7, 1, 7), (None, 1, None)}
    assert ngram_join.jaccard_components(none).count() == 0
    r = np.random.default_rng(0)
    base = [f"w{i}" for i in r.integers(0, 9999, 60)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in r.integers(0, 60, int(r.integers(0, 4))):
            w[k] = f"v{r.integers(0, 99)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(57)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 512):
        assert {x.doc_id: x.component_id for x in ngram_join.jaccard_components(df, block=block).collect()} == label


def test_embeddings(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 8))
    x[30:] = x[:30] + r.normal(size=(30, 8)) * 0.25
    rows = [(i, [float(v) for v in q]) for i, q in enumerate(x)] + [(90, None), (91, []), (92, [0.0] * 8), (93, [float("nan")] * 8), (94, [None] * 8), (95, [float(v) for v in x[0]]), (96, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 60 or i == 95}
    links = {i: {j for j in ok if j != i and ok[i] @ ok[j] >= 0.95} for i in ok}
    for cell in (7, 4096):
        got = {q.vec_id: q for q in cover_tree.near_duplicates(df, cell=cell).collect()}
        assert len(got) == len(rows) and all(got[i].n_links == len(links.get(i, ())) for i in got)
        assert all(got[i].component_id == got[j].component_id for i in links for j in links[i]) and got[92].kept
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, "x"), (4, None), (5, "http://q.net/es/#a"), (6, "http://com/"), (7, "http://notcom/")]
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, ["notcom"]).collect()}
    assert got == {1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("q.net", "/es/", "net/es/", "block"), 6: ("com", "/", "com/", "allow"), 7: ("notcom", "/", None, "block")}


def test_language_model(docs, none):
    got = suffix_tree.score_texts(docs, most_common=2).toPandas()
    train = [(r[1] or "").lower().split() for r, out in zip(ROWS, suffix_tree.held_out([r[0] for r in ROWS], 7, 2)) if not out]
    words = [w for t in train for w in [*t, None]]
    n, v = len(words), len(set(words))
    assert set(got.train_tokens) == {n} and len(got) == len(ROWS)
    for r in got.itertuples():
        mine = next((t for i, t, *_ in ROWS if i == r.doc_id), None) if r.doc_id == r.doc_id else "orphan text"
        want = sum(np.log10((words.count(w) + 1) / (n + v + 1)) for w in [*(mine or "").lower().split(), None]) if len(mine or "") < 1000 else r.base_score
        assert abs(want - r.base_score) < 1e-6
    assert suffix_tree.score_texts(none).count() == 0


def test_suffix_tree_is_a_distribution(docs):
    counts = suffix_tree.gather(docs, "doc_id", "text", 3, 7, 2)
    tree = suffix_tree.grow_tree(counts, 3, 1e-9, 0.001)
    used = tree.logp.shape[1] - 1
    assert np.allclose((10 ** tree.logp[:, :-1]).sum(1) + (257 - used) * 10 ** tree.logp[:, -1], 1)
    a = text.strings(pa.array(["the quick brown fox", "", "é"]))
    assert np.allclose(tree.score(a, span=4), tree.score(a, span=1000))


@pytest.mark.parametrize("most", [0, 50, 1 << 21])
def test_suffix_tree_keeps_contexts_of_a_small_source(spark, most):
    rows = [(i, "ab" * 300_000) for i in range(3)] + [(10 + i, t) for i, t in enumerate(["the cat sat", "the cat sat on the mat", "a cat that sat", "the mat", "the hat", "", "zebra é"])]
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most_strings=most).collect()}
    out = suffix_tree.held_out([i for i, _ in rows], 7, 2)
    counts: dict = {}
    for (_, t), o in zip(rows, out):
        b = bytes([suffix_tree.PAD] * 5) + t.encode() + bytes([suffix_tree.END])
        for i in range(5, 0 if o else len(b)):
            for k in range(6):
                row = counts.setdefault(b[i - k : i], {})
                row[b[i]] = row.get(b[i], 0) + 1
    enough = {c for c, r in counts.items() if sum(r.values()) >= 2 or not c}
    p = {b"": np.array([(counts[b""].get(s, 0) + 1) / (sum(counts[b""].values()) + 257) for s in range(257)])}
    keep = {b""}
    for c in sorted(enough - {b""}, key=len):
        n = np.array([counts[c].get(s, 0) for s in range(257)])
        p[c] = (n + 8 * p[c[1:]]) / (n.sum() + 8)
        if len(c) <= 2 or (p[c] * np.log(p[c] / p[c[1:]])).sum() >= 0.003:
            keep |= {c[k:] for k in range(len(c) + 1)}
    for i, t in rows[3:]:
        b = bytes([suffix_tree.PAD] * 5) + t.encode() + bytes([suffix_tree.END])
        want = sum(np.log10(p[next(b[j - k : j] for k in range(5, -1, -1) if b[j - k : j] in keep)][b[j]]) for j in range(5, len(b)))
        assert abs(want - got[i]) < 1e-6
    assert any(out[3:]) and any(len(c) == 5 and b"t" in c for c in keep)


def test_pipeline_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    d = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, "other", "en", "s", 5), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert got.columns == d.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3]


def test_pipeline_mixes_whole_texts(spark):
    import corpus_pipeline

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3 + 37 * (i % 5) ** 2)), "en", "abc"[i % 3], i) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got, mixed = corpus_pipeline.mix_sources(spark, d, "").collect(), mixing.mix(d, corpus_pipeline.WEIGHTS, 1.5, 2.0, corpus_pipeline.SHARDS).toPandas()
    assert {tuple(r) for r in got} <= set(rows) and ((mixed.taken % mixed["size"]) > 0).any()
    for source, g in mixed.groupby("source"):
        words = sum(len(r.text.split()) for r in got if r.source == source)
        assert abs(words - g.taken.sum()) <= g["size"].max() / 2


def test_pipeline_stage_compares_rows_not_ids(spark):
    import corpus_pipeline

    a, b, c = ("a b c d e f g", "one two three four five six seven", "only here are these eight words to find")
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (None, a), (None, c), (None, c), (4, None), (4, None), (None, " "), (None, " ")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, d, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (4, None), (4, None), (None, " "), (None, " ")], key=str)


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_ngram_join_with_a_passage_that_all_share(spark, words, percent):
    r = np.random.default_rng(2)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = [f"o{i // 3}x{k}" for k in range(int(r.integers(0, 40)))] + shared
        for _ in range(int(r.integers(0, 4))):
            w[int(r.integers(0, len(w)))] = f"e{r.integers(0, 999)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + words]) for k in range(len(t.split()) - words + 1)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(9):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent, block=16)
    assert {x.doc_id: x.component_id for x in got.collect()} == label


def test_ngram_join_refuses_a_senseless_threshold(docs):
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(docs, percent=0)


def test_urls_in_blocks_and_with_long_hosts(spark):
    hosts = [f"h{i}.example" for i in range(50)]
    rows = [(i, f"http://www.h{i}.example/") for i in range(60)] + [(100, "http://" + "a." * 5000 + "h7.example/x"), (101, "http://" + "b." * 5000 + "com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    table = spark.createDataFrame([(h,) for h in [*hosts, None, ""]], "h string")
    for block_bytes in (500, 1 << 20):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, [("allow", "com/"), ("allow", "h3.example/")], table, block_bytes=block_bytes).collect()}
        assert got == {i: ("h3.example/", "allow") if i == 3 else (None, "block" if i < 50 else "allow") for i in range(60)} | {100: (None, "block"), 101: ("com/", "allow")}


def test_digests_that_collide_are_told_apart():
    index = url_filter.DigestArray.build(["a", "b", "c"])
    blob = np.frombuffer(index, np.uint8).copy()
    blob[8:32] = np.frombuffer(np.uint64(url_filter.xxhash.xxh64_intdigest(b"b")).tobytes() * 3, np.uint8)  # all three digests alike
    keys = url_filter.DigestArray(blob.tobytes())
    assert [k >= 0 for k in keys.find(["b"])] == [True] and keys.key(int(keys.find(["b"])[0])) == b"b"


def test_training_sample_takes_long_texts_and_one_text_for_an_id(spark):
    rows = [(1, "b b"), (1, "a a"), (2, "long " * 50_000), (3, "other"), (4, None)]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    s = toxicity.training_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels, 10)
    want = toxicity.Sample.of(["a a", "long", "other", ""], [1, 1, 0, 0])
    assert list(s.label) == [1, 1, 0, 0] and s.doc.tolist() == want.doc.tolist() and s.feat.tolist() == want.feat.tolist()


def test_stages_take_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["doc_id", "text", "source", "target", "part", "s", "b", "cut", "_size", "draw", "_all", "_found0", "a.b", "key", "is_toxic"]
    d = spark.createDataFrame([(i, f"some words here {i} " + "x y z " * i, "a", *["v"] * 12) for i in range(4)], T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in names]))
    got = corpus_pipeline.mix_sources(spark, d, "")
    assert got.columns == names and {r["a.b"] for r in got.collect()} == {"v"}
    marked = decontam.decontaminate(d, spark.createDataFrame([(1, "some words here 2")], "item_id long, text string"), keep=True)
    assert marked.columns[: len(names)] == names and {r.doc_id for r in marked.where("contaminated").collect()} == {2}


def test_keys_are_counted_in_bounded_memory():
    r = np.random.default_rng(3)
    own = r.integers(1 << 62, size=5_000_000)
    own[::5] = 12345
    lists = lambda x: pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], names=["keys"])
    batches = [lists(x) for x in np.array_split(own, 40)]
    found, times, width, kept, peak = [], [], 1 << 60, 0, 0
    tracemalloc.start()
    for b in ngram_join.counted(iter(batches), 1, width):
        for part, n, run in zip(*[c.to_pylist() for c in b.columns]):
            key, count = ngram_join.unpack(run, n)
            assert (key // np.uint64(width) == part).all() and (np.diff(key.astype(np.int64)) > 0).all()
            found.append(key)
            times.append(count)
            kept += key.nbytes + count.nbytes
        peak = max(peak, tracemalloc.get_traced_memory()[1] - kept)
        tracemalloc.reset_peak()
    tracemalloc.stop()
    key, inv = np.unique(np.concatenate(found), return_inverse=True)
    wanted, n = np.unique(own.view(np.uint64) >> np.uint64(1), return_counts=True)
    assert (key == wanted).all() and (np.bincount(inv, np.concatenate(times)) == n).all()
    assert peak < 100e6


def test_workers_give_back_what_they_freed():
    def mb():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    held = [np.ones(12_000) for _ in range(3000)]  # 288 MB
    last = np.ones(12_000)  # lies behind them and keeps them from going back by themselves
    full = mb()
    del held
    assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2] and len(last)
    assert full - mb() > 200
