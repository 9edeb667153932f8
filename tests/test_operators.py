import re

import pandas as pd
import pyspark.sql.functions as F
import pytest

from palimpsest.functions import checks, masking
from palimpsest.operators import catalog, entities, spans


def test_offsets_cut_out_the_value(spark):
    text = "a@b.com é😀 c@d.org, x c@d.org"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = spans.scan(df, [p for p in catalog.PATTERNS if p[0] == "EMAIL"]).collect()
    assert [(r.text_start, r.value) for r in sorted(got, key=lambda r: r.text_start)] == [(m.start(), m.group()) for m in re.finditer(r"\w@\w\.\w+", text)]
    assert all(text[r.text_start : r.text_end] == r.value for r in got)


def test_allow_list_and_headers(spark):
    df = spark.createDataFrame([(1, "INC-2026-219457890"), (2, "Status"), (3, None), (4, "")], "doc_id int, text string")
    assert spans.scan(df).count() == 0


@pytest.mark.parametrize("number,ok", [("236", True), ("237", False), ("234567890124", True)])
def test_verhoeff(spark, number, ok):
    assert spark.range(1).select(checks.verhoeff_ok(F.lit(number))).first()[0] is ok


def test_masks(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("abcdef",)], "v string").coalesce(1)
    assert [r[0] for r in df.select(masking.display(F.col("v"))).collect()] == ["••", "a•c", "a••••f"]


def test_touching_spans_stay_apart(spark):
    e = spark.createDataFrame([(1, "b", 0, "PERSON", 0, 4), (1, "b", 1, "SSN", 4, 8), (1, "b", 2, "PERSON", 10, 20), (1, "b", 3, "SSN", 12, 15), (1, "b", 4, "SSN", -1, 3)], "doc_id int, block_id string, seq int, entity_type string, text_start int, text_end int")
    got = sorted((r.text_start, r.text_end, r.entity_type) for r in entities.islands(e).collect())
    assert got == [(0, 4, "PERSON"), (4, 8, "SSN"), (10, 20, "SSN")]


def test_redaction_is_idempotent(spark):
    blocks = spark.createDataFrame([(1, "b", "mail a@b.com now"), (2, "b", None)], "doc_id int, block_id string, text string")
    pats = [p for p in catalog.PATTERNS if p[0] == "EMAIL"]
    e = spans.scan(blocks, pats).withColumn("seq", F.lit(0))
    once = entities.redact(blocks, e).orderBy("doc_id").collect()
    assert once[0].text == "mail [REDACTED_EMAIL] now" and once[1].text is None
    assert spans.scan(entities.redact(blocks, e), pats).count() == 0


def test_documents_without_entities_are_allowed(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    e = spark.createDataFrame([(1, "SSN", 0.2)], "doc_id int, entity_type string, confidence double")
    got = {r.doc_id: (r.action, r.risk) for r in entities.document_action(docs, entities.decide(e)).collect()}
    assert got == {1: ("BLOCK", "CRITICAL"), 2: ("ALLOW", "NONE")}


def test_values_are_rewritten_longest_first_and_tokens_stay():
    from palimpsest.operators import rewriting

    pairs = {"Ann": "[PERSON_1]", "Ann Lee": "[PERSON_2]", "REDACTED": "x"}
    assert rewriting.replaced("Ann Lee and Ann, Annex [REDACTED_SSN]", pairs) == "[PERSON_2] and [PERSON_1], Annex [REDACTED_SSN]"
    assert rewriting.replaced("ann", {"Ann": "t"}, any_case=True) == "t" and rewriting.replaced(None, pairs) is None


def test_policies_that_are_unsafe_are_refused():
    from palimpsest.operators import policy

    assert policy.checked({})["rules"]["CRITICAL"]["uncertainty_action"] == "BLOCK"
    for bad in ({"fail_closed": False}, {"rules": {"CRITICAL": {"action": "ALLOW"}}}, {"rules": {"HIGH": {"min_confidence_to_redact": 1.5}}}, {"rules": {"MEDIUM": {"entities": ["SSN"]}}}, {"allow_lists": {"x": ["("]}}):
        with pytest.raises(ValueError):
            policy.checked(bad)


def test_compliance_finds_raw_values_and_broken_lines(spark):
    from palimpsest.operators import audit

    log = spark.createDataFrame([(1, 0, '{"detail": "ok"}'), (1, 1, '{"detail": "card of Ann Lee (x)"}'), (2, 0, "{broken")], "doc_id int, seq int, body string")
    got = audit.raw_values(log, spark.createDataFrame([("Ann Lee",), ("ok",), ("none",)], "value string")).collect()
    assert [(r.doc_id, r.seq) for r in got] == [(1, 1)]


def test_values_are_found_in_long_lines_without_shuffling_them(spark, monkeypatch):
    from palimpsest.operators import audit, search

    words = " ".join(f"w{i}ab@c{i % 7}.org" for i in range(4000))
    bodies = ["x" + words, "é😀Ann Lee 1", "Ann\nLee", None, "", "***", "abc", "a" * 3000, words[: search.HEAD]]
    needles = ["w17ab@c3.org", "w3999ab@c2.org", "7ab@", "Ann Lee", "😀Ann", "***", "abc", " ab ", "absent", "ab", None, "a" * 2500, words[1500:9000]]
    log = spark.createDataFrame(list(enumerate(bodies)), "seq int, body string").selectExpr("seq % 2 as doc_id", "seq", "body")
    monkeypatch.setattr(search, "SLICE", 1 << 10)
    found = search.held(log, "body", spark.createDataFrame([(v,) for v in needles if v], "value string"))
    assert {(r.seq, r.value) for r in found.collect()} == {(i, v) for i, b in enumerate(bodies) for v in needles if v and b and v in b}
    got = audit.raw_values(log, spark.createDataFrame([(v,) for v in needles], "value string"))
    want = {(i, v) for i, b in enumerate(bodies) for v in needles if b and v and len(v.strip()) >= 3 and v in b}
    assert got.count() == len(want) and {r.seq for r in got.collect()} == {i for i, _ in want}


def test_names_are_carried_without_a_row_for_each_word(spark):
    from palimpsest.operators import release, resolution

    blocks = spark.createDataFrame([(1, "a", "Hi Ann Lee, ann lee; Bo Ray"), (1, "b", "Ann Leeds and ANN LEE"), (2, "a", "Ann Lee"), (3, "a", None)], "doc_id int, block_id string, text string")
    names = spark.createDataFrame([(1, "Ann Lee"), (1, "Bo Ray"), (1, "--"), (2, "Bo Ray"), (3, "Bo Ray")], "doc_id int, name string")
    found = resolution.occurrences(blocks, names, ["doc_id"], "PERSON", 0.9, "ner")
    assert sorted((r.doc_id, r.block_id, r.value, r.text_start, r.name) for r in found.collect()) == [(1, "a", "Ann Lee", 3, "Ann Lee"), (1, "a", "Bo Ray", 21, "Bo Ray"), (1, "a", "ann lee", 12, "Ann Lee"), (1, "b", "ANN LEE", 14, "Ann Lee")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct" not in plan(found) and "regexp_extract_all(lower(" not in plan(release.detect(blocks))
    person = [("PERSON", "x", "Ann Lee", 0.9, False, False)]
    got = release.detect(blocks, person).collect()
    assert sorted((r.doc_id, r.block_id, r.value) for r in got) == [(1, "a", "Ann Lee"), (1, "a", "ann lee"), (1, "b", "ANN LEE"), (1, "b", "Ann Lee"), (2, "a", "Ann Lee")]


def test_texts_without_a_sign_are_not_searched(spark, monkeypatch):
    from palimpsest.plans.catalog import CATALOG_TEXTS

    texts = [t for _, t in CATALOG_TEXTS] + ["ſee peſel abcdef", "١٢٣-45-6789 ssn", "plain words only", "a@upi b", "", None, "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    every = lambda: sorted(map(tuple, spans.scan(df).collect()))
    signed = every()
    assert "(?U)\\d" in spans.scan(df)._jdf.queryExecution().optimizedPlan().toString().split("Filter")[-1]
    monkeypatch.setattr(spans, "SIGNS", {})
    assert signed == every() and {r[0] for r in signed} >= {18, 21}


def test_texts_that_fold_to_themselves_have_no_view_of_their_own(spark):
    from palimpsest.operators import verifier

    units = spark.createDataFrame([(1, "a 123-45-6789"), (2, "plain"), (3, None), (4, "Dr Who"), (5, "J o h n  S m i t h")], "doc_id int, text string")
    found = verifier.scan(units)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("spacing_evasion") == 1 and {r.doc_id for r in found.collect()} == {1, 4, 5}
    look = verifier.views_of(verifier.ALLOWED, 4).func
    got = look(pd.Series(["né über", "x１é", "a\u200bé ½ 1", "é RSK-12 1", "é J o h n", "e\u0301 J o h n", None]))
    rows = [tuple(r) for r in got.itertuples(index=False)]
    none = (None,) * 5
    assert rows[0] == none and rows[6] == none
    assert rows[1] == ("x1é", None, None, None, []) and rows[3] == ("é ###### 1", None, None, None, [])
    assert rows[2] == ("aé 1⁄2 1", [0, 2, 3, 4, 4, 4, 5, 6, 7], None, None, [])
    assert rows[4] == ("é J o h n", None, "éJohn", [0, 2, 4, 6, 8, 9], [{"s": 0, "e": 9}])
    assert rows[5] == ("e J o h n", [0, 2, 3, 4, 5, 6, 7, 8, 9, 10], "eJohn", [0, 3, 5, 7, 9, 10], [{"s": 0, "e": 9}])
