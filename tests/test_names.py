import io
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.weights import composite
from palimpsest.operators import names
from palimpsest.sources import archives

BLOCKS = "doc_id long, block_id string, text string"


def blocks(spark, *texts):
    return spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], BLOCKS)


def test_names_are_found_once_and_excluded_words_are_none(spark):
    b = blocks(spark, "KC Burney met Rohan S. Deshmukh.", "see Appendix A. Vossberg", "Lars-Erik Holm and Ann Lee-Kane", "J. Policy, M. Team", "", None, "the A. Risk-Group")
    got = names.find_names(b, excluded=["policy", "appendix"], suffixes=["group", "team"]).collect()
    found = {(r.doc_id, r.value, r.variant) for r in got}
    assert {(0, "KC Burney", "initials"), (0, "Rohan S. Deshmukh", "composite"), (2, "Lars-Erik Holm", "composite"), (2, "Ann Lee-Kane", "composite")} <= found
    assert not {r.doc_id for r in got} & {1, 3, 4, 5, 6}
    assert all(r.value == b.where(F.col("doc_id") == r.doc_id).first().text[r.text_start : r.text_end] for r in got)


def test_names_inside_earlier_entities_go(spark):
    b = blocks(spark, "KC Burney", "Rohan S. Deshmukh", "Rohan S. Deshmukh")
    e = spark.createDataFrame([(0, "b", "ADDRESS", 0, 9), (1, "b", "ADDRESS", 0, 17), (2, "b", "PERSON", 0, 17)], "doc_id long, block_id string, entity_type string, text_start int, text_end int")
    assert [(r.doc_id, r.value) for r in names.find_names(b, e).collect()] == [(1, "Rohan S. Deshmukh")]


def test_recognisers_keep_the_surer_of_two(spark):
    got = names.recognise(blocks(spark, "ABCPE1234F and abcde1234f", "EMP-12345", "PESEL: 44051401359", " ", None)).collect()
    assert {(r.doc_id, r.variant, r.value) for r in got} == {(0, "pan_strict", "ABCPE1234F"), (0, "pan_relaxed", "abcde1234f"), (1, "emp_id", "EMP-12345"), (2, "pesel_pattern", "PESEL: 44051401359")}


def test_names_over_lines_become_one_a_line(spark):
    rows = [(1, "x Ann Lee\n Bob Ray\n--", "PERSON", "Ann Lee\n Bob Ray\n--", 2, 22), (2, "a\nb", "ADDRESS", "a\nb", 0, 3)]
    e = spark.createDataFrame(rows, "doc_id long, text string, entity_type string, value string, text_start int, text_end int")
    assert sorted((r.doc_id, r.value, r.text_start, r.text_end) for r in names.split_lines(e).collect()) == [(1, "Ann Lee", 2, 9), (1, "Bob Ray", 11, 18), (2, "a\nb", 0, 3)]


def test_implausible_values_go(spark):
    bad = [("PERSON", "1234"), ("PERSON", "SLA"), ("PERSON", "The Policy"), ("PERSON", "Audit Team"), ("PERSON", "a_b c"), ("ADDRESS", "notify"), ("EMAIL", "a at b"), ("DOB", "last spring"), ("EMPLOYEE_ID", "v2.1"), ("EMPLOYEE_ID", "E12"), ("SSN", "-"), ("PERSON", None), ("PERSON", "Acme")]
    good = [("PERSON", "Ann Lee"), ("ADDRESS", "12 Elm Street"), ("ADDRESS", "Elm Street"), ("EMAIL", "a@b.co"), ("DOB", "1 May 1990"), ("EMPLOYEE_ID", "E12345"), ("SSN", "123-45-6789")]
    rows = [(i, "Acme solutions" if v == "Acme" else v, k, v, 0.85, len(v or "")) for i, (k, v) in enumerate(bad + good)]
    e = spark.createDataFrame(rows, "doc_id long, text string, entity_type string, value string, confidence double, text_end int")
    got = names.plausible(e, excluded=["policy"], suffixes=["team"]).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(bad), len(bad) + len(good)))


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    good = zipped([("word/document.xml", b"<a/>")])
    cases = [
        (good, None), (b"", "NOT_AN_ARCHIVE"), (None, "NOT_AN_ARCHIVE"), (b"PK\x03\x04 no more", "NOT_AN_ARCHIVE"), (zipped([("../x", b"1")]), "PATH_TRAVERSAL"), (zipped([("/x", b"1")]), "PATH_TRAVERSAL"),
        (zipped([("x", bytes(1 << 20))]), "ZIP_BOMB"), (zipped([(str(i), b"") for i in range(10_001)]), "TOO_MANY_ENTRIES"),
    ]
    files = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "n int, content binary")
    assert [r.archive_error for r in archives.with_archive_error(files).orderBy("n").collect()] == [e for _, e in cases]
    assert archives.error_of(zipped([("x", b"abc" * 9)]), unpacked=26) == "ENTRY_TOO_LARGE" and archives.error_of(zipped([("x", b"abc"), ("y", b"abc")]), unpacked=5) == "ARCHIVE_TOO_LARGE"


def test_composite_confidence(spark):
    one = spark.range(1).select(composite({"regex": 0.9, "ner": 1.0, "context": F.lit(None).cast("double")}).alias("x"), composite({"regex": 9.0}).alias("y")).first()
    assert abs(one.x - 0.52) < 1e-9 and one.y == 1.0
    with pytest.raises(ValueError):
        composite({}, {"regex": 0.5})
