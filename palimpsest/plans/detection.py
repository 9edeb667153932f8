"""Queries of the context layer, the verifier, file pre-flight and evaluation, and the SQL that says the same."""

from pyspark.sql import functions as F

from palimpsest.operators import context, evaluation, verifier
from palimpsest.operators import spans as S
from palimpsest.sources import files

from .catalog import EMAIL_RE, _fixture, _found, _read, query

LEFT = [
    (1, "SSN 123-45-6789"), (2, "card 4111 1111 1111 1111"), (3, "mail joe [at] ex [dot] com now"), (4, "J o h n  S m i t h"), (5, "１２３-45-6789"), (6, "passport no C1234567"), (7, "DOB: 15/08/1990"), (8, "Name: Ann Lee"),
    (9, "call 555-0100 x"), (10, "1999-2004 plan"), (11, "budget 1,000,000"), (12, "INC-2026-0417 ok"), (13, "12 Elm Street"), (14, "run 123456789012"), (15, "C O N F I D E N T I A L"), (16, "[REDACTED_SSN] and █████"), (17, ""), (18, None), (19, "а@b.com"),
]
FINDINGS = [
    (1, "SSN", "CRITICAL", "loose_ssn+cue_ssn+digit_entropy", 4, 15), (2, "CARD", "CRITICAL", "luhn_card+cue_card", 5, 24), (3, "EMAIL", "HIGH", "obfuscated_email", 5, 26), (4, "PERSON", "HIGH", "spacing_evasion", 0, 18),
    (5, "SSN", "CRITICAL", "loose_ssn+digit_entropy", 0, 11), (6, "PASSPORT", "CRITICAL", "cue_passport", 12, 20), (7, "DOB", "HIGH", "cue_dob", 5, 15), (8, "PERSON", "HIGH", "cue_name", 6, 13), (9, "PHONE", "HIGH", "loose_phone", 5, 13),
    (13, "ADDRESS", "HIGH", "street_address", 0, 13), (14, "NUMERIC_ID", "CRITICAL", "digit_entropy", 4, 16), (19, "EMAIL", "HIGH", "loose_email", 0, 7),
]


def _units(spark):
    return spark.sql(_fixture("doc_id, text", LEFT)).withColumn("text", F.col("text").cast("string"))


@query(_fixture("doc_id, entity_type, risk_level, detector, text_start, text_end", FINDINGS))
def x_verifier_findings(spark, sf_dir):
    return verifier.scan(_units(spark)).drop("confidence")


@query(_fixture("doc_id, status", [(k, "RESIDUAL_LEAK_DETECTED" if k in {f[0] for f in FINDINGS} else "VERIFIER_UNCERTAIN" if not t else "VERIFIED_CLEAN") for k, t in LEFT]))
def x8_report(spark, sf_dir):
    return verifier.report(_units(spark), verifier.scan(_units(spark))).select("doc_id", "status")


@query(_fixture("doc_id, text, n_findings", [(1, "SSN [REDACTED_SSN]", 1), (10, "1999-2004 plan", 0), (13, "[REDACTED_ADDRESS]", 1)]))
def x10_release(spark, sf_dir):
    return verifier.release(_units(spark).where("doc_id in (1, 10, 13)"))


@query()
def x4_documents(spark, sf_dir):
    """The verifier over every block of the documents: findings by type and detector."""
    found = verifier.scan(S.text_blocks(_read(spark, sf_dir, "documents")))
    return found.groupBy("entity_type", "risk_level", "detector").agg(F.count(F.lit(1)).alias("n"))


MAIL_CUES = context.CUE_WORDS["EMAIL"]


@query(rf"""
WITH d AS (SELECT doc_id, regexp_extract(text, '{EMAIL_RE}') AS v, text FROM documents WHERE regexp_matches(text, '{EMAIL_RE}')),
p AS (SELECT doc_id, text, length(string_split_regex(text, '{EMAIL_RE}')[1]) AS s, length(v) AS n FROM d),
w AS (SELECT doc_id, s, lower(text[greatest(0, s - 80) + 1 : s + n + 80]) AS a FROM p)
SELECT doc_id, s AS text_start, round(least(1.0, 0.5 + least(0.20, 0.08 * len(list_filter({MAIL_CUES}, lambda c: contains(a, c))))), 6) AS confidence FROM w""")
def c1_cue_boost(spark, sf_dir):
    """The first e-mail of each document, by the cues around it."""
    found = S.matches(F.col("text"), "(?U)" + EMAIL_RE)
    e = _read(spark, sf_dir, "documents").select("doc_id", "text", F.get(found, F.lit(0)).alias("m")).where("m is not null")
    e = e.select("doc_id", "text", F.lit("EMAIL").alias("entity_type"), F.lit(0.5).alias("confidence"), F.col("m.s").alias("text_start"), F.col("m.e").alias("text_end"))
    return context.cue_boost(e).select("doc_id", "text_start", F.round("confidence", 6).alias("confidence"))


HEADINGS = [("KYC details", 0.20), (" Employee Personal Information ", 0.25), ("staff contact information (2)", 0.15), ("introduction", 0.0), ("director", 0.15)]


@query(_fixture("heading, boost", HEADINGS))
def c3_section_boost(spark, sf_dir):
    return spark.sql(_fixture("heading", [h[:1] for h in HEADINGS])).select("heading", context.section_boost(F.col("heading")).alias("boost"))


CUED = [(1, "PAN: ABCPE1234F."), (2, "ifsc is HDFC0A12345, ok"), (3, "pan of water"), (4, "no cue here 123456")]


@query(_fixture("doc_id, entity_type, value, text_start, text_end", [(1, "PAN", "ABCPE1234F", 5, 15), (2, "IFSC", "HDFC0A12345", 8, 19)]))
def c4_cue_values(spark, sf_dir):
    cues = {k: context.CUE_WORDS[k] for k in ("PAN", "IFSC")}
    return context.cue_values(spark.sql(_fixture("doc_id, text", CUED)), cues).drop("confidence")


FOUND = [(1, 0, 1, "SSN", "123-45-6789", 4, 15), (1, 1, 1, "SSN", "123-45-6789", 4, 15), (1, 2, 1, "PERSON", "Ann Lee", 20, 27), (1, 3, 2, "PERSON", "Lee", 40, 43), (2, 0, 1, "EMAIL", "a@b.com", 0, 7)]
TRUTH = [(1, 0, 1, "SSN", "123-45-6789", 4, 15), (1, 1, 1, "PERSON", "Ann Lee", 20, 27), (1, 2, 2, "PERSON", "Ann Lee", 0, 7), (2, 0, 1, "PHONE", "a@b.com", 0, 7)]
SPAN = "doc_id, seq, page, entity_type, value, text_start, text_end"


@query(_fixture("doc_id, found_seq, truth_seq", [(1, 0, 0), (1, 2, 1), (1, 3, 2)]))
def e2_greedy_match(spark, sf_dir):
    return evaluation.match(spark.sql(_fixture(SPAN, FOUND)), spark.sql(_fixture(SPAN, TRUTH)))


@query("""
SELECT lang AS domain, avg((contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT) / 2.0) AS retention, count(*) FILTER (contains(lower(text), '@')) AS leaks, count(*) AS cases
FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def e7_utility(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").where("text is not null")
    return evaluation.utility(d.select(F.col("lang").alias("domain"), F.array(F.lit("the"), F.lit("and")).alias("expected"), F.array(F.lit("@")).alias("leaks"), F.col("text").alias("sanitized")))


FILES = [
    ("/in/a.txt", "68656C6C6F", "txt", None), ("/in/b.txt", "680069", "txt", "BINARY_TEXT"), ("/in/c.PDF", "255044462D31", "pdf", None), ("/in/d.pdf", "504B0304", "pdf", "MAGIC_MISMATCH"), ("/in/e.exe", "4D5A", "exe", "UNSUPPORTED_FORMAT"),
    ("/in/f.txt", "", "txt", "EMPTY_FILE"), ("/in/g.tiff", "4D4D002A", "tiff", None), ("/in/h.txt", "<!DOCTYPE x [<!ENTITY".encode().hex().upper(), "txt", "XML_ENTITY"),
]


@query(_fixture("path, format, error", [(p, f, e) for p, _, f, e in FILES]))
def f10_preflight(spark, sf_dir):
    raw = spark.sql(_fixture("path, bytes", [r[:2] for r in FILES])).select("path", F.unhex("bytes").alias("content"))
    return files.preflight(raw.withColumn("length", F.octet_length("content"))).select("path", "format", F.col("error").cast("string").alias("error"))


@query(rf"""
SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, 'EMAIL' AS entity_type, unnest(regexp_extract_all(text, '{EMAIL_RE}')) AS v FROM documents) GROUP BY ALL""")
def r10_summary(spark, sf_dir):
    return _found(spark, sf_dir).where("entity_type = 'EMAIL'").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))
