"""Queries of resolution, tables, policy, rewriting, audit, geometry and release, and the SQL that says the same."""

from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.operators import audit, evaluation, policy, release, resolution, rewriting, tables
from palimpsest.operators import entities as E
from palimpsest.operators import spans as S
from palimpsest.operators.catalog import INJECTIONS

from .catalog import BLOCKS, CARD_RE, EMAIL_RE, _fixture, _found, _read, query

SALT = "palimpsest"


def _blocks(spark, sf_dir):
    return S.text_blocks(_read(spark, sf_dir, "documents"))


def _emails(spark, sf_dir):
    return _found(spark, sf_dir).where("entity_type = 'EMAIL'")


@query()
def detect_documents(spark, sf_dir):
    """The whole catalog through all layers over every document: resolved entities by type."""
    e = release.detect(_blocks(spark, sf_dir))
    return e.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


CELLS = """
SELECT n_regionkey AS doc_id, n_regionkey AS table_id, ['Name', 'Key'] AS headers, list([n_name, n_nationkey::VARCHAR] ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey"""


def _tables(spark, sf_dir):
    row = F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("r"))
    g = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row)).alias("x"))
    return g.select(F.col("n_regionkey").alias("doc_id"), F.col("n_regionkey").alias("table_id"), F.array(F.lit("Name"), F.lit("Key")).alias("headers"), F.transform("x", lambda v: v["r"]).alias("rows"))


@query(f"""
WITH t AS ({CELLS}),
h AS (SELECT doc_id, table_id, -1 AS r, unnest(range(0, 2)) AS c, headers, rows FROM t),
b AS (SELECT doc_id, table_id, unnest(range(0, len(rows))) AS r, headers, rows FROM t),
x AS (SELECT doc_id, table_id, r, unnest(range(0, 2)) AS c, headers, rows FROM b),
a AS (SELECT doc_id, table_id, r, c, headers[c + 1] AS text, NULL AS header_name FROM h UNION ALL SELECT doc_id, table_id, r, c, rows[r + 1][c + 1], headers[c + 1] FROM x)
SELECT doc_id, table_id || '_r' || r || '_c' || c AS block_id, (r + 1) * 10000 + c AS seq, text, header_name, r AS row_index, c AS col_index FROM a""")
def s12_cells(spark, sf_dir):
    return tables.flatten(_tables(spark, sf_dir))


@query(f"""
SELECT doc_id, '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda r: '| ' || r[1] || ' | ' || r[2] || ' |'), chr(10)) AS markdown FROM ({CELLS})""")
def s15_markdown(spark, sf_dir):
    return _tables(spark, sf_dir).select("doc_id", tables.markdown(F.col("headers"), F.col("rows")).alias("markdown"))


@query("""
SELECT s_suppkey AS doc_id, 'c' AS block_id, CASE s_suppkey % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'SSN' ELSE 'PAN' END AS entity_type, s_name AS value, 0 AS text_start, length(s_name) AS text_end,
  CASE s_suppkey % 5 WHEN 0 THEN 0.85 ELSE 0.70 END::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 5 IN (0, 1, 3)""")
def c2_header_entities(spark, sf_dir):
    heads = F.array(*map(F.lit, ["Applicant", "SSN", "Balance", "Company", "Full Name"]))
    cells = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("c").alias("block_id"), F.col("s_name").alias("text"), F.get(heads, (F.col("s_suppkey") % 5).cast("int")).alias("header_name"))
    return tables.header_entities(cells).drop("context_cues")


@query(_fixture("seq", [(0,), (2,), (4,), (6,), (8,), (10,)]))
def f6_clean(spark, sf_dir):
    rows = [(0, "EMAIL", "a@b.com"), (1, "EMAIL", "a at b"), (2, "DOB", "1 May 1990"), (3, "DOB", "May"), (4, "EMPLOYEE_ID", "EMP-1234"), (5, "EMPLOYEE_ID", "v6.0"), (6, "AADHAAR", "2345 6789 0123"), (7, "AADHAAR", "2345"), (8, "ADDRESS", "12 Elm Street"), (9, "ADDRESS", "United States"), (10, "PERSON", "Ann Lee"), (11, "PERSON", "Risk Committee"), (12, "PERSON", "approved"), (13, "SSN", "--")]
    return resolution.clean(spark.sql(_fixture("seq, entity_type, value", rows))).select("seq")


@query(_fixture("value", [("PHONE",), ("keep",)]))
def f5_resolver_allow_list(spark, sf_dir):
    rows = [("RSK-12",), ("(INC-2026-17)",), (" ISO 27001 ",), ("Status",), ("PHONE",), ("keep",)]
    return spark.sql(_fixture("value", rows)).where(~resolution.allowed(F.col("value")))


@query(_fixture("doc_id, block_id, value, text_start, confidence", [(1, "a", "Ann Lee", 3, 0.8), (1, "b", "ANN LEE", 8, 0.92), (2, "a", "Bo", 0, 0.9)]))
def r8_propagate(spark, sf_dir):
    blocks = spark.sql(_fixture("doc_id, block_id, text", [(1, "a", "Hi Ann Lee"), (1, "b", "ask for ANN LEE; not Ann Leeds"), (2, "a", "Bo met Ann Lee")]))
    e = spark.sql(_fixture("doc_id, block_id, seq, entity_type, value, text_start, text_end, confidence", [(1, "a", 0, "PERSON", "Ann Lee", 3, 10, 0.8), (2, "a", 0, "PERSON", "Bo", 0, 2, 0.9)]))
    return resolution.propagate(blocks, e.withColumn("detection_layers", F.array(F.lit("ner")))).select("doc_id", "block_id", "value", "text_start", "confidence")


@query(rf"""
WITH w AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark WHERE regexp_matches(text, '^[\x00-\x7F]*$')),
p AS (SELECT DISTINCT w[1] || ' ' || w[2] || ' ' || w[3] AS name FROM w WHERE len(w) >= 3),
b AS ({BLOCKS})
SELECT name, count(*) AS n FROM (
  SELECT name, unnest(regexp_extract_all(lower(text), '(?:^|[^\pL\pN\pM_])(' || name || ')(?:$|[^\pL\pN\pM_])')) AS v FROM b JOIN p ON contains(lower(b.text), p.name)) GROUP BY name""")
def n5_gazetteer(spark, sf_dir):
    """The first three words of each plain benchmark item as a user's dictionary, looked up in every block."""
    items = _read(spark, sf_dir, "benchmark").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    phrases = items.select(w.alias("w")).where("size(w) >= 3").select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("name")).distinct()
    found = resolution.occurrences(_blocks(spark, sf_dir).drop("seq"), phrases, [], "PERSON", 0.95, "ner")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
WITH m AS (SELECT doc_id, 'EMAIL' AS t, 'HIGH' AS r, unnest(regexp_extract_all(text, '{EMAIL_RE}')) FROM documents UNION ALL SELECT doc_id, 'CARD', 'CRITICAL', unnest(regexp_extract_all(text, '{CARD_RE}')) FROM documents),
n AS (SELECT doc_id, t, r, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT doc_id, sum(n)::BIGINT AS n_entities, string_agg(t || '=' || n, ',' ORDER BY t) AS types, string_agg(r || '=' || n, ',' ORDER BY r) AS risks FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_entities, 0) AS n_entities, coalesce(types, '') AS types, coalesce(risks, '') AS risks FROM documents d LEFT JOIN s USING (doc_id)""")
def r10_documents(spark, sf_dir):
    return resolution.summary(_read(spark, sf_dir, "documents"), E.decide(_found(spark, sf_dir))).drop("n_blocks", "unresolved_critical")


@query(rf"""
SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE}')) AS target, '[REDACTED_EMAIL]' AS token FROM documents""")
def t4_replacements(spark, sf_dir):
    return rewriting.replacements(_blocks(spark, sf_dir), _emails(spark, sf_dir))[0]


@query(rf"""
SELECT doc_id, regexp_replace(text, '{EMAIL_RE}', '[REDACTED_EMAIL]', 'g') AS text FROM documents WHERE regexp_matches(text, '{EMAIL_RE}')""")
def t6_by_values(spark, sf_dir):
    pairs = t4_replacements(spark, sf_dir).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "token"))).alias("values"))
    return rewriting.by_values(_read(spark, sf_dir, "documents").select("doc_id", "text").join(pairs, "doc_id")).drop("values")


@query(rf"""
SELECT doc_id, regexp_replace(text, '{EMAIL_RE}', '[REDACTED:EMAIL]', 'g') AS text FROM documents WHERE regexp_matches(text, '{EMAIL_RE}')""")
def t5_by_spans(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").where(F.col("text").rlike("(?U)" + EMAIL_RE))
    spans = F.transform(S.matches(F.col("text"), "(?U)" + EMAIL_RE), lambda m: F.struct(m["s"].alias("start"), m["e"].alias("end"), F.lit("EMAIL").alias("type")))
    return docs.select("doc_id", rewriting.by_spans(F.col("text"), spans).alias("text"))


@query(rf"""
SELECT doc_id, string_agg(regexp_replace(text, '{EMAIL_RE}', '[REDACTED_EMAIL]', 'g'), chr(10) || chr(10) ORDER BY seq) AS text FROM ({BLOCKS}) GROUP BY doc_id""")
def t3_documents(spark, sf_dir):
    return rewriting.documents(_blocks(spark, sf_dir), _emails(spark, sf_dir))


@query(_fixture("seq", [(1,)]))
def t3_orphans(spark, sf_dir):
    blocks = spark.sql(_fixture("doc_id, block_id", [(1, "a")]))
    return rewriting.orphans(blocks, spark.sql(_fixture("doc_id, block_id, seq, action", [(1, "a", 0, "REDACT"), (1, "b", 1, "REDACT"), (2, "a", 2, "ALLOW")]))).select("seq")


@query(rf"""
WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '{EMAIL_RE}')) AS e, len(regexp_extract_all(text, '{CARD_RE}')) AS c FROM documents)
SELECT doc_id, CASE WHEN c > 0 THEN 'CRITICAL' WHEN e > 0 THEN 'HIGH' ELSE 'NONE' END AS inherent,
  CASE WHEN doc_id % 5 = 0 OR (doc_id % 3 = 0 AND c > 0) THEN 'CRITICAL' WHEN doc_id % 3 = 0 AND e > 0 THEN 'HIGH' ELSE 'NONE' END AS residual, c AS n_critical, e AS n_high, 0 AS n_medium, 0 AS n_low FROM m""")
def p5_assessment(spark, sf_dir):
    """What the e-mails and cards of the documents leave, if every third document is not applied and every fifth not verified."""
    docs, e = _read(spark, sf_dir, "documents"), E.decide(_found(spark, sf_dir))
    reports = docs.where("doc_id % 5 <> 0").select("doc_id", F.lit("VERIFIED_CLEAN").alias("status"))
    return policy.assessment(docs, e, e.where("doc_id % 3 = 0"), e.where("false"), reports)


@query(rf"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{policy.FINANCIAL}') OR regexp_matches(text, '{policy.HEALTH}') OR regexp_matches(text, '{policy.PERSONNEL}') THEN 0.95 WHEN turn % 4 = 0 THEN 0.90 WHEN turn % 4 = 1 THEN 0.10 ELSE 0.75 END::DOUBLE AS score FROM conversations WHERE text <> ''""")
def p7_sensitivity(spark, sf_dir):
    verb = F.when(F.col("turn") % 4 == 0, "pay").when(F.col("turn") % 4 == 1, "write")
    rows = _read(spark, sf_dir, "conversations").where("text <> ''")
    return rows.select("conv_id", "turn", policy.sensitivity(F.col("text"), F.lit("zz"), F.lit("PERSON"), verb)["score"].alias("score"))


_ANY = " OR ".join(f"regexp_matches(text, '{p}')" for p in INJECTIONS)


@query(f"""
SELECT conv_id, turn, CASE WHEN {_ANY} THEN 'HIGH' ELSE 'LOW' END AS risk, '<document_payload id="' || conv_id || '" role="data_only">' || chr(10) || text || chr(10) || '</document_payload>' AS payload FROM conversations""")
def i3_isolated(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").withColumn("x", release.isolated(F.col("conv_id"), F.col("text"))).select("conv_id", "turn", "x.risk", "x.payload")


@query(rf"""
WITH b AS ({BLOCKS}), v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{EMAIL_RE}')) AS v FROM documents)
SELECT DISTINCT doc_id, seq, substr(sha256(v), 1, 16) AS value_hash FROM b JOIN v ON contains(b.text, v.v)""")
def a5_raw_values(spark, sf_dir):
    """The documents' lines as a log that leaks: where the documents' e-mails stand in it."""
    lines = _blocks(spark, sf_dir).select("doc_id", "seq", F.col("text").alias("body"))
    return audit.raw_values(lines, _emails(spark, sf_dir).select("value"))


@query(rf"""
SELECT count(*) AS lines, 0 AS raw_value_hits, 0 AS free_text_hits, true AS compliant FROM (SELECT unnest(regexp_extract_all(text, '{EMAIL_RE}')) FROM documents)""")
def a5_compliance(spark, sf_dir):
    e = E.decide(_emails(spark, sf_dir))
    return audit.compliance(audit.entity_records(e, SALT), e.select("value"))


@query(rf"""
SELECT doc_id, sha256('{SALT}:' || v) AS value_hash, 'REDACTED' AS action FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE}')) AS v FROM documents)""")
def a1_entity_records(spark, sf_dir):
    r = audit.read(audit.entity_records(E.decide(_emails(spark, sf_dir)), SALT), event="ENTITY_DECISION")
    return r.select("doc_id", F.get_json_object("body", "$.value_hash").alias("value_hash"), F.get_json_object("body", "$.action").alias("action"))


@query(_fixture("doc_id, filename, detail", [(1, "a.docx", "plain"), (2, "b.txt", "[SCRUBBED]")]))
def a2_scrubbed(spark, sf_dir):
    rows = spark.sql(_fixture("doc_id, filename, detail", [(1, "/tmp/a.docx", "plain"), (2, "b.txt", "SSN 123-45-6789")]))
    return audit.scrubbed(rows, ["filename", "detail"], SALT).withColumn("detail", F.regexp_replace("detail", ":[0-9a-f]{16}", ""))


@query(rf"""
WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '{EMAIL_RE}')) AS e, len(regexp_extract_all(text, '{CARD_RE}')) AS c FROM documents),
s AS (SELECT sum(e)::BIGINT AS e, sum(c)::BIGINT AS c, count(*) FILTER (c > 0) AS leaks, count(*) AS docs FROM m)
SELECT e AS tp, 0 AS fp, c AS fn, 1.0::DOUBLE AS "precision", e / (e + c) AS recall, 2 * (e / (e + c)) / (1 + e / (e + c)) AS f1, 0.0::DOUBLE AS critical_recall, e / (e + c) AS high_recall, leaks / docs AS leak_rate, 0.0::DOUBLE AS over_redaction FROM s""")
def e4_report(spark, sf_dir):
    """A finder of e-mails alone against the documents' e-mails and cards."""
    truth = _found(spark, sf_dir).withColumn("page", F.lit(1))
    found = truth.where("entity_type = 'EMAIL'")
    return evaluation.report(_read(spark, sf_dir, "documents"), found, truth, evaluation.match(found, truth))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity / 60 AS x0, l_discount AS y0, (l_quantity + 10) / 60 AS x1, l_discount + 0.5 AS y1, round_even(l_quantity, 0)::INT AS p0, round_even(l_quantity + 10, 0)::INT AS p1 FROM lineitem""")
def b1_boxes(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    box = G.to_shares(F.array(q, d * 20, q + 10, d * 20 + 10), F.lit(60), F.lit(20))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).withColumn("p", G.to_pixels(F.col("b"), F.lit(60), F.lit(20)))
    return rows.select("l_orderkey", "l_linenumber", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("p")[0].alias("p0"), F.col("p")[2].alias("p1"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE least(1.0, greatest(0.0, o_totalprice / 100000)) END::DOUBLE AS confidence, o_orderstatus = 'F' OR o_totalprice / 100000 <= 0.60 AS low FROM orders""")
def b5_confidence(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderpriority"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", G.page_confidence(text, F.col("o_totalprice") / 100000).alias("x")).select("o_orderkey", "x.*")


@query(_fixture("doc_id, x0, x1", [(1, 5.0, 10.0), (2, 2.5, 7.5)]))
def b4_span_boxes(spark, sf_dir):
    rows = spark.sql(_fixture("doc_id, text, s, e", [(1, "aabb", 2, 4), (2, "abcd", 1, 3)]))
    return rows.withColumn("b", G.span_box(F.col("text"), F.col("s"), F.col("e"), F.array(*map(F.lit, (0.0, 0.0, 10.0, 4.0))))).select("doc_id", F.round(F.col("b")[0], 6).alias("x0"), F.round(F.col("b")[2], 6).alias("x1"))
