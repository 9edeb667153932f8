"""Audit records: made without raw values, chained, written, read back and checked."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search, verifier
from .entities import chain

PAST = {"REDACT": "REDACTED", "BLOCK": "BLOCKED", "ALLOW": "ALLOWED", "REVIEW": "FLAGGED_FOR_REVIEW"}
FREE_TEXT = ["document_id", "filename", "detail", "unit_id", "reasons"]


def salted(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(value.cast("string"), F.lit(""))), 256)


def scrubbed(rows: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """rows with free text in which the verifier finds something replaced by a hash; file names lose their folders first.

    Every distinct column is scanned by itself, so a leak in one leaves the others as they are.
    """
    out = rows
    for c in columns:
        kept = [x for x in out.columns if x != c]
        value = F.regexp_extract(F.col(c).cast("string"), r"([^/\\\\]*)\z", 1) if c == "filename" else F.col(c).cast("string")
        scanned = verifier.with_findings(out.select(F.struct(*kept).alias("_row"), F.coalesce(value, F.lit("")).alias("text")))
        safe = F.when(F.size("findings") > 0, F.concat(F.lit("[SCRUBBED:"), F.substring(salted(F.col("text"), salt), 1, 16), F.lit("]"))).otherwise(F.col("text"))
        out = scanned.select("_row.*", safe.alias(c))
    return out.select(*rows.columns)


def entity_records(e: DataFrame, salt: str) -> DataFrame:
    """(doc_id, seq, event, body): a decision for each entity; body is JSON with sorted keys, the value as a salted hash."""
    past = F.create_map(*[F.lit(x) for p in PAST.items() for x in p])
    action = F.coalesce(past[F.upper("action")], F.upper("action"), F.lit("UNKNOWN"))
    body = F.to_json(F.struct(action.alias("action"), F.round("confidence", 4).alias("confidence"), F.col("doc_id").cast("string").alias("document_id"), F.lit("ENTITY_DECISION").alias("event"), F.col("risk_level").alias("risk"), F.col("entity_type").alias("type"), salted(F.col("value"), salt).alias("value_hash")))
    return e.select("doc_id", "seq", F.lit("ENTITY_DECISION").alias("event"), body.alias("body"))


def finding_records(findings: DataFrame) -> DataFrame:
    """(doc_id, seq, event, body) for the verifier's findings, which hold no value; seq is the place in the text."""
    body = F.to_json(F.struct(F.lit("BLOCKED").alias("action"), "detector", F.col("doc_id").cast("string").alias("document_id"), F.lit("VERIFIER_FINDING").alias("event"), F.col("risk_level").alias("risk"), F.col("entity_type").alias("type")))
    return findings.select("doc_id", F.col("text_start").alias("seq"), F.lit("VERIFIER_FINDING").alias("event"), body.alias("body"))


def gate_records(decisions: DataFrame) -> DataFrame:
    """(doc_id, seq, event, body), one for each gate decision (doc_id, decision, status, reasons); the last of its document."""
    ready = F.col("decision") == "PASS"
    body = F.to_json(F.struct(ready.alias("ai_ready"), F.col("doc_id").cast("string").alias("document_id"), F.lit("GATE_DECISION").alias("event"), F.col("decision").alias("gate_decision"), "reasons", F.col("status").alias("status_code")))
    return decisions.select("doc_id", F.lit((1 << 31) - 1).alias("seq"), F.lit("GATE_DECISION").alias("event"), body.alias("body"))


def security_records(events: DataFrame, salt: str) -> DataFrame:
    """(doc_id, seq, event, body) for files refused before they are read (doc_id, filename, code, detail), scrubbed."""
    rows = scrubbed(events, ["filename", "detail"], salt)
    body = F.to_json(F.struct("code", "detail", F.col("doc_id").cast("string").alias("document_id"), F.lit("SECURITY_EVENT").alias("event"), "filename", F.lit("BLOCK").alias("gate_decision")))
    return rows.select("doc_id", F.lit(0).alias("seq"), F.lit("SECURITY_EVENT").alias("event"), body.alias("body"))


def append(records: DataFrame, path: str) -> None:
    """Chains the records of each document and appends them as JSON lines."""
    chain(records.select("doc_id", F.col("seq").cast("int").alias("seq"), "body")).write.mode("append").json(path)


def read(records: DataFrame, document=None, event: str | None = None, last: int | None = None) -> DataFrame:
    """Records of a document and of an event; with last the latest so many, by (doc_id, seq)."""
    out = records
    if document is not None:
        out = out.where(F.col("doc_id") == F.lit(document))
    if event is not None:
        out = out.where(F.get_json_object("body", "$.event") == event)
    return out if last is None else out.orderBy(F.col("doc_id").desc(), F.col("seq").desc()).limit(last)


def raw_values(records: DataFrame, needles: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, seq, value_hash): records whose body holds a value (needles: value), told by 16 digits of its hash.

    Values of fewer than `least` characters, blanks around them aside, are not looked for. Bodies are searched where they are.
    """
    values = needles.select("value").where(F.length(F.trim("value")) >= least).distinct()
    hits = search.held(records.select("doc_id", "seq", "body"), "body", values)
    return hits.select("doc_id", "seq", F.substring(F.sha2("value", 256), 1, 16).alias("value_hash")).distinct()


def compliance(records: DataFrame, needles: DataFrame) -> DataFrame:
    """One row (lines, raw_value_hits, free_text_hits, compliant): whether the log holds raw values, or free text with any.

    The fields of free text are scanned by the verifier; a line that is no JSON counts as a hit.
    """
    raw = raw_values(records, needles).agg(F.count(F.lit(1)).alias("raw_value_hits"))
    fields = [F.struct(F.lit(c).alias("field"), F.get_json_object("body", f"$.{c}").alias("text")) for c in FREE_TEXT]
    broken = F.try_parse_json("body").isNull()
    units = records.select("doc_id", "seq", F.explode(F.array(*fields)).alias("x")).select("doc_id", "seq", "x.*").where("text is not null")
    free = verifier.with_findings(units).where(F.size("findings") > 0).agg(F.count(F.lit(1)).alias("n"))
    lines = records.agg(F.count(F.lit(1)).alias("lines"), F.count_if(broken).alias("broken"))
    out = lines.crossJoin(raw).crossJoin(free)  # one row each
    hits = F.col("n") + F.col("broken")
    return out.select("lines", "raw_value_hits", hits.alias("free_text_hits"), ((F.col("raw_value_hits") == 0) & (hits == 0)).alias("compliant"))
