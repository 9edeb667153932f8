"""From documents to a release decision: detection over the whole catalog, then policy, redaction, verification, gate."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import checks

from . import context, verifier
from .catalog import HIDDEN, INJECTIONS, PATTERNS
from .entities import decide, document_action, gate, redact, unapplied
from .policy import assessment
from .resolution import clean, propagate, resolve
from .spans import scan


def detect(blocks: DataFrame, patterns=PATTERNS, terms: list[str] = (), names: bool = True) -> DataFrame:
    """Entities of blocks (doc_id, block_id, text, with section_context where there is one), through all layers.

    Catalog scan, cue and section boosts, validators, resolution, cleaning, and, with names, names carried through
    each document. Returns doc_id, block_id, seq, entity_type, value, offsets, confidence, detection_layers. Up to resolution
    a block is one row of one projection; from there on only entities are shuffled, and, if a pattern finds persons, blocks once
    to carry names. No other layer makes a PERSON, so without such a pattern there are no names to carry.
    """
    found = context.cue_boost(scan(blocks, patterns, keep_text=True))
    check = checks.validate(F.col("entity_type"), F.col("value"))
    boost = context.section_boost(F.col("section_context")) if "section_context" in blocks.columns else F.lit(0.0)
    found = found.withColumn("_check", check)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("confidence") + boost) + F.col("_check.delta")))
    layers = F.filter(F.array(F.lit("regex"), F.when((F.size("context_cues") > 0) | (boost > 0), "context"), F.when(F.col("_check.status") != "NOT_APPLICABLE", "validator")), lambda x: x.isNotNull())
    order = Window.partitionBy("doc_id", "block_id").orderBy("text_start", "text_end", "entity_type", "variant")
    rows = found.select("doc_id", "block_id", (F.row_number().over(order) - 1).alias("seq"), "entity_type", "value", "text_start", "text_end", sure.alias("confidence"), layers.alias("detection_layers"))
    rows = clean(resolve(rows), terms)
    return propagate(blocks, rows, terms) if names and any(p[0] == "PERSON" for p in patterns) else rows


def injections(text: Column) -> Column:
    """How many of the injection patterns a text matches."""
    return sum((F.when(text.rlike(p), 1).otherwise(0) for p in INJECTIONS), F.lit(0))


def hidden(text: Column) -> Column:
    """How many characters of a text are not seen but read."""
    return F.length(text) - F.length(F.translate(text, "".join(HIDDEN), ""))


def isolated(doc_id: Column, text: Column) -> Column:
    """struct(payload, risk): the text, without hidden characters, in an envelope of data; HIGH with an injection, MEDIUM with hidden characters."""
    risk = F.when(injections(text) > 0, "HIGH").when(hidden(text) > 0, "MEDIUM").otherwise("LOW")
    body = F.translate(text, "".join(HIDDEN), "")
    payload = F.concat(F.lit('<document_payload id="'), doc_id.cast("string"), F.lit('" role="data_only">\n'), body, F.lit("\n</document_payload>"))
    return F.struct(payload.alias("payload"), risk.alias("risk"))


def checkpoint(docs: DataFrame, blocks: DataFrame, entities: DataFrame, cut=lambda df: df, **gate_options) -> tuple[DataFrame, DataFrame]:
    """(decisions, redacted blocks): the gate's decision for every document, and what it would release.

    Policy, redaction in tokens, the verifier over the redacted blocks, prompt safety and the gate, in this order. A
    document without blocks, or without a block that holds text, has an uncertain report and is blocked: nothing shows that
    it is clean. decisions: doc_id, decision, status, reasons, inherent, residual, n_entities, n_findings.

    cut is put around the judged entities, the redacted blocks and the findings, each of which is read several times:
    DataFrame.checkpoint, or a function that writes a table and reads it. Without it the plan holds the whole catalog and
    all verifier rules many times over and takes minutes to compile, whatever the number of documents.
    """
    judged = cut(decide(entities))
    lost = unapplied(blocks, judged)
    clean_blocks = cut(redact(blocks, judged))
    findings = cut(verifier.scan(clean_blocks.select("doc_id", "block_id", "text")))
    reports = verifier.report(clean_blocks, findings)
    risk = assessment(docs, judged, lost, findings, reports)
    unsafe = clean_blocks.groupBy("doc_id").agg(F.sum(injections(F.coalesce("text", F.lit("")))).alias("n_injections"), F.sum(hidden(F.coalesce("text", F.lit("")))).alias("n_unicode"))
    lost = lost.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unapplied"))
    action = document_action(docs, judged).select("doc_id", F.col("action").alias("document_action"), "n_entities")
    facts = action.join(lost, "doc_id", "left").join(reports, "doc_id", "left").join(unsafe, "doc_id", "left").join(risk.select("doc_id", "inherent", "residual"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    facts = facts.select(
        "doc_id", "document_action", "n_entities", "n_findings", "inherent", "residual", zero("n_unapplied"), zero("n_injections"), zero("n_unicode"), F.lit(False).alias("pipeline_error"),
        F.coalesce(F.col("status") == "VERIFIER_UNCERTAIN", F.lit(True)).alias("uncertain"), F.lit(1.0).alias("ocr_confidence"), F.col("residual").alias("residual_risk"),
    )
    decisions = gate(facts, **gate_options).join(facts.select("doc_id", "inherent", "residual", "n_entities", zero("n_findings")), "doc_id")
    return decisions, clean_blocks
