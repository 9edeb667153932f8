"""Entities as relations: overlaps, components, merging, policy, redaction, gate, audit, evaluation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import POLICY, POLICY_ALLOWED, RISKS, TYPES


def lookup(pairs, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in pairs for x in p])[key], F.lit(default))


def risk_rank(kind: Column) -> Column:
    return lookup([(t, RISKS.index(r)) for t, r, _ in TYPES], kind, RISKS.index("HIGH"))


def risk_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, RISKS)), F.greatest(rank, F.lit(0)).cast("int"))


def overlap_pairs(e: DataFrame) -> DataFrame:
    """Pairs within a block whose overlap is at least .7 of the shorter or .3 of the union: (doc, block, a, b)."""
    a, b = e.alias("a"), e.alias("b")
    inter = F.least("a.text_end", "b.text_end") - F.greatest("a.text_start", "b.text_start")
    la, lb = F.col("a.text_end") - F.col("a.text_start"), F.col("b.text_end") - F.col("b.text_start")
    near = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.block_id") == F.col("b.block_id")) & (F.col("a.seq") < F.col("b.seq")) & (inter > 0)
    return a.join(b, near & ((inter / F.least(la, lb) >= 0.7) | (inter / (la + lb - inter) >= 0.3))).select(
        F.col("a.doc_id").alias("doc_id"), F.col("a.block_id").alias("block_id"), F.col("a.seq").alias("a"), F.col("b.seq").alias("b")
    )


def components(e: DataFrame) -> DataFrame:
    """Adds `component`, the least seq of the overlap component; union-find within a block, whose entities are few."""
    schema = e.withColumn("component", F.col("seq")).schema

    def solve(pdf):
        pdf = pdf.sort_values("seq")
        parent = dict(zip(pdf.seq, pdf.seq))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        live: list = []
        for r in pdf.sort_values(["text_start", "text_end", "seq"]).itertuples():
            live = [x for x in live if x.text_end > r.text_start]
            for x in live:
                inter = min(x.text_end, r.text_end) - max(x.text_start, r.text_start)
                p, q = x.text_end - x.text_start, r.text_end - r.text_start
                if inter > 0 and (inter / min(p, q) >= 0.7 or inter / (p + q - inter) >= 0.3):
                    u, v = root(x.seq), root(r.seq)
                    parent[max(u, v)] = min(u, v)
            live.append(r)
        return pdf.assign(component=[root(x) for x in pdf.seq])

    return e.groupBy("doc_id", "block_id").applyInPandas(solve, schema)


def merge(e: DataFrame) -> DataFrame:
    """One entity for each component: the riskiest, then most specific type; the widest span; the best confidence.

    The value is that of a member spanning the whole range, else of the best (confidence, length, first seq); for
    phones the longest with a '+'. Layers and cues are united.
    """
    special = lookup([(t, s) for t, _, s in TYPES], F.col("entity_type"), 50)
    order = F.struct((-risk_rank(F.col("entity_type"))).alias("r"), special.alias("s"), F.col("text_start"), F.col("text_end"), F.col("seq"))
    first = lambda *cols: F.struct(*cols, (-F.col("seq")).alias("n"))
    g = e.groupBy("doc_id", "block_id", "component").agg(
        F.min_by("entity_type", order).alias("entity_type"),
        F.min("text_start").alias("text_start"), F.max("text_end").alias("text_end"), F.max("confidence").alias("confidence"),
        F.max_by("value", first("confidence", F.length("value"))).alias("best"),
        F.max_by("value", first((F.col("text_end") - F.col("text_start")).alias("l"))).alias("wide"),
        F.max(F.struct((F.col("text_end") - F.col("text_start")).alias("l"))).alias("wl"),
        F.max_by("value", F.when((F.col("entity_type") == "PHONE") & F.contains("value", F.lit("+")), first(F.length("value").alias("l"), "confidence"))).alias("plus"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("detection_layers")))).alias("detection_layers"),
        F.count(F.lit(1)).alias("members"),
    )
    whole = F.col("wl.l") == F.col("text_end") - F.col("text_start")
    value = F.when((F.col("entity_type") == "PHONE") & F.col("plus").isNotNull(), F.col("plus")).when(whole, F.col("wide")).otherwise(F.col("best"))
    return g.select("doc_id", "block_id", "component", "entity_type", value.alias("value"), "text_start", "text_end", "confidence", "detection_layers", "members")


def dedupe(e: DataFrame) -> DataFrame:
    return e.groupBy("doc_id", "block_id", "text_start", "text_end", "entity_type").agg(
        F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("detection_layers")))).alias("detection_layers")
    )


def decide(e: DataFrame) -> DataFrame:
    """Adds risk and action: the tier's action at its least confidence, else its uncertainty action; unknown: HIGH, REDACT.

    An entity whose whole value, trimmed, is on the allow-list is allowed.
    """
    tier = [(t, k) for k, (_, types, *_) in enumerate(POLICY) for t in types]
    n = lookup(tier, F.col("entity_type"), -1)
    conf = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))
    rank = F.greatest(risk_rank(F.col("entity_type")), lookup([(t, RISKS.index(POLICY[k][0])) for t, k in tier], F.col("entity_type"), RISKS.index("HIGH")))
    action = F.lit("REDACT")
    for k, (_, _, least, sure, unsure) in enumerate(POLICY):
        action = F.when((n == k) & (conf >= least), sure).when(n == k, unsure).otherwise(action)
    if "value" in e.columns:
        action = F.when(F.col("value").rlike(rf"\A\s*(?:{'|'.join(POLICY_ALLOWED)})\s*\z"), "ALLOW").otherwise(action)
    return e.withColumn("risk_level", risk_name(rank)).withColumn("action", action)


def document_action(docs: DataFrame, e: DataFrame) -> DataFrame:
    """(doc_id, action, risk, n_entities) for every document; those without entities are allowed."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk_level")) - 1
    g = e.groupBy("doc_id").agg(F.bool_or(F.col("action") == "BLOCK").alias("b"), F.bool_or(F.col("action") != "ALLOW").alias("r"), F.max(F.when(F.col("action") != "ALLOW", rank)).alias("k"), F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(g, "doc_id", "left").select(
        "doc_id", F.when(F.col("b"), "BLOCK").when(F.col("r"), "REDACT").otherwise("ALLOW").alias("action"), risk_name(F.coalesce("k", F.lit(0))).alias("risk"), F.coalesce("n", F.lit(0)).alias("n_entities")
    )


def islands(e: DataFrame) -> DataFrame:
    """Merges spans that overlap (touching ones stay apart); the label is the riskiest member's, the first on ties."""
    ok = e.where("text_start >= 0 and text_end > text_start")
    w = Window.partitionBy("doc_id", "block_id").orderBy("text_start", F.col("text_end").desc(), "seq")
    reach = F.max("text_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = ok.withColumn("new", F.when(reach.isNull() | (F.col("text_start") >= reach), 1).otherwise(0))
    runs = runs.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.struct(risk_rank(F.col("entity_type")).alias("r"), (-F.col("text_start")).alias("s"), F.col("text_end").alias("e"), (-F.col("seq")).alias("q"))
    return runs.groupBy("doc_id", "block_id", "island").agg(F.min("text_start").alias("text_start"), F.max("text_end").alias("text_end"), F.max_by("entity_type", first).alias("entity_type"))


def _to_redact(blocks: DataFrame, e: DataFrame) -> DataFrame:
    """The entities that are not allowed; fits: whether the block has the span."""
    wanted = e.where("coalesce(action, '') <> 'ALLOW'") if "action" in e.columns else e
    sizes = blocks.select("doc_id", "block_id", F.length(F.coalesce("text", F.lit(""))).alias("_size"))
    fits = F.coalesce((F.col("text_start") >= 0) & (F.col("text_start") < F.col("text_end")) & (F.col("text_end") <= F.col("_size")), F.lit(False))
    return wanted.join(sizes, ["doc_id", "block_id"], "left").withColumn("fits", fits).drop("_size")


def unapplied(blocks: DataFrame, e: DataFrame) -> DataFrame:
    """(doc_id, block_id, seq) of the entities that redact cannot apply: without offsets, or with ones outside the block."""
    return _to_redact(blocks, e).where(~F.col("fits")).select("doc_id", "block_id", "seq")


def redact(blocks: DataFrame, e: DataFrame, mode: str = "token") -> DataFrame:
    """(doc_id, block_id, text) with the spans replaced: mode token, `[REDACTED_type]`, or block, a bar of the same length."""
    spans = islands(_to_redact(blocks, e).where("fits"))
    g = spans.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("text_start", "text_end", "entity_type"))).alias("spans"))
    j = blocks.select("doc_id", "block_id", "text").join(g, ["doc_id", "block_id"], "left")
    label = (lambda s: F.concat(F.lit("[REDACTED_"), s["entity_type"], F.lit("]"))) if mode == "token" else (lambda s: F.rpad(F.lit(""), s["text_end"] - s["text_start"], "█"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    fold = F.aggregate("spans", start, lambda a, s: F.struct(s["text_end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["text_start"] - a["at"]), label(s)).alias("out")))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(fold["out"], F.substring(F.col("text"), fold["at"] + 1, F.length("text"))))
    return j.select("doc_id", "block_id", text.alias("text"))


def pseudonyms(e: DataFrame) -> DataFrame:
    """Adds `[TYPE_n]`: the same value (trimmed, any case) has the same number, counted by type in order of appearance in a document."""
    key = F.lower(F.trim("value"))
    w = Window.partitionBy("doc_id", "entity_type", key)
    rows = e.withColumn("seen", F.min("seq").over(w))
    n = F.dense_rank().over(Window.partitionBy("doc_id", "entity_type").orderBy("seen"))
    return rows.withColumn("token", F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), n, F.lit("]"))).drop("seen")


def gate(docs: DataFrame, ceiling: str = "NONE", block_injections: bool = True, block_unicode: bool = False, require_integrity: bool = False) -> DataFrame:
    """Reasons against release, in fixed order, from one row of facts for each document; any reason blocks.

    Facts that docs may leave out: unresolved_risk, the worst of the entities neither redacted nor allowed;
    finding_risk, the worst of the findings (CRITICAL where it is null); n_redaction_errors; n_unicode, anomalies;
    integrity_ok, null where the file was not checked; residual_risk. Risks count when they are over the ceiling; an
    unknown one counts as CRITICAL.
    """
    fact = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    level = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RISKS)), F.upper(c)), F.lit(0)) - 1, F.lit(len(RISKS) - 1))
    over = lambda c: level(c) > RISKS.index(ceiling)
    unresolved, intact, residual = fact("unresolved_risk", "string"), fact("integrity_ok", "boolean"), fact("residual_risk", "string")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    conf = F.coalesce(F.nanvl("ocr_confidence", F.lit(0.0)), F.lit(0.0))
    reasons = F.array(
        F.when(f("pipeline_error"), "PIPELINE_ERROR"),
        F.when(F.col("document_action").isNull(), "POLICY_NOT_APPLIED").when(F.col("document_action") == "BLOCK", "POLICY_BLOCK"),
        F.when(unresolved.isNotNull() & over(unresolved), F.when(level(unresolved) == len(RISKS) - 1, "CRITICAL_PII_PRESENT").otherwise("UNREDACTED_PII_PRESENT")),
        F.when((F.col("n_unapplied") > 0) | (fact("n_redaction_errors", "int") > 0), "REDACTION_INCOMPLETE"),
        F.when(F.col("n_findings").isNull(), "VERIFICATION_MISSING"),
        F.when((F.col("n_findings") > 0) & over(fact("finding_risk", "string")), "RESIDUAL_LEAK_DETECTED"),
        F.when(f("uncertain"), "VERIFIER_UNCERTAIN"),
        F.when(conf <= 0.60, "LOW_CONFIDENCE_UNCERTAINTY"),
        F.when(F.lit(block_injections) & (F.col("n_injections") > 0), "PROMPT_INJECTION_DETECTED"),
        F.when(F.lit(block_unicode) & (fact("n_unicode", "int") > 0), "UNICODE_ANOMALY_DETECTED"),
        F.when(~intact, "INTEGRITY_CHECK_FAILED").when(F.lit(require_integrity) & intact.isNull(), "INTEGRITY_CHECK_MISSING"),
    )
    out = docs.withColumn("r", F.filter(reasons, lambda x: x.isNotNull()))
    out = out.withColumn("r", F.when((F.size("r") == 0) & residual.isNotNull() & over(residual), F.array(F.lit("RESIDUAL_RISK_EXCEEDED"))).otherwise(F.col("r")))
    return out.select("doc_id", F.when(F.size("r") > 0, "BLOCK").otherwise("PASS").alias("decision"), F.when(F.size("r") > 0, F.get("r", F.lit(0))).otherwise("DOCUMENT_SANITIZED_AND_VERIFIED").alias("status"), F.array_join("r", ",").alias("reasons"))


GENESIS = "0" * 64


def chain(records: DataFrame) -> DataFrame:
    """Adds prev_hash and record_hash, a SHA-256 chain for each document in order of seq; records: doc_id, seq, body."""
    g = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("rs"))
    start = F.struct(F.lit(GENESIS).alias("h"), F.array().cast("array<struct<seq:int,body:string,prev_hash:string,record_hash:string>>").alias("out"))

    def step(a, r):
        h = F.sha2(F.concat(a["h"], F.lit("|"), r["body"]), 256)
        return F.struct(h.alias("h"), F.concat(a["out"], F.array(F.struct(r["seq"].cast("int").alias("seq"), r["body"].alias("body"), a["h"].alias("prev_hash"), h.alias("record_hash")))).alias("out"))

    return g.select("doc_id", F.explode(F.aggregate("rs", start, step)["out"]).alias("r")).select("doc_id", "r.*")


def verify_chain(records: DataFrame) -> DataFrame:
    """(doc_id, first_bad): the first seq whose hash or link is wrong, null if none; rows are checked side by side."""
    before = F.coalesce(F.lag("record_hash").over(Window.partitionBy("doc_id").orderBy("seq")), F.lit(GENESIS))
    good = (F.col("record_hash") == F.sha2(F.concat("prev_hash", F.lit("|"), "body"), 256)) & (F.col("prev_hash") == F.col("was"))
    return records.withColumn("was", before).groupBy("doc_id").agg(F.min(F.when(~good, F.col("seq"))).alias("first_bad"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]
