"""The policy as a file, the risk before and after redaction, and whether a sentence makes a name sensitive."""

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import POLICY, POLICY_ALLOWED, RISKS, TYPES
from .entities import risk_name

ACTIONS = ("REDACT", "BLOCK", "ALLOW", "REVIEW")
DEFAULTS = {
    "fail_closed": True,
    "rules": {tier: {"entities": types, "action": sure, "min_confidence_to_redact": least, "uncertainty_action": unsure} for tier, types, least, sure, unsure in POLICY},
    "unknown_entity_policy": {"action": "REDACT", "risk": "HIGH"},
    "allow_lists": {"business_codes": POLICY_ALLOWED},
}


def _merged(base: Mapping, over: Mapping) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v
    return out


def checked(config: Mapping) -> dict:
    """The policy with defaults filled in; ValueError names the first thing that makes it unsafe or senseless."""
    policy = _merged(DEFAULTS, config)
    if policy["fail_closed"] is not True:
        raise ValueError("fail_closed must be true")
    known, seen = {t for t, *_ in TYPES}, {}
    for tier, rule in policy["rules"].items():
        if tier not in RISKS[1:]:
            raise ValueError(f"no such tier: {tier}")
        if rule.get("action") not in ACTIONS or rule.get("uncertainty_action", "BLOCK") not in ACTIONS:
            raise ValueError(f"{tier}: no such action")
        if "ALLOW" in (rule["action"], rule.get("uncertainty_action")) and tier in ("CRITICAL", "HIGH"):
            raise ValueError(f"{tier}: ALLOW is forbidden")
        least = rule.get("min_confidence_to_redact", 0.0)
        if isinstance(least, bool) or not isinstance(least, (int, float)) or not 0 <= least <= 1:
            raise ValueError(f"{tier}: the least confidence must be between 0 and 1")
        for t in rule.get("entities", []):
            if t not in known:
                raise ValueError(f"{tier}: no such type: {t}")
            if t in seen:
                raise ValueError(f"{t} is in {seen[t]} and in {tier}")
            seen[t] = tier
    if policy["unknown_entity_policy"].get("action") not in ("REDACT", "BLOCK"):
        raise ValueError("unknown types must be redacted or blocked")
    for group, patterns in policy["allow_lists"].items():
        for p in patterns:
            try:
                re.compile(p)
            except re.error as x:
                raise ValueError(f"{group}: {p}: {x}") from x
    return policy


def load(path: str) -> dict:
    """A policy from a YAML file; a missing file, bad YAML or a file that holds no mapping raise."""
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            config = yaml.safe_load(f)
        except yaml.YAMLError as x:
            raise ValueError(f"{path}: {x}") from x
    if not isinstance(config, Mapping):
        raise ValueError(f"{path} holds no policy")
    return checked(config)


def decided(e: DataFrame, policy: Mapping) -> DataFrame:
    """Adds action by a policy as load or checked give it; a null or NaN confidence is 0, unknown types get the unknown's action."""
    conf = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))
    action = F.lit(policy["unknown_entity_policy"]["action"])
    for rule in policy["rules"].values():
        sure = F.when(conf >= float(rule.get("min_confidence_to_redact", 0.0)), rule["action"]).otherwise(rule.get("uncertainty_action", "BLOCK"))
        action = F.when(F.col("entity_type").isin(rule.get("entities", [])), sure).otherwise(action)
    every = [p for patterns in policy["allow_lists"].values() for p in patterns]
    if every and "value" in e.columns:
        action = F.when(F.coalesce(F.col("value").rlike(rf"\A\s*(?:{'|'.join(every)})\s*\z"), F.lit(False)), "ALLOW").otherwise(action)
    return e.withColumn("action", action)


def assessment(docs: DataFrame, e: DataFrame, unapplied: DataFrame, findings: DataFrame, reports: DataFrame) -> DataFrame:
    """(doc_id, inherent, residual, n_critical, n_high, n_medium, n_low) of every document.

    Inherent: the worst entity that is not allowed. Residual: the worst of the entities that are neither redacted nor
    allowed, of those that could not be applied (unapplied: doc_id, block_id, seq), and of the verifier's findings (doc_id,
    risk_level); a document without a report (doc_id, status), or with an uncertain one, counts as CRITICAL.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, RISKS)), F.col(c)) - 1
    rows = e.join(unapplied.select("doc_id", "block_id", "seq", F.lit(True).alias("_u")), ["doc_id", "block_id", "seq"], "left")
    open_ = F.coalesce(F.col("_u"), F.lit(False)) | ~F.coalesce(F.col("action").isin("REDACT", "ALLOW"), F.lit(False))
    count = lambda r: F.count_if(F.col("risk_level") == r).alias(f"n_{r.lower()}")
    own = rows.groupBy("doc_id").agg(F.max(F.when(F.col("action") != "ALLOW", rank("risk_level"))).alias("i"), F.max(F.when(open_, rank("risk_level"))).alias("o"), *map(count, RISKS[:0:-1]))
    left = findings.groupBy("doc_id").agg(F.max(rank("risk_level")).alias("f"))
    told = reports.select("doc_id", F.when(F.col("status") == "VERIFIER_UNCERTAIN", len(RISKS) - 1).otherwise(0).alias("v"))
    out = docs.select("doc_id").join(own, "doc_id", "left").join(left, "doc_id", "left").join(told, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    residual = F.greatest(zero("o"), zero("f"), F.coalesce("v", F.lit(len(RISKS) - 1)))
    return out.select("doc_id", risk_name(zero("i")).alias("inherent"), risk_name(residual).alias("residual"), *[zero(f"n_{r.lower()}").alias(f"n_{r.lower()}") for r in RISKS[:0:-1]])


# Fixed values, in natural order.
SENSITIVE_VERBS = ["transfer", "wire", "pay", "deposit", "earn", "owe", "spend", "remit", "invoice", "bill", "refund", "withdraw", "invest", "borrow", "loan", "transact", "purchase", "charge", "compensate", "reimburse", "terminate", "discipline", "fire", "suspend", "reprimand", "investigate", "accuse", "sanction", "demote", "penalize", "audit", "violate", "diagnose", "prescribe", "treat", "admit", "suffer", "contract", "infect", "reside", "live", "marry", "divorce", "arrest", "convict", "sue"]
PUBLIC_VERBS = ["write", "author", "publish", "compose", "direct", "paint", "sculpt", "create", "produce", "illustrate", "narrate", "invent", "discover", "formulate", "theorize", "pioneer", "prove", "establish", "hypothesize", "calculate", "postulate", "found", "coin", "originate"]
FINANCIAL = r"(?i)(?:\$|€|£|₹|USD|EUR|GBP|INR)\s*\d+(?:[.,]\d+)*(?:\s*(?:k|m|b|thousand|million|crore|lakh))?|\b\d+(?:[.,]\d+)*\s*(?:k|usd|eur|inr|dollars|rupees|pounds)\b|\b(?:\d+k)\b"
HEALTH = r"(?i)\b(?:diagnosed|prescription|medication|hospitalized|patient|disease|illness|treatment|clinic|therapy)\b"
PERSONNEL = r"(?i)\b(?:performance review|disciplinary action|termination|reprimand|probation|salary of|annual bonus|pip)\b"
DESCRIPTIVE = ["leader", "solutions", "advisory", "delivering", "founded in"]


def sensitivity(sentence: Column, value: Column, kind: Column, verb: Column) -> Column:
    """struct(sensitive, score): whether a sentence links its entity to something private.

    verb: the lemma of the verb that governs the entity, null where no parser told it. Entities but names are always
    sensitive; money, health or personnel words outweigh the verb; a public verb, or a company's description, clears.
    """
    s = lambda yes, score: F.struct(F.lit(yes).alias("sensitive"), F.lit(score).alias("score"))
    blank = (F.coalesce(sentence, F.lit("")) == "") | (F.coalesce(value, F.lit("")) == "")
    anchor = sentence.rlike(FINANCIAL) | sentence.rlike(HEALTH) | sentence.rlike(PERSONNEL)
    described = F.exists(F.array(*map(F.lit, DESCRIPTIVE)), lambda w: F.contains(F.lower(sentence), w)) & F.contains(F.lower(sentence), F.lower(value))
    return F.when(blank, s(True, 0.80)).when(~kind.isin("PERSON", "NAME"), s(True, 0.95)).when(anchor, s(True, 0.95)).when(verb.isin(SENSITIVE_VERBS), s(True, 0.90)).when(verb.isin(PUBLIC_VERBS), s(False, 0.10)).when(described, s(False, 0.15)).otherwise(s(True, 0.75))
