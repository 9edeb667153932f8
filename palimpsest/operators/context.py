"""The context layer: cues near a span, table headers, section headings, values behind cues."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import matches

# Fixed values, in natural order.
CUE_WORDS = {
    "SSN": ["ssn", "social security", "ss#", "ss no", "soc sec", "social security number", "social security no"],
    "DOB": ["dob", "date of birth", "born", "birth date", "birthday", "d.o.b", "d.o.b.", "date-of-birth"],
    "PAN": ["pan", "permanent account", "pan card", "pan no", "pan number", "income tax", "it returns"],
    "AADHAAR": ["aadhaar", "aadhar", "uid", "unique identification", "unique id", "aadhaar no", "aadhaar number"],
    "EMAIL": ["email", "e-mail", "mail", "email id", "email address", "contact email"],
    "PHONE": ["phone", "mobile", "tel", "telephone", "contact no", "cell", "landline", "ph no", "phone number", "mobile no"],
    "PASSPORT": ["passport", "passport no", "passport number", "travel document", "travel doc"],
    "EMPLOYEE_ID": ["employee id", "emp id", "staff no", "employee number", "emp no", "staff id", "employee code"],
    "CARD": ["card no", "card number", "credit card", "debit card", "card #", "visa", "mastercard"],
    "BANK_ACCOUNT": ["account no", "a/c", "bank account", "account number", "savings account", "current account", "acct no", "acct"],
    "IFSC": ["ifsc", "branch code", "neft", "rtgs", "bank code"],
    "GST": ["gst", "gstin", "goods and services tax", "gst no", "gst number", "tax invoice"],
    "UPI": ["upi", "vpa", "upi id", "upi address", "pay to"],
    "NINO": ["nino", "national insurance", "ni number", "ni no"],
    "TAX_ID": ["tin", "tax id", "tax identification", "ein", "employer identification"],
    "PESEL": ["pesel", "polish national id", "national id", "polish id"],
    "PERSON": ["name", "employee name", "full name", "first name", "last name", "applicant", "candidate", "holder name", "qa reviewer", "reviewer", "approver"],
}
SECTIONS = {
    "personal information": 0.20, "employee personal information": 0.25, "employee details": 0.20, "personal details": 0.20, "contact information": 0.15, "contact details": 0.15,
    "identification": 0.15, "identity verification": 0.20, "know your customer": 0.20, "kyc": 0.20, "kyc details": 0.20, "bank details": 0.15, "financial information": 0.15,
    "tax information": 0.15, "passport details": 0.20, "travel document details": 0.20, "emergency contact": 0.15, "next of kin": 0.15, "dependent information": 0.15,
    "nominee details": 0.15, "director information": 0.15, "board of directors": 0.15, "key personnel": 0.15,
}


def _literal(word: str) -> str:
    return r"\Q" + word + r"\E"


def cue_boost(e: DataFrame, cues: dict[str, list[str]] = CUE_WORDS, window: int = 80) -> DataFrame:
    """Entities (.., text, entity_type, confidence, text_start, text_end) with context_cues and the confidence they add.

    A cue of the entity's type within `window` characters on either side, the entity itself included, adds 0.08, all
    together at most 0.20; the sum stays within 1. A type without cues, and a null text, change nothing.
    """
    start = F.greatest(F.lit(0), F.col("text_start") - window)
    around = F.lower(F.substring("text", start + 1, F.col("text_end") + window - start))
    own = F.create_map(*[x for k, v in cues.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("entity_type")]
    found = F.coalesce(F.filter(own, lambda c: F.contains(around, c)), F.array().cast("array<string>"))
    return e.withColumn("context_cues", found).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + F.least(F.lit(0.20), 0.08 * F.size("context_cues"))))


def section_boost(heading: Column, sections: dict[str, float] = SECTIONS) -> Column:
    """What a section heading adds: the exact trigger's, else that of the first trigger in or around it, else 0."""
    h = F.lower(F.trim(heading))
    out = F.create_map(*[F.lit(x) for p in sections.items() for x in p])[h]
    near = F.lit(0.0)
    for trigger, boost in reversed(sections.items()):
        near = F.when(F.contains(h, F.lit(trigger)) | F.contains(F.lit(trigger), h), boost).otherwise(near)
    return F.coalesce(out, near)


def _behind(text: Column, kind: str, words: list[str]) -> Column:
    cue = r"(?iU)\b(?:" + "|".join(map(_literal, sorted(words, key=lambda w: (-len(w), w)))) + r")\b\s*[:=\-]?\s*(?:is\s+)?"

    def one(m: Column) -> Column:
        raw = F.regexp_extract(m["v"], cue + r"(\S+)$", 1)
        value = F.regexp_replace(raw, r"[.,;:]+$", "")
        start = m["e"] - F.length(raw)
        return F.struct(F.lit(kind).alias("entity_type"), value.alias("value"), start.alias("text_start"), (start + F.length(value)).alias("text_end"), F.lit(0.50).alias("confidence"))

    return F.transform(matches(text, cue + r"\S+"), one)


def cue_values(blocks: DataFrame, cues: dict[str, list[str]]) -> DataFrame:
    """Single-token values behind a cue (`cue: value`, `cue is value`): block keys, entity_type, value, offsets, 0.50.

    The value's end is the match's, less trailing punctuation; one projection over the blocks, without a shuffle.
    """
    parts = [_behind(F.col("text"), kind, words) for kind, words in cues.items()]
    rows = blocks.withColumn("_c", F.explode(F.flatten(F.array(*parts)))).select(*[c for c in blocks.columns if c != "text"], "_c.*")
    return rows.where("value <> '' and value rlike '[0-9]'")
