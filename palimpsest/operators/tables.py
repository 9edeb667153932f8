"""Tables as blocks: flattening with headers, Markdown, and what a column's header says of its cells."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolution import TEMPLATE, UNITS, _words, trimmed

# Fixed values, in natural order: headers and the type of their cells; the first that fits decides.
HEADERS = [
    ("PERSON", ["employee name", "full name", "person name", "contact name", "applicant", "candidate", "staff name", "first name", "last name", "holder name", "name", "users", "user", "author", "author(s)", "authors", "reviewer", "peer reviewer", "qa reviewer", "client contact", "contact", "owner", "approver", "contributor", "attendee", "attendees", "stakeholder", "prepared by", "reviewed by", "approved by"]),
    ("SSN", ["ssn", "social security", "social security number"]),
    ("EMAIL", ["email", "email address", "e-mail"]),
    ("PHONE", ["phone", "phone number", "mobile", "mobile number", "telephone", "tel"]),
    ("DOB", ["dob", "date of birth", "birth date"]),
    ("ADDRESS", ["address", "home address", "residential address"]),
    ("EMPLOYEE_ID", ["employee id", "emp id", "staff no", "staff id", "employee number"]),
    ("PAN", ["pan", "pan number", "pan no"]),
    ("AADHAAR", ["aadhaar", "aadhaar no", "aadhaar number", "uid"]),
    ("PASSPORT", ["passport", "passport no", "passport number"]),
    ("PESEL", ["pesel"]),
    ("CARD", ["card number", "credit card", "debit card"]),
    ("BANK_ACCOUNT", ["account number", "account no", "bank account", "a/c no"]),
    ("DIRECTOR_ID", ["din", "director id"]),
    ("IFSC", ["ifsc", "ifsc code"]),
    ("GST", ["gst", "gstin", "gst number"]),
    ("UPI", ["upi", "upi id", "vpa"]),
    ("NINO", ["nino", "national insurance"]),
    ("TAX_ID", ["tax id", "tin"]),
]
#: A header that holds one of these names no persons.
SYSTEM_WORDS = ["workflow", "workflows", "sla", "stage", "task", "questionnaire", "file", "report", "question", "step", "role", "service", "system", "rule", "code", "status", "version", "category", "type", "description", "module", "field", "user groups", "group", "tier", "security", "risk", "control", "attribute", "trigger", "condition", "action", "template", "object", "logic", "name", "collaborator", "collaborators", "assignee", "scoring", "score", "timeline", "timelines"]
PLACEHOLDERS = ["n/a", "na", "none", "null", "tbd", "yes", "no", "true", "false", "-", "--", "."]


def flatten(tables: DataFrame) -> DataFrame:
    """Cells as blocks: (doc_id, block_id, seq, text, header_name, row_index, col_index), the header's cells as row -1.

    tables: doc_id, table_id, headers (array), rows (array of arrays). A column without a header is called Column_n, from
    1; a table of two columns whose header is empty takes a row's label, its first cell, for the header of the other.
    Blank cells are left out.
    """
    width = F.greatest(F.size(F.coalesce("headers", F.array().cast("array<string>"))), F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0)))
    rows = tables.withColumn("headers", F.coalesce("headers", F.array().cast("array<string>"))).withColumn("_w", width)
    headed = F.exists("headers", lambda h: F.trim(h) != "")
    titles = rows.where(headed).select("doc_id", "table_id", F.lit(-1).alias("row_index"), F.posexplode("headers").alias("col_index", "text"), F.lit(None).cast("string").alias("header_name"))
    cells = rows.withColumn("_h", headed).select("doc_id", "table_id", "headers", "_w", "_h", F.posexplode("rows").alias("row_index", "r"))
    cells = cells.select("*", F.posexplode("r").alias("col_index", "text"))
    own = F.get("headers", F.col("col_index"))
    label = F.when(~F.col("_h") & (F.col("_w") == 2) & (F.col("col_index") == 1) & (F.trim(F.get("r", F.lit(0))) != ""), F.get("r", F.lit(0)))
    header = F.coalesce(F.when(F.trim(own) != "", own), label, F.concat(F.lit("Column_"), F.col("col_index") + 1))
    cells = cells.select("doc_id", "table_id", "row_index", "col_index", "text", header.alias("header_name"))
    out = titles.unionByName(cells).where(F.col("text").rlike(r"(?U)\S"))
    seq = (F.col("row_index") + 1) * 10_000 + F.col("col_index")
    return out.select("doc_id", F.concat_ws("_", F.col("table_id"), F.concat(F.lit("r"), "row_index"), F.concat(F.lit("c"), "col_index")).alias("block_id"), seq.alias("seq"), "text", "header_name", "row_index", "col_index")


def markdown(headers: Column, rows: Column) -> Column:
    """A Markdown table: a header line, a rule, a line for each row; empty without headers."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda h: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(headers) > 0, F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")).otherwise("")


def header_type(header: Column) -> Column:
    """The type that a header gives its cells: the same name, else the first name in the header or, from four letters, around it."""
    h = F.lower(F.trim(header))
    system = F.exists(F.array(*map(F.lit, SYSTEM_WORDS)), lambda w: F.contains(h, w))
    exact, near = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, names in reversed(HEADERS):
        exact = F.when(h.isin(names), kind).otherwise(exact)
        hit = F.exists(F.array(*map(F.lit, names)), lambda k: F.contains(h, k) | ((F.length(h) >= 4) & F.contains(k, h)))
        near = F.when(hit & ~system if kind == "PERSON" else hit, kind).otherwise(near)
    found = F.coalesce(exact, near)
    return F.when((F.length(h) >= 2) & ~((found == "PERSON") & system), found)


def header_entities(cells: DataFrame, terms: list[str] = ()) -> DataFrame:
    """Entities that a cell's header tells (doc_id, block_id, entity_type, value, offsets, confidence, context_cues).

    cells: doc_id, block_id, text, header_name. PERSON cells fall apart at line ends, commas and semicolons, 0.85 each; other
    cells are one entity of 0.70. Placeholders, marks, e-mail cells without an address, and names that are numbers, units
    or templates give none.
    """
    cell = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    kind = header_type(F.col("header_name"))
    rows = cells.withColumn("_c", cell).withColumn("_k", kind).where("_k is not null")
    bare = F.lower(trimmed(F.col("_c")))
    rows = rows.where((F.length(bare) >= 2) & ~bare.isin(PLACEHOLDERS) & ((F.col("_k") != "EMAIL") | F.col("_c").rlike(r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b")))
    cue = F.array(F.concat(F.lit("table_header:"), F.trim("header_name")))
    whole = rows.where((F.col("_k") != "PERSON") & (~bare.isin(list(terms)) if terms else F.lit(True)))
    whole = whole.select("doc_id", "block_id", F.col("_k").alias("entity_type"), F.col("_c").alias("value"), F.lit(0).alias("text_start"), F.length("_c").alias("text_end"), F.lit(0.70).alias("confidence"), cue.alias("context_cues"))
    part = rows.where("_k = 'PERSON'").withColumn("_p", F.explode(F.split("_c", r"[\n,;]+"))).withColumn("_p", F.regexp_replace("_p", r"(?U)\A\s+|\s+\z", ""))
    name = trimmed(F.col("_p"))
    letters = F.length(F.regexp_replace(name, r"\P{L}", ""))
    ok = F.length(name).between(2, 50) & (letters >= 2) & ~_words(name, UNITS) & ~name.rlike(TEMPLATE)
    ok = ok & ~F.lower(name).isin(list(terms)) if terms else ok
    at = F.greatest(F.instr("text", F.col("_p")) - 1, F.lit(0))
    part = part.where(ok).select("doc_id", "block_id", F.lit("PERSON").alias("entity_type"), F.col("_p").alias("value"), at.alias("text_start"), (at + F.length("_p")).alias("text_end"), F.lit(0.85).alias("confidence"), cue.alias("context_cues"))
    return whole.unionByName(part)
