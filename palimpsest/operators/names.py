"""Names and identifiers found by pattern alone, names over several lines, and the filters on what a name model found."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import java, matches

#: Type, variant, pattern, confidence; all in any case.
RECOGNISERS = [
    ("PAN", "pan_strict", r"\b[A-Z]{3}[PCHATBLJFG][A-Z]\d{4}[A-Z]\b", 0.85),
    ("PAN", "pan_relaxed", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.60),
    ("AADHAAR", "aadhaar_spaced", r"\b[2-9]\d{3}\s\d{4}\s\d{4}\b", 0.85),
    ("AADHAAR", "aadhaar_dashed", r"\b[2-9]\d{3}-\d{4}-\d{4}\b", 0.85),
    ("PASSPORT", "in_passport", r"\b[A-Z][0-9]{7}\b", 0.50),
    ("NINO", "nino", r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 0.85),
    ("EMPLOYEE_ID", "emp_id", r"\bEMP[-\s]?\d{4,8}\b", 0.80),
    ("IFSC", "ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.80),
    ("GST", "gstin", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z0-9]\b", 0.90),
    ("PESEL", "pesel_pattern", r"\b(?:PESEL\s*:?\s*)?(\d{11}|\d{6}[xX]{5})\b", 0.90),
]

#: Rule, pattern, confidence.
NAMES = [
    ("initials", r"\b[A-Z]{1,2}\.?\s+[A-Z][a-z]+(?:-[A-Z][a-z]+)?\b", 0.88),
    ("composite", r"\b[A-Z][a-z]+\s+[A-Z]\.?\s+[A-Z][a-z]+(?:-[A-Z][a-z]+)?\b", 0.90),
    ("composite", r"\b[A-Z][a-z]+-[A-Z][a-z]+\s+[A-Z][a-z]+(?:-[A-Z][a-z]+)?\b", 0.90),
    ("composite", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+-[A-Z][a-z]+\b", 0.90),
]

#: Words before initials that make them a reference to a part of a text.
PARTS = r"(?i)(?:appendix|section|clause|table|exhibit|schedule|figure)\s*$"

#: What follows a company's name; words in labels that are no names; an e-mail address.
FIRM = ["is the", "delivering", "advisory", "solutions", "partner", "technologies", "services", "inc", "llc", "corp", "group", "platform", "software"]
LABELS = ["workflow", "security", "tier", "template", "rule", "trigger", "condition", "reviewer"]
MAIL = r"(?U)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
REGIONS = ["ai", "us", "uk", "eu", "apac", "emea", "na", "sa"]

#: Characters without meaning at the ends of a value.
EDGES = r" \t\r\n\-.,;:_~#*()\[\]{}|/\\"

_SPAN = "array<struct<rule:string,entity_type:string,confidence:double,s:int,e:int,v:string>>"


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{EDGES}]+|[{EDGES}]+$", "")


def _unit(lower: Column, suffixes) -> Column:
    """Whether one of the words that name a part of an organisation stands in the value."""
    return lower.rlike(r"(?U)\b(?:" + "|".join(suffixes) + r")\b") if suffixes else F.lit(False)


def _out(blocks: DataFrame, found: Column) -> DataFrame:
    rows = blocks.withColumn("_x", F.explode(found))
    keys = [c for c in blocks.columns if c not in ("text", "_taken")]
    return rows.select(*keys, "_x.entity_type", F.col("_x.rule").alias("variant"), "_x.confidence", F.col("_x.s").alias("text_start"), F.col("_x.e").alias("text_end"), F.col("_x.v").alias("value"))


def _found(text: Column, kind: str, rule: str, pattern: str, confidence: float, any_case: bool) -> Column:
    return F.transform(matches(text, java(pattern, any_case)), lambda m: F.struct(
        F.lit(rule).alias("rule"), F.lit(kind).alias("entity_type"), F.lit(confidence).alias("confidence"), m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v")))


def recognise(blocks: DataFrame) -> DataFrame:
    """Identifiers by the recognisers' patterns: keys, entity_type, variant, confidence, text_start, text_end, value.

    Of two spans of one type, one inside the other, that of less confidence goes. One projection, no shuffle. Null and
    blank texts give none.
    """
    text = F.col("text")
    every = F.flatten(F.array(*[_found(text, kind, rule, p, c, True) for kind, rule, p, c in RECOGNISERS]))
    rows = blocks.where(text.rlike(r"(?U)\S")).withColumn("_all", every)
    inside = lambda x, y: (x["entity_type"] == y["entity_type"]) & (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["confidence"] > x["confidence"])
    rows = rows.withColumn("_x", F.explode(F.filter("_all", lambda x: ~F.exists("_all", lambda y: inside(x, y)))))
    return _out(rows.drop("_all").withColumnRenamed("_x", "_y"), F.array("_y")).drop("_y")


def find_names(blocks: DataFrame, entities: DataFrame | None = None, excluded=(), phrases=(), suffixes=(), templates=(), keys=("doc_id", "block_id")) -> DataFrame:
    """Persons by initials and by composite names that no earlier entity covers.

    excluded: words and names that are no persons, whole or as one of the words; phrases: whole composite names that are
    none (tools, countries); suffixes: words for parts of organisations; templates: patterns of labels. All lower-case
    but the patterns. Initials behind "Appendix", "Section" and the like are no names. entities (keys, entity_type,
    text_start, text_end) are what was found before: initials inside any of them go, composite names inside a PERSON go,
    and both go if they begin inside an ORGANIZATION. A name inside one found by an earlier pattern goes. Entities are
    joined by block, so their number in one task is that of a block. Null and blank texts give none.
    """
    text = F.col("text")
    rows = blocks.where(text.rlike(r"(?U)\S"))
    none = F.array().cast("array<struct<entity_type:string,s:int,e:int>>")
    if entities is None:
        rows = rows.withColumn("_taken", none)
    else:
        own = F.struct("entity_type", F.col("text_start").cast("int").alias("s"), F.col("text_end").cast("int").alias("e"))
        rows = rows.join(entities.groupBy(*keys).agg(F.collect_list(own).alias("_taken")), list(keys), "left").withColumn("_taken", F.coalesce("_taken", none))

    def passes(rule: str):
        def test(m: Column) -> Column:
            lower = F.lower(m["v"])
            words = F.transform(F.split(lower, r"(?U)\s+"), lambda w: F.regexp_replace(w, "^[.,-]+|[.,-]+$", ""))
            wrong = lower.isin([*excluded]) | F.exists(words, lambda w: w.isin([*excluded])) | _unit(lower, suffixes)
            for p in templates:
                wrong = wrong | m["v"].rlike("(?U)" + p)
            if rule == "initials":
                wrong = wrong | F.substring(text, F.lit(1), m["s"]).rlike("(?U)" + PARTS)
            else:
                wrong = wrong | lower.isin([*phrases])
            return ~wrong & ~F.exists("_taken", lambda t: (t["entity_type"] == "ORGANIZATION") & (t["s"] <= m["s"]) & (m["s"] < t["e"]))

        return test

    each = [F.filter(_found(text, "PERSON", rule, p, c, False), passes(rule)) for rule, p, c in NAMES]

    def step(kept: Column, m: Column) -> Column:
        covers = lambda t: (t["s"] <= m["s"]) & (m["e"] <= t["e"])
        old = F.exists("_taken", lambda t: covers(t) & ((m["rule"] == "initials") | (t["entity_type"] == "PERSON")))
        return F.when(old | F.exists(kept, covers), kept).otherwise(F.concat(kept, F.array(m)))

    return _out(rows, F.aggregate(F.flatten(F.array(*each)), F.array().cast(_SPAN), step))


def split_lines(entities: DataFrame) -> DataFrame:
    """Persons (.., text, entity_type, value, text_start, text_end) over several lines become one entity a line.

    A line begins where its text first stands at or behind the entity's start. Lines without two letters go. Other rows stay.
    """
    many = (F.col("entity_type") == "PERSON") & F.contains("value", F.lit("\n"))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.regexp_count(x, F.lit(r"\p{L}")) >= 2)
    rows = entities.withColumn("_line", F.explode(F.when(many, lines).otherwise(F.array("value"))))
    at = F.position("_line", "text", F.col("text_start") + 1) - 1
    start = F.when(many & (at >= 0), at).otherwise(F.col("text_start"))
    rows = rows.withColumn("_start", start).withColumn("_end", F.when(many, F.col("_start") + F.length("_line")).otherwise(F.col("text_end")))
    new = {"value": "_line", "text_start": "_start", "text_end": "_end"}
    return rows.select(*[F.col(new.get(c, c)).cast(entities.schema[c].dataType).alias(c) for c in entities.columns])


def plausible(entities: DataFrame, excluded=(), suffixes=(), prefixes=()) -> DataFrame:
    """Entities (.., text, entity_type, value, confidence, text_end) without those that can't be what their type says.

    excluded, suffixes: as in find_names, excluded for whole values, "the " before them aside; prefixes: of codes. Null
    values go. One projection, no shuffle.
    """
    v = _stripped(F.col("value"))
    lower = F.lower(v)
    bare = F.when(F.startswith(lower, F.lit("the ")), F.trim(F.substring(lower, 5, 1 << 30))).otherwise(lower)
    known = lower.isin([*excluded]) | bare.isin([*excluded])
    code = F.contains(v, F.lit("_"))
    for p in prefixes:
        code = code | F.startswith(v, F.lit(p))
    single = ~v.rlike(r"(?U)\s")
    digit = v.rlike(r"(?U)\d")
    after = F.lower(F.substring("text", F.col("text_end") + 1, F.lit(50)))
    any_of = lambda where, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(where, w))
    short = (v == F.upper(v)) & (F.lower(v) != v) & (F.length(v) <= 4)
    firm = single & (F.col("confidence") < 0.88) & any_of(F.coalesce(after, F.lit("")), FIRM)
    person = v.rlike(r"(?U)^\d+$") | short | (F.regexp_count(v, F.lit(r"\p{L}")) < 2) | known | _unit(lower, suffixes) | code | any_of(lower, LABELS) | firm
    address = known | code | (single & ~digit) | lower.isin(REGIONS) | (F.length(v) <= 2)
    kind = F.col("entity_type")
    wrong = (
        F.when((F.length(v) < 2) | lower.isin([*excluded]), True)
        .when(kind == "PERSON", person).when(kind == "ADDRESS", address).when(kind == "EMAIL", ~v.rlike(MAIL))
        .when(kind == "DOB", (F.length(v) > 35) | ~digit).when(kind == "EMPLOYEE_ID", (F.length(v) < 4) | v.rlike(r"(?iU)^v\d+(\.\d+)?$"))
        .otherwise(v.isNull())
    )
    return entities.where(~F.coalesce(wrong, F.lit(True)))
