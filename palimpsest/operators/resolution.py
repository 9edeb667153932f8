"""From raw entities to final ones: resolution, cleaning, names carried through a document, summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import RESOLVER_ALLOWED, TABLE_HEADERS
from .entities import components, dedupe, merge, risk_name, risk_rank
from .spans import matches

# Fixed values, in natural order.
OUTCOMES = ["approved", "rejected", "pending", "conditional", "submitted", "result"]
LEGAL_TERMS = ["contract", "agreement", "policy", "form", "contract submission form", "contract creation", "intake form", "amendment"]
JURISDICTIONS = ["united states", "the united states", "u.s.", "u.s.a.", "usa", "uk", "canada", "united kingdom", "us", "eu", "apac", "emea", "na", "sa"]
UNITS = ["group", "team", "committee", "board", "department", "division", "council", "office"]
ADDRESS_WORDS = ["street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "boulevard", "blvd", "drive", "dr", "court", "ct", "crescent", "cres", "way", "suite", "ste", "apt", "apartment", "building", "floor", "box", "p.o.", "po box"]
ADDRESS_STARTS = ["used", "using", "use", "emerging", "a documented", "documented", "high", "medium", "low", "for", "to", "with"]
ROLES = ["launch", "admin", "custom", "template", "templates", "trigger", "condition", "email", "description", "annual", "chief", "executive", "officer", "senior", "director", "president", "vice president", "manager", "lead", "status", "assessment", "evaluation", "employee", "outcome", "result"]
TEMPLATE = r"(?iU)\b(?:Due\s+Diligence\s+)?Questionnaire\b|\bAppendix\s+[A-Z]\.?\b|\bT[1-3]\s+v\d+\b"
EDGE = r"[ \t\r\n\-.,;:_~#*()\[\]{}|/\\]+"


def trimmed(v: Column) -> Column:
    """Without the marks at either end that belong to no value."""
    return F.regexp_replace(v, rf"\A{EDGE}|{EDGE}\z", "")


def _words(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?iU)\b(?:" + "|".join(rf"\Q{w}\E" for w in words) + r")\b")


def allowed(value: Column) -> Column:
    """Whether resolution drops a value: a whole business code, also in brackets or quotes, or a table header."""
    v = F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")
    bare = F.regexp_replace(v, r"""\A[()\[\]"']+|[()\[\]"']+\z""", "")
    whole = rf"(?iU)\A(?:{'|'.join(RESOLVER_ALLOWED)})\z"
    return v.rlike(whole) | bare.rlike(whole) | F.lower(v).isin(TABLE_HEADERS)


def resolve(e: DataFrame) -> DataFrame:
    """Overlapping entities of a block merged, equal ones made one, allow-listed values dropped; seq is the first member's.

    Only blocks of two or more entities go through the union of overlaps; an entity alone in its block stays as it is.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "block_id"))
    columns = ["doc_id", "block_id", "seq", "entity_type", "value", "text_start", "text_end", "confidence", "detection_layers"]
    rows = e.select(*columns).withColumn("_n", n)
    alone = rows.where("_n = 1").select(*columns)
    several = merge(components(rows.where("_n > 1").select(*columns))).withColumnRenamed("component", "seq").select(*columns)
    return alone.unionByName(several).where(~F.coalesce(allowed(F.col("value")), F.lit(False)))


def clean(e: DataFrame, terms: list[str] = (), tools: list[str] = ()) -> DataFrame:
    """Drops what cannot be of its type; terms: the caller's vocabulary of words that are no personal data, tools: of products."""
    v = trimmed(F.col("value"))
    low = F.lower(v)
    bare = F.when(F.startswith(low, F.lit("the ")), F.trim(F.substring(low, 5, 1 << 30))).otherwise(low)
    listed = lambda words: low.isin(words) | bare.isin(words) if words else F.lit(False)
    kind = F.col("entity_type")
    digit = v.rlike("(?U)\\d")
    address = (digit | _words(v, ADDRESS_WORDS)) & ~v.rlike(rf"(?i)\A(?:{'|'.join(ADDRESS_STARTS)})\b") & ~listed([*OUTCOMES, *LEGAL_TERMS, *JURISDICTIONS, *tools]) & ~_words(low, UNITS)
    person = ~listed([*OUTCOMES, *ROLES]) & ~v.rlike(TEMPLATE) & ~_words(low, UNITS)
    fits = (
        F.when(kind == "EMAIL", v.rlike(r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b")).when(kind == "DOB", digit)
        .when(kind == "EMPLOYEE_ID", (F.length(v) >= 4) & ~v.rlike(r"(?i)\Av[0-9]+(\.[0-9]+)?\z")).when(kind == "AADHAAR", F.length(F.regexp_replace(v, "[^0-9]", "")) == 12)
        .when(kind == "ADDRESS", address).when(kind == "PERSON", person).otherwise(F.lit(True))
    )
    return e.where(F.coalesce((F.length(v) >= 2) & ~listed(list(terms)) & fits, F.lit(False)))


def confirmed_names(e: DataFrame, terms: list[str] = (), least: float = 0.60) -> DataFrame:
    """(doc_id, name): the full names among the PERSON entities, a line each: two tokens or more, each capitalised."""
    lines = e.where((F.col("entity_type") == "PERSON") & (F.col("confidence") >= least)).select("doc_id", F.explode(F.split(trimmed(F.col("value")), "\n")).alias("line"))
    name = trimmed(F.col("line"))
    lines = lines.select("doc_id", name.alias("name")).where("length(name) >= 3")
    tokens = F.transform(F.split("name", r"(?U)\s+"), lambda t: F.regexp_replace(t, r"\A[.,;:()]+|[.,;:()]+\z", ""))
    vocabulary = [*terms, *ROLES]
    proper = F.forall(tokens, lambda t: (F.length(t) >= 2) & t.rlike(r"\A\p{Lu}") & ~F.lower(t).isin(vocabulary))
    low = F.lower("name")
    return lines.where((F.size(tokens) >= 2) & proper & ~low.isin([*vocabulary, *OUTCOMES]) & ~_words(low, UNITS) & ~F.col("name").rlike(TEMPLATE)).distinct()


def occurrences(blocks: DataFrame, phrases: DataFrame, on: list[str], kind: str, confidence: float, layer: str) -> DataFrame:
    """Whole-word occurrences, in any case, of (.., name) in the blocks that agree on the columns `on`.

    With `on`, a key's phrases travel together, so a block is shuffled once at most, not once for each of its words.
    Without it, the blocks' words are joined with the phrases' first words: a dictionary, which Spark sends to all tasks
    while it is small; a larger one shuffles a block for each of its words. No block meets a phrase whose first word it
    lacks; a plain substring test comes before the search for places. Phrases without a word are in no block.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)
    held = lambda name: F.contains(F.lower("text"), F.lower(name))
    first = phrases.withColumn("_w", F.get(words("name"), F.lit(0))).where("_w is not null").distinct()
    if on:
        lists = first.groupBy(*on).agg(F.collect_list(F.struct("_w", "name")).alias("_p"))
        rows = blocks.join(lists, on).withColumn("_p", F.filter("_p", lambda p: held(p["name"]))).where("size(_p) > 0").withColumn("_all", words("text"))
        near = rows.withColumn("_p", F.explode(F.filter("_p", lambda p: F.array_contains("_all", p["_w"])))).withColumn("name", F.col("_p.name"))
    else:
        near = blocks.withColumn("_w", F.explode(F.array_distinct(words("text")))).join(first, "_w").where(held(F.col("name")))
    pattern = F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), F.col("name"), F.lit(r"\E(?!\w)"))
    found = near.withColumn("_m", F.explode(matches(F.col("text"), pattern)))
    return found.select("doc_id", "block_id", F.lit(kind).alias("entity_type"), F.col("_m.v").alias("value"), F.col("_m.s").alias("text_start"), F.col("_m.e").alias("text_end"), F.lit(confidence).alias("confidence"), F.array(F.lit(layer)).alias("detection_layers"), "name")


def propagate(blocks: DataFrame, e: DataFrame, terms: list[str] = ()) -> DataFrame:
    """A document's confirmed names found again in all its blocks where no entity covers them, then resolved anew.

    A document without a confirmed name stays as it is. New entities are numbered after the block's others.
    """
    names = confirmed_names(e, terms)
    new = occurrences(blocks.select("doc_id", "block_id", "text"), names, ["doc_id"], "PERSON", 0.92, "context").drop("name").distinct()
    old = e.select(F.col("doc_id").alias("d"), F.col("block_id").alias("b"), F.col("text_start").alias("s"), F.col("text_end").alias("t"))
    new = new.join(old, (F.col("doc_id") == F.col("d")) & (F.col("block_id") == F.col("b")) & (F.col("s") <= F.col("text_start")) & (F.col("text_end") <= F.col("t")), "left_anti")
    new = new.withColumn("seq", (F.lit(1 << 30) + F.col("text_start")).cast("int"))
    named = names.select("doc_id").distinct()
    columns = ["doc_id", "block_id", "seq", "entity_type", "value", "text_start", "text_end", "confidence", "detection_layers"]
    again = e.select(*columns).join(named, "doc_id", "left_semi").unionByName(new.select(*columns))
    return e.select(*columns).join(named, "doc_id", "left_anti").unionByName(resolve(again))


def summary(docs: DataFrame, e: DataFrame) -> DataFrame:
    """(doc_id, n_entities, n_blocks, types, risks, unresolved_critical) of every document; types and risks: `name=count`, sorted.

    unresolved_critical: a CRITICAL entity under 0.80 that is not allowed.
    """
    action = F.col("action") if "action" in e.columns else F.lit("REDACT")
    risk = F.col("risk_level") if "risk_level" in e.columns else risk_name(risk_rank(F.col("entity_type")))
    rows = e.withColumn("_risk", risk).withColumn("_open", (F.col("_risk") == "CRITICAL") & (F.col("confidence") < 0.80) & (action != "ALLOW"))
    text = lambda c: F.array_join(F.array_sort(F.collect_list(F.concat(c, F.lit("="), "n"))), ",")
    count = lambda key, name: rows.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(text(key).alias(name))
    whole = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"), F.countDistinct("block_id").alias("n_blocks"), F.bool_or("_open").alias("unresolved_critical"))
    out = docs.select("doc_id").join(whole, "doc_id", "left").join(count("entity_type", "types"), "doc_id", "left").join(count("_risk", "risks"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", zero("n_entities"), zero("n_blocks"), F.coalesce("types", F.lit("")).alias("types"), F.coalesce("risks", F.lit("")).alias("risks"), F.coalesce("unresolved_critical", F.lit(False)).alias("unresolved_critical"))
