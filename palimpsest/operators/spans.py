"""Native span scans: regular expressions to rows (start, end, value), with allow-lists and context gates."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ALLOWED, CUES, PATTERNS, SIGNS, TABLE_HEADERS


def java(pattern: str, any_case: bool) -> str:
    return ("(?iuU)" if any_case else "(?U)") + pattern


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<s, e, v>> of the leftmost matches: the pieces between them give their offsets."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, 0), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["q"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    pairs = F.filter(F.arrays_zip(between.alias("q"), found.alias("m")), lambda x: x["m"].isNotNull())
    return F.when(F.rlike(text, pattern), F.aggregate(pairs, empty, step)["out"]).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One block for each line that is not blank: (doc_id, block_id, seq, text); the id keeps the line's number."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("seq", "text"))
    return lines.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", F.concat(F.lit("p1_block_"), F.col("seq")).alias("block_id"), "seq", "text")


def scan(blocks: DataFrame, patterns=PATTERNS, allow=ALLOWED, headers=TABLE_HEADERS, window: int = 80, keep_text: bool = False) -> DataFrame:
    """All catalog matches: keys, entity_type, variant, confidence, text_start, text_end, value; with keep_text the block's text too.

    Blank texts and texts that are a table header give none. A match that overlaps an allow-listed span is dropped.
    A pattern that needs context keeps a match only if a cue of its type stands in the `window` characters before it.
    One projection over the blocks, no shuffle. A pattern with a sign (SIGNS) is searched only in texts that hold it, and
    texts without a sign of any pattern are left out first; another costs one failed search where it does not occur. The
    allow-list is looked at only where something was found.
    """
    text = F.col("text")
    signs = sorted({SIGNS.get(p[2], "") for p in patterns})
    rows = blocks.where(text.rlike(r"(?U)\S")) if "" in signs else blocks.where(reduce(or_, [text.rlike(s) for s in signs]))
    rows = rows.where(~F.lower(F.trim(text)).isin(headers or [""]))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    each = []
    for kind, variant, pattern, confidence, context, any_case in patterns:
        there = matches(text, java(pattern, any_case))
        if pattern in SIGNS and len(signs) > 1:  # with one sign all texts that are left hold it
            there = F.when(text.rlike(SIGNS[pattern]), there).otherwise(none)
        found = F.transform(there, lambda m: F.struct(
            F.lit(kind).alias("entity_type"), F.lit(variant).alias("variant"), F.lit(confidence).alias("confidence"), F.lit(context).alias("context"),
            m["s"].alias("text_start"), m["e"].alias("text_end"), m["v"].alias("value")))
        each.append(found)
    rows = rows.withColumn("_m", F.explode(F.flatten(F.array(*each))))
    if allow:
        allowed = F.flatten(F.array(*[matches(text, java(p, True)) for p in allow]))
        rows = rows.where(~F.exists(allowed, lambda a: (F.col("_m.text_start") < a["e"]) & (F.col("_m.text_end") > a["s"])))
    if any(p[4] for p in patterns):
        start = F.greatest(F.lit(0), F.col("_m.text_start") - window)
        before = F.lower(F.substring(text, start + 1, F.col("_m.text_start") - start))
        cues = F.create_map(*[x for k, v in CUES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        own = F.coalesce(cues[F.col("_m.entity_type")], F.array().cast("array<string>"))
        rows = rows.where(~F.col("_m.context") | F.exists(own, lambda c: F.contains(before, c)))
    return rows.select(*[c for c in blocks.columns if keep_text or c != "text"], "_m.entity_type", "_m.variant", "_m.confidence", "_m.text_start", "_m.text_end", "_m.value")
