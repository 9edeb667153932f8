"""Redaction of whole documents, by spans, by values, and as maps for file writers."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import _to_redact, redact

#: Tokens that a rewrite leaves alone.
TOKEN = r"\[REDACTED[^\]]*\]|\[[A-Z_]+_\d+\]"


def documents(blocks: DataFrame, e: DataFrame, mode: str = "token") -> DataFrame:
    """(doc_id, text): the redacted blocks of each document in order of seq, joined by blank lines."""
    order = blocks.select("doc_id", "block_id", "seq")
    rows = redact(blocks, e, mode).join(order, ["doc_id", "block_id"])
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "block_id", "text"))).alias("b"))
    return g.select("doc_id", F.array_join(F.transform("b", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("text"))


def orphans(blocks: DataFrame, e: DataFrame) -> DataFrame:
    """The entities, not allowed, whose block is not there: none of them can be applied."""
    wanted = e.where("coalesce(action, '') <> 'ALLOW'") if "action" in e.columns else e
    return wanted.join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")


def replacements(blocks: DataFrame, e: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """({target: token} rows (doc_id, target, token), skipped (doc_id, block_id, seq)) for a writer that replaces text.

    Targets of fewer than `least` characters, which would hit other words, and spans outside their block are skipped; of
    entities with the same target the last, in order of seq, gives the token.
    """
    rows = _to_redact(blocks, e).join(blocks.select("doc_id", "block_id", "text"), ["doc_id", "block_id"], "left")
    target = F.when(F.col("fits"), F.substring(F.col("text"), F.col("text_start") + 1, F.col("text_end") - F.col("text_start")))
    rows = rows.withColumn("target", target).withColumn("_ok", F.coalesce(F.length(F.regexp_replace("target", r"(?U)\A\s+|\s+\z", "")) >= least, F.lit(False)))
    last = F.max_by("entity_type", F.struct("seq", "block_id"))
    made = rows.where("_ok").groupBy("doc_id", "target").agg(F.concat(F.lit("[REDACTED_"), last, F.lit("]")).alias("token"))
    return made, rows.where("not _ok").select("doc_id", "block_id", "seq")


def by_spans(text: Column, spans: Column, left: str = "[REDACTED:", right: str = "]") -> Column:
    """The text with spans, an array of (start, end, type), replaced; those that overlap are one, of the first's type.

    Spans outside the text are left out; null texts stay null, and null or no spans change nothing.
    """
    ok = F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)))
    ranked = F.array_sort(F.transform(ok, lambda s: F.struct(s["start"].alias("s"), (-s["end"]).alias("e"), s["type"].alias("t"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["s"] < a["at"], F.struct(F.greatest(a["at"], -s["e"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct((-s["e"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["s"] - a["at"]), F.lit(left), s["t"], F.lit(right)).alias("out"))
    )
    fold = F.aggregate(ranked, start, step)
    return F.when(F.size(F.coalesce(ok, F.array())) == 0, text).otherwise(F.concat(fold["out"], F.substring(text, fold["at"] + 1, F.length(text))))


def replaced(text: str | None, pairs: dict[str, str], any_case: bool = False) -> str | None:
    """The text with values replaced, the longest first, at word borders where they begin or end with a letter or digit."""
    if not text or not pairs:
        return text
    for value, token in sorted(pairs.items(), key=lambda p: (-len(p[0]), p[0])):
        if len(value.strip(" \t\r\n-.,;:_~#*()[]{}|/\\")) < 2:
            continue
        want = ("\\b" if value[0].isalnum() else "") + re.escape(value) + ("\\b" if value[-1].isalnum() else "")
        text = re.sub(f"({TOKEN})|(?:{want})", lambda m, token=token: m.group(1) or token, text, flags=re.IGNORECASE if any_case else 0)
    return text


def by_values(rows: DataFrame, any_case: bool = False) -> DataFrame:
    """rows (.., text, values: map of value to token) with text rewritten; tokens that are there already stay whole.

    The replacement of a value depends on what earlier ones have put there, hence Arrow batches of Python.
    """

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, dict(v) if v is not None else {}, any_case) for t, v in zip(texts, values)], dtype=object)

    return rows.withColumn("text", rewrite("text", "values"))


def numbered(e: DataFrame) -> DataFrame:
    """(doc_id, block_id, text_start, text_end, token): pseudonyms to be written into texts, numbered by first appearance."""
    key = F.lower(F.trim("value"))
    first = F.min(F.struct("seq", "text_start")).over(Window.partitionBy("doc_id", "entity_type", key))
    n = F.dense_rank().over(Window.partitionBy("doc_id", "entity_type").orderBy("_f"))
    rows = e.withColumn("_f", first).withColumn("token", F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), n, F.lit("]")))
    return rows.select("doc_id", "block_id", "text_start", "text_end", "token")
