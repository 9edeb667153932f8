"""Matching found entities with the truth, and what is read off the matches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two spans; 0 for empty ones and for spans apart."""
    inter = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when((a1 > a0) & (b1 > b0) & (inter > 0), inter / ((a1 - a0) + (b1 - b0) - inter)).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes [x0, y0, x1, y1]; 0 where they miss each other or have no area."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.when((w >= 0) & (h >= 0), F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))).otherwise(0.0)


def match(found: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches in a document: (doc_id, found_seq, truth_seq), in order of seq.

    Either table: doc_id, seq, page, entity_type, value, text_start, text_end. A found entity takes the first free true
    one of its page and type whose span has an IoU of `least`, else whose value is in the other's or holds it (any
    case). Candidates are an equi-join; a document's candidates, few, are dealt out by a fold in its row.
    """
    p, t = found.alias("p"), truth.alias("t")
    same = (F.col("p.doc_id") == F.col("t.doc_id")) & (F.col("p.page") == F.col("t.page")) & (F.col("p.entity_type") == F.col("t.entity_type"))
    near = text_iou(F.col("p.text_start"), F.col("p.text_end"), F.col("t.text_start"), F.col("t.text_end")) >= least
    x, y = F.lower(F.trim("p.value")), F.lower(F.trim("t.value"))
    alike = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    pairs = p.join(t, same & (near | F.coalesce(alike, F.lit(False)))).select(F.col("p.doc_id").alias("doc_id"), F.col("p.seq").cast("long").alias("a"), F.col("t.seq").cast("long").alias("b"))
    g = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("c"))
    start = F.array().cast("array<struct<a:bigint,b:bigint>>")
    taken = F.aggregate("c", start, lambda acc, q: F.when(F.exists(acc, lambda z: (z["a"] == q["a"]) | (z["b"] == q["b"])), acc).otherwise(F.concat(acc, F.array(q))))
    return g.select("doc_id", F.explode(taken).alias("m")).select("doc_id", F.col("m.a").alias("found_seq"), F.col("m.b").alias("truth_seq"))


def ablation(found: DataFrame, truth: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """(config, category, total, caught, recall) for each configuration that found names; category null: all entities.

    A true entity is caught when it, or one of its document, type and value, is matched. Types in no category count in the total alone.
    """
    key = F.struct("config", "doc_id")
    true = F.broadcast(found.select("config").distinct()).crossJoin(truth).withColumn("doc_id", key)
    pairs = match(found.withColumn("doc_id", key), true).select("doc_id", F.col("truth_seq").alias("seq"), F.lit(1).alias("hit"))
    alike = ["doc_id", "entity_type", "value"]
    hits = true.join(pairs, ["doc_id", "seq"]).select(*alike, "hit").distinct()
    category = F.coalesce(*[F.when(F.col("entity_type").isin(types), name) for name, types in categories.items()], F.lit("other"))
    rows = true.join(hits, alike, "left").withColumn("category", category)
    g = rows.groupingSets([["config", "category"], ["config"]], "config", "category").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("caught"))
    return g.where("category is null or category <> 'other'").withColumn("recall", F.col("caught") / F.col("total"))


def utility(cases: DataFrame) -> DataFrame:
    """(domain, retention, leaks, cases): mean share of expected concepts that the sanitized text keeps, and leaked values.

    cases: domain, expected (array), leaks (array), sanitized. A case without expected concepts counts as kept whole.
    """
    low = F.lower("sanitized")
    kept = F.coalesce(F.try_divide(F.size(F.filter("expected", lambda c: F.contains(low, F.lower(c)))), F.size("expected")), F.lit(1.0))
    leaked = F.exists("leaks", lambda v: (v != "") & F.contains(low, F.lower(v)))
    return cases.groupBy("domain").agg(F.avg(kept).alias("retention"), F.count_if(leaked).alias("leaks"), F.count(F.lit(1)).alias("cases"))


# The types whose recall is told apart; a card counts as high here.
CRITICAL_TYPES = ["SSN", "PAN", "PASSPORT", "AADHAAR", "NINO"]
HIGH_TYPES = ["EMAIL", "PHONE", "PERSON", "ADDRESS", "CARD", "BANK_ACCOUNT", "IFSC", "GST", "UPI"]


def report(docs: DataFrame, found: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1, critical_recall, high_recall, leak_rate, over_redaction.

    pairs: (doc_id, found_seq, truth_seq) as match gives them. A document leaks when one of its true entities is not
    caught; over-redaction is the share of what was found that is not true. Rates without anything to count are 0.
    """
    hit = pairs.select("doc_id", F.col("truth_seq").alias("seq"), F.lit(1).alias("hit"))
    t = truth.select("doc_id", F.col("seq").cast("long").alias("seq"), "entity_type").join(hit, ["doc_id", "seq"], "left")
    missed = F.col("hit").isNull()
    of = lambda types: F.col("entity_type").isin(types)
    counts = t.agg(
        F.count("hit").alias("tp"), F.count_if(missed).alias("fn"), F.countDistinct(F.when(missed, F.col("doc_id"))).alias("leaks"),
        F.count_if(of(CRITICAL_TYPES) & ~missed).alias("ct"), F.count_if(of(CRITICAL_TYPES)).alias("cn"), F.count_if(of(HIGH_TYPES) & ~missed).alias("ht"), F.count_if(of(HIGH_TYPES)).alias("hn"),
    )
    out = counts.crossJoin(found.agg(F.count(F.lit(1)).alias("found"))).crossJoin(docs.agg(F.count(F.lit(1)).alias("docs")))  # one row each
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = out.withColumn("fp", F.col("found") - F.col("tp")).withColumn("true", F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", rate("tp", "found")).withColumn("recall", rate("tp", "true"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("tp", "fp", "fn", "precision", "recall", f1.alias("f1"), rate("ct", "cn").alias("critical_recall"), rate("ht", "hn").alias("high_recall"), rate("leaks", "docs").alias("leak_rate"), rate("fp", "found").alias("over_redaction"))
