"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, mixing, ngram_join, sharding, toxicity
from palimpsest.llm.common import WORD, bounded, durable, plain, table
from palimpsest.llm.queries import SHARDS, WEIGHTS, toxicity_model

#: So many ids are sent to all tasks; more are joined by id.
BROADCAST_IDS = 1_000_000

#: Ranges of the positions in a shard of the mix: the values of a hash's first 20 bits.
SLICES = 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are toxic with probability 1/2 or more; null and empty texts stay.

    Each row is judged alone, repeated ones alike. An empty table gives none. Other columns may have any name.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    rows, (i, text) = plain(docs, "doc_id", "text")
    scored = toxicity.score_toxicity(rows, model, id_col=i, text_col=text, keep=True)
    return scored.where(~F.col("is_toxic")).select(*rows.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near duplicates (five-word shingles, Jaccard 0.8).

    Rows are told apart by a 64-bit hash of id and text, so unrelated texts under one id, or under none, are judged
    each for itself; a row without an id stays only where its group has none with one. Of rows alike in id and text
    one stays; if they differ in other columns, any of them. Texts without words, also null ones, all stay. An empty
    table gives none. Other columns may have any name.
    """
    rows, (i, text) = plain(docs, "doc_id", "text")
    has_words = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    live = rows.where(has_words).withColumn("key", F.xxhash64(i, text))
    found = ngram_join.jaccard_components(live, words=5, percent=80, id_col="key", text_col=text).groupBy("key").agg(F.min("component_id").alias("component"))
    ids = live.groupBy("key").agg(F.min(i).alias("id"), F.count(F.lit(1)).alias("copies")).join(found, "key")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "copies"))
    kept = durable(ids.groupBy("component").agg(least.alias("x")).select("x.key", "x.copies"))
    out = live.join(bounded(kept.select("key"), BROADCAST_IDS), "key", "left_semi")
    if kept.where("copies > 1").limit(1).count():
        again = bounded(kept.where("copies > 1").select("key"), BROADCAST_IDS)
        out = out.join(again, "key", "left_anti").unionByName(out.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return out.select(*rows.columns).unionByName(rows.where(~has_words)).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of the benchmark; null and empty texts stay.

    Each row is judged alone, repeated ones alike. An empty table gives none. Other columns may have any name.
    """
    rows, (i, text) = plain(docs, "doc_id", "text")
    marked = decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=i, text_col=text, keep=True)
    return marked.where(~F.col("contaminated")).select(*rows.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Returns a row for each copy the mix takes, its text whole, in the order of the splitting tree's shards, shuffled in each.

    A copy of which the mix takes half the words or more stays; one of less goes. Null and wordless texts are never
    taken, rows alike share one fate, an empty table gives none. Other columns may have any name.
    """
    rows, (i, text, source) = plain(docs, "doc_id", "text", "source")
    mixed = mixing.mix(rows, WEIGHTS, 1.5, 2.0, SHARDS, id_col=i, text_col=text, source_col=source, keep=True)
    out = mixed.select("*", F.explode("draws").alias("draw"))
    out = out.where(2 * F.col("draw.words") >= F.regexp_count(text, F.lit(WORD)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # positions are hashes, so equal ranges of them hold equal parts of a shard and need no sample of the rows
    place = F.col("draw.shard").cast("long") * SLICES + F.shiftright("draw.position", 44) + SLICES // 2
    out = out.repartitionById(parts, F.floor(place * parts / (SHARDS * SLICES)).cast("int")).sortWithinPartitions("draw.shard", "draw.position")
    return out.select(*rows.columns).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns every row to a shard: (doc_id, size, text_crc32, shard, slot), as sharding.shard says."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No stage but the last can be said in SQL: the decisions are a trained model's, a hash's and an index's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
