"""Sharding by global byte-size prefix sums into contiguous, balanced shards. DataFrame functions only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Cuts the rows, in the order of (id, hash of the text), into `shards` runs of nearly equal bytes.

    A row's size is the UTF-8 length of its text plus 1. The rows are range-partitioned in that order; each
    partition's total bytes and rows form one small table, whose running sums give every partition its global
    offset; within a partition a running sum does the rest. A row goes to the shard in which the middle of its
    byte range lies, so a shard is off its target by less than one row at either end.

    Returns (id, size, text_crc32, shard, slot), where slot counts from 0 without gaps in a shard. Null ids come
    first; null texts count as empty (size 1, crc32 0). Rows alike in id and text are interchangeable. An empty
    table gives no rows; with fewer rows than shards some shards are empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"),
        F.xxhash64(text).alias("tie"),
    )
    # Written once: the partition numbers must not change between the two readings below.
    placed = durable(narrow.repartitionByRange(n, F.col("id").asc_nulls_first(), "tie").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    run = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each partition of the range exchange: its number is a parameter
    at = placed.withColumn("upto", F.sum("size").over(run)).withColumn("nth", F.count(F.lit(1)).over(run)).join(F.broadcast(offsets), "part")
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    at = at.select(
        "id", "size", "crc",
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("all_bytes"))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
    )
    first = at.groupBy("shard").agg(F.min("row").alias("first_row"))
    return at.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )
