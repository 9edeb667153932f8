"""Shared plumbing: table access, durable intermediate tables, component labelling."""

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of long texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, rows)


def give_back() -> None:
    """Returns to the system what numpy and Arrow have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run):
    """run, a function over batches; at its end the worker gives back what it freed.

    Spark keeps its Python workers, and what an idle one holds counts against the executor while the JVM works.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def lean_group(solve):
    """The same for a function over the table of a group."""

    def whole(table):
        try:
            return solve(table)
        finally:
            give_back()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        named = tempfile.mkdtemp(prefix="palimpsest-")  # one machine, so all share it
        spark.conf.set("spark.checkpoint.dir", named)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended first; the folder is then the cluster's to clear
        pass


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to all tasks if its rows, which are counted, are at most `most`; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def plain(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns called c0, c1, ..., which clash with no name in here, and the new names of the given ones."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in columns]


def named(df: DataFrame, docs: DataFrame, new: list[str]) -> DataFrame:
    """plain() undone: the columns of docs but those that the new ones replace (in any case of letters), then the new ones."""
    replaced = {c.lower() for c in new}
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in replaced], *new)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge table by alternating large-star and small-star.

    Returns (node, component), the component being its smallest node; only nodes with an edge to another
    node appear. Each round is one aggregation with map-side minima and one join. The minima are written before they
    are joined, so that the join reads nothing but exchanges and adaptive execution can split a node with very many
    edges. Null ends and self-loops are ignored. An empty table gives an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v is not null and u is not null and u < v").distinct()
    e = durable(e)
    for _ in range(rounds):
        # done when the edges are stars: every v has one u, and no u is a v
        size = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("m")).first()
        if size["n"] == size["m"] and not e.select("u").distinct().join(e.select("v"), F.col("u") == F.col("v"), "left_semi").limit(1).count():
            break
        both = e.select(F.col("u").alias("n"), F.col("v").alias("o")).union(e.select(F.col("v").alias("n"), F.col("u").alias("o")))
        low = durable(both.groupBy("n").agg(F.least(F.min("o"), F.first("n")).alias("m")))
        large = both.where("o > n").join(low, "n").select(F.col("o").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u").where("u < v").distinct()
        e = durable(small)
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
