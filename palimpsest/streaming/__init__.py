"""Streams of model outputs: scanned row by row, and counted in windows of event time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import verifier


def released(outputs: DataFrame, **options) -> DataFrame:
    """Outputs (.., text) as verifier.release leaves them, and withheld, true where a second scan still finds something.

    No state is kept: rows are scanned alone, batch or stream alike. A withheld row's text is null.
    """
    once = verifier.release(outputs, **options)
    again = verifier.with_findings(once, **options)
    held = F.size("findings") > 0
    return again.select(*[F.when(~held, F.col("text")).alias("text") if c == "text" else c for c in once.columns], held.alias("withheld"))


def leak_counts(outputs: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", **options) -> DataFrame:
    """(start, n, leaks): outputs and those with findings in each window of event time; rows later than `late` are dropped."""
    rows = verifier.release(outputs.withWatermark(time, late), **options)
    return rows.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_findings") > 0).alias("leaks")).select(F.col("w.start").alias("start"), "n", "leaks")


def write(outputs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream to Parquet files, each row once, as the checkpoint's offsets say."""
    return outputs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
