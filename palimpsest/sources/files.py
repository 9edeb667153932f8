"""Files as rows: pre-flight checks, dispatch by suffix, text files and annotated JSON documents as blocks."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of each format, in hex; text has none.
MAGIC = {"pdf": "25504446", "docx": "504B0304", "pptx": "504B0304", "png": "89504E47", "jpg": "FFD8FF", "jpeg": "FFD8FF", "bmp": "424D", "tiff": "49492A00|4D4D002A", "txt": ""}
MOST_BYTES = 100 * 1024 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def preflight(files: DataFrame) -> DataFrame:
    """Adds format and error (null: accepted) to files (path, length, content): size, suffix, first bytes, NUL, entities.

    Errors are a column, so that one bad file stops no others.
    """
    fmt = suffix(F.col("path"))
    head = F.hex(F.substring("content", 1, 16))
    magic = F.create_map(*[F.lit(x) for p in MAGIC.items() for x in p])[fmt]
    right = (magic == "") | F.exists(F.split(magic, r"\|"), lambda m: F.startswith(head, m))
    start = F.substring("content", 1, 4096)
    nul = F.hex(start).rlike("^(?:[0-9A-F]{2})*?00")
    declared = F.lower(F.decode(start, "iso-8859-1"))
    entity = F.contains(declared, F.lit("<!doctype")) & (F.contains(declared, F.lit("<!entity")) | F.contains(declared, F.lit("system")))
    error = (
        F.when(F.coalesce("length", F.lit(0)) <= 0, "EMPTY_FILE").when(F.col("length") > MOST_BYTES, "FILE_TOO_LARGE").when(magic.isNull(), "UNSUPPORTED_FORMAT")
        .when(~right, "MAGIC_MISMATCH").when((fmt == "txt") & nul, "BINARY_TEXT").when(entity, "XML_ENTITY")
    )
    return files.withColumn("format", fmt).withColumn("error", error)


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "iso-8859-1"))


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Blocks (doc_id = path, block_id, seq, text) of the accepted text files under paths."""
    from palimpsest.operators.spans import text_blocks

    files = preflight(spark.read.format("binaryFile").load(paths))
    texts = files.where("format = 'txt' and error is null").select(F.col("path").alias("doc_id"), decoded(F.col("content")).alias("text"))
    return text_blocks(texts)


ANNOTATED = "document_id string, blocks array<struct<block_id:string,page:int,section_context:string,text:string>>, ground_truth_entities array<struct<type:string,value_snippet:string,page:int,text_start:int,text_end:int,risk:string>>"


def read_annotated(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(blocks, truth) of annotated JSON documents, one object a file."""
    docs = spark.read.schema(ANNOTATED).json(paths, multiLine=True)
    blocks = docs.select(F.col("document_id").alias("doc_id"), F.posexplode("blocks").alias("seq", "b")).select("doc_id", "b.block_id", "seq", "b.page", "b.section_context", "b.text")
    truth = docs.select(F.col("document_id").alias("doc_id"), F.posexplode("ground_truth_entities").alias("seq", "g"))
    return blocks, truth.select("doc_id", "seq", F.col("g.type").alias("entity_type"), F.col("g.value_snippet").alias("value"), "g.page", "g.text_start", "g.text_end", "g.risk")
