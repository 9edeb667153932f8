"""Queries of names and identifiers by pattern, of the filters on names, of weights and archives, and the SQL that says the same."""

import io
import zipfile

from pyspark.sql import functions as F

from palimpsest.functions.weights import composite
from palimpsest.operators import names
from palimpsest.sources import archives

from .catalog import _fixture, _read, query

IDS = [(1, "PAN ABCPE1234F, abcde1234f"), (2, "9123 4567 8901 and 9123-4567-8901"), (3, "passport M1234567"), (4, "NI AB 12 34 56 C"), (5, "emp-20417 HDFC0001234"), (6, "27ABCPE1234F1Z5"), (7, "PESEL: 44051401359"), (8, ""), (9, "nothing here")]
FOUND = [
    (1, "PAN", "pan_strict", 0.85, 4, 14), (1, "PAN", "pan_relaxed", 0.60, 16, 26), (2, "AADHAAR", "aadhaar_spaced", 0.85, 0, 14), (2, "AADHAAR", "aadhaar_dashed", 0.85, 19, 33), (3, "PASSPORT", "in_passport", 0.50, 9, 17),
    (4, "NINO", "nino", 0.85, 3, 16), (5, "EMPLOYEE_ID", "emp_id", 0.80, 0, 9), (5, "IFSC", "ifsc", 0.80, 10, 21), (6, "GST", "gstin", 0.90, 0, 15), (7, "PESEL", "pesel_pattern", 0.90, 0, 18),
]


@query(_fixture("doc_id, entity_type, variant, confidence, text_start, text_end", FOUND))
def n7_recognisers(spark, sf_dir):
    return names.recognise(spark.sql(_fixture("doc_id, text", IDS))).drop("value")


PAIRS = "FROM (SELECT n_nationkey, 'Na' || chr(97 + n_nationkey::INT) AS n FROM nation), (SELECT 'Re' || chr(97 + r_regionkey::INT) AS r FROM region)"


@query(f"""
WITH p AS (SELECT n_nationkey AS doc_id, r AS block_id, n, r {PAIRS})
SELECT doc_id, block_id, 'composite' AS variant, 10 AS text_start, n || ' K. ' || r AS value FROM p UNION ALL
SELECT doc_id, block_id, 'initials', 14, 'K. ' || r FROM p UNION ALL
SELECT doc_id, block_id, 'initials', 25, 'J. ' || n FROM p""")
def n4_n6_names(spark, sf_dir):
    """Names made of the keys of nations and regions: initials first, then the composite names that no earlier one covers."""
    name = lambda start, key: F.concat(F.lit(start), F.char(F.col(key) + 97))
    nations = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), name("Na", "n_nationkey").alias("n"))
    regions = F.array_sort(F.collect_set(name("Re", "r_regionkey")))
    # the regions' names, a list of fixed size, go to each nation
    listed = _read(spark, sf_dir, "region").agg(regions.alias("rs")).first().rs
    blocks = nations.withColumn("block_id", F.explode(F.array(*map(F.lit, listed))))
    blocks = blocks.select("doc_id", "block_id", F.concat(F.lit("Signed by "), "n", F.lit(" K. "), "block_id", F.lit(" and J. "), "n", F.lit(".")).alias("text"))
    return names.find_names(blocks).select("doc_id", "block_id", "variant", "text_start", "value")


@query("""
SELECT n_nationkey AS doc_id, n_name AS value, 2 AS text_start, 2 + length(n_name) AS text_end FROM nation UNION ALL
SELECT n_nationkey, r_name, 3 + length(n_name), 3 + length(n_name) + length(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey""")
def n3_lines(spark, sf_dir):
    """Persons whose value holds two lines: a nation and its region."""
    both = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select(F.col("n_nationkey").alias("doc_id"), F.concat("n_name", F.lit("\n"), "r_name").alias("value")).withColumn("text", F.concat(F.lit("x "), "value"))
    rows = rows.withColumn("entity_type", F.lit("PERSON")).withColumn("text_start", F.lit(2)).withColumn("text_end", F.length("text"))
    return names.split_lines(rows).select("doc_id", "value", "text_start", "text_end")


@query("SELECT n_nationkey AS doc_id, replace(n_name, '_', ' ') AS value FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey NOT IN (4, 18)")
def f9_plausible(spark, sf_dir):
    """Names of nations as persons: those written with an underscore, an excluded one and one with a word for a unit go."""
    value = F.when(F.col("n_nationkey") % 2 == 0, F.translate("n_name", "_", " ")).otherwise(F.col("n_name"))
    rows = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), value.alias("value"), value.alias("text"))
    rows = rows.withColumn("entity_type", F.lit("PERSON")).withColumn("confidence", F.lit(0.95)).withColumn("text_end", F.length("text"))
    return names.plausible(rows, excluded=["nation 4"], suffixes=["18"]).select("doc_id", "value")


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.30 * (CAST(l_discount AS DOUBLE) * 10) + 0.20 * (CAST(l_tax AS DOUBLE) * 10) + 0.15)), 6) AS confidence FROM lineitem")
def v13_composite(spark, sf_dir):
    score = lambda c: F.col(c).cast("double") * 10
    both = composite({"regex": score("l_discount"), "context": score("l_tax"), "validator": 1.0})
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(both, 6).alias("confidence"))


def _zip(*entries: tuple[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


@query(_fixture("doc_id, archive_error", [(1, None), (2, "NOT_AN_ARCHIVE"), (3, "PATH_TRAVERSAL"), (4, "PATH_TRAVERSAL"), (5, "ZIP_BOMB")]))
def f11_archives(spark, sf_dir):
    files = [_zip(("a.xml", b"<a/>")), b"%PDF", _zip(("../a", b"1")), _zip(("/a", b"1")), _zip(("a", bytes(1 << 20)))]
    return archives.with_archive_error(spark.createDataFrame(list(enumerate(files, 1)), "doc_id int, content binary")).drop("content")
