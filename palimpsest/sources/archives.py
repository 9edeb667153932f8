"""Zip-based files: whether their directory of entries is safe to unpack."""

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries, bytes unpacked, bytes unpacked for each byte packed.
MOST_ENTRIES = 10_000
MOST_UNPACKED = 350 * 1024 * 1024
MOST_RATIO = 100.0


def error_of(content: bytes | None, entries: int = MOST_ENTRIES, unpacked: int = MOST_UNPACKED, ratio: float = MOST_RATIO) -> str | None:
    """What is wrong with an archive, from its directory alone: nothing is unpacked. None: nothing is."""
    if not content or not zipfile.is_zipfile(io.BytesIO(content)):
        return "NOT_AN_ARCHIVE"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            listed = z.infolist()
    except (zipfile.BadZipFile, NotImplementedError, ValueError):
        return "CORRUPT_ARCHIVE"
    if len(listed) > entries:
        return "TOO_MANY_ENTRIES"
    for x in listed:
        if ".." in x.filename or x.filename[:1] in ("/", "\\"):
            return "PATH_TRAVERSAL"
        if x.file_size > unpacked:
            return "ENTRY_TOO_LARGE"
    total = sum(x.file_size for x in listed)
    if total > unpacked:
        return "ARCHIVE_TOO_LARGE"
    return "ZIP_BOMB" if total > ratio * len(content) else None


def with_archive_error(files: DataFrame, **limits) -> DataFrame:
    """Adds archive_error (null: safe) to files (.., content), in batches of Arrow; a bad file stops no others."""

    @F.pandas_udf("string")
    def check(content: pd.Series) -> pd.Series:
        return content.map(lambda c: error_of(c, **limits))

    return files.withColumn("archive_error", check("content"))
