"""CSV records of whole files, found in the task that reads the file.

A quoted field may hold line breaks, so a line's meaning depends on all lines
before it. An upload is at most ``max_bytes`` long, so a file is one row, its text
is cut into records by one expression, and its rows never meet those of another
task.

Text that is not UTF-8 is handled as one character per byte (ISO-8859-1); quotes and
separators are the same in every encoding the exports use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
#: A record, begun outside quotes, whose last field opens a quote that it does not close.
ENDS_QUOTED = rf'\A(?:{_FIELD},)*+"(?:[^"]++|"")*+\z'
#: A record and its line break (a line feed or a carriage return); one that ends within quotes goes on to the file's end.
_PART = r'(?:"(?:[^"]++|"")*+(?:"[^,\r\n]*+|\z)|[^",\r\n][^,\r\n]*+|)'
#: Lines without a quote, which most are, are taken in one run.
RECORD = rf'([^"\r\n]*+(?=[\r\n]|\z)|{_PART}(?:,{_PART})*+)(?:[\r\n]|\z)'
FILLED = r"[^ \t]"


def read_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """(file, encoding, bom, unclosed, records) of the CSV files under a folder that have content.

    ``encoding`` is the first of utf-8, cp1251 and latin-1 that reads the whole file. ``records`` are the texts of those
    that are not blank, in order; those of a cp1251 file are left in one character per byte. A file that ends within
    quotes (``unclosed``) has none. Files of more than ``max_bytes`` are not read.
    """
    read = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
            .where((F.col("length") > 0) & (F.col("length") <= max_bytes)))
    bom = F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf")
    read = read.select(F.col("path").alias("file"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"), bom.alias("bom"),
                       F.when(bom, F.substring("content", 4, max_bytes)).otherwise(F.col("content")).alias("body"))
    # A file is decoded once, not record by record; bytes that are UTF-8 are a text already.
    read = read.select("file", "utf8", "bom", F.when(F.col("utf8"), F.col("body").cast("string")).otherwise(F.decode("body", "ISO-8859-1")).alias("text"))
    filled = F.filter(F.regexp_extract_all("text", F.lit(RECORD), F.lit(1)), lambda r: r.rlike(FILLED))
    encoding = F.when(F.col("utf8"), "utf-8").when(F.col("text").contains("\x98"), "latin-1").otherwise("cp1251")
    found = read.select("file", encoding.alias("encoding"), "bom", filled.alias("records"))
    found = found.withColumn("unclosed", F.coalesce(F.try_element_at("records", F.lit(-1)).rlike(ENDS_QUOTED), F.lit(False)))
    return found.withColumn("records", F.when(F.col("unclosed"), F.array().cast("array<string>")).otherwise(F.col("records")))
