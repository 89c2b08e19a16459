"""XML record scan.

The files are read as text split at the record's closing tag, so the scan is splittable (a large
file spreads over many tasks) and each row holds one raw record, cut at its opening tag. Text
before the first record and after the last is dropped, as are ids outside records. ``block`` is the
start of a record's input split in its file and ``seq`` counts up without gaps inside a split, so
(source_file, block, seq) is read order; ``counts.number_records`` makes one dense number of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import RECORD_TAG
from .files import XML_EXTENSIONS, with_source


def cut_records(raw: DataFrame, record_tag: str = RECORD_TAG, value_col: str = "value") -> DataFrame:
    """Keep chunks holding an opening record tag; cut there and restore the closing tag."""
    opening = rf"(?s)(<{record_tag}(?:[\s][^>]*)?>.*)"
    body = F.regexp_extract(F.col(value_col), opening, 1)
    return raw.withColumn("record", F.concat(body, F.lit(f"</{record_tag}>"))).where(body != "")


def read_xml_records(
    spark: SparkSession, path, record_tag: str = RECORD_TAG, extensions=XML_EXTENSIONS, on_bad: str = "skip"
) -> DataFrame:
    """``(source_file, block, seq, record)`` for every record element in the files under ``path``."""
    raw = spark.read.option("lineSep", f"</{record_tag}>").text(path)
    raw = with_source(raw.select("value", "_metadata"), extensions, on_bad, path)
    raw = raw.withColumn("block", F.col("_metadata.file_block_start"))
    return cut_records(raw, record_tag).select("source_file", "block", F.monotonically_increasing_id().alias("seq"), "record")
