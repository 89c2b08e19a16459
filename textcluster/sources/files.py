"""File selection.

Fixed values: XML input ends in ``.xml``, text input in ``.txt`` (compared in lower case), each also
gzip-compressed with ``.gz`` added; the name ``NA`` means "no input file" and skips validation.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_extension

XML_EXTENSIONS = (".xml", ".xml.gz")
TEXT_EXTENSIONS = (".txt", ".txt.gz")
SUPPORTED_EXTENSIONS = (*TEXT_EXTENSIONS, *XML_EXTENSIONS)
NO_FILE = "NA"


def validate_file(path: str, extensions=SUPPORTED_EXTENSIONS) -> None:
    """S5 for one named input: not a directory, extension accepted (case-insensitive)."""
    if path == NO_FILE:
        return
    if "://" not in path and os.path.isdir(path):
        raise ValueError("filename is a directory; expected a file")
    if not path.lower().endswith(tuple(e.lower() for e in extensions)):
        raise ValueError(f"invalid file extension; supported: {tuple(extensions)}")


def list_files(spark: SparkSession, path, extensions=SUPPORTED_EXTENSIONS) -> DataFrame:
    """``(source_file, accepted)`` of every file under ``path``: names only, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("source_file"), has_extension(F.element_at(F.split("path", "/"), -1), extensions).alias("accepted"))


def with_source(df: DataFrame, extensions=SUPPORTED_EXTENSIONS, on_bad: str = "skip", path=None) -> DataFrame:
    """S4 + S5 over a directory scan: add ``source_file`` and keep files with an accepted extension.

    ``on_bad='error'`` raises when a file under ``path`` has another extension; the names come from
    the file listing, so no file is read for it.
    """
    if on_bad not in ("skip", "error"):
        raise ValueError("on_bad must be 'skip' or 'error'")
    if on_bad == "error":
        bad = list_files(df.sparkSession, path, extensions).where(~F.col("accepted")).limit(5).collect()
        if bad:
            raise ValueError(f"invalid file extension: {[r[0] for r in bad]}")
    named = df.withColumn("source_file", F.col("_metadata.file_path"))
    return named.where(has_extension(F.col("_metadata.file_name"), extensions))
