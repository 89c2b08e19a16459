"""The given Parquet tables, and the article view of ``documents``.

Article mapping (fixed values): permalink = doc_id + 10000000 as text (eight digits), title = the
first line of the text, content = the text, seq = doc_id (read order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line
from ..session import deal_small

PERMALINK_OFFSET = 10000000

#: tables whose rows cost most per byte read
TEXT_TABLES = ("documents", "pages")

ARTICLE_COLUMNS = ("doc_id", "seq", "title", "content", "permalink")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return deal_small(df) if name in TEXT_TABLES else df


def permalink_of(doc_id) -> "F.Column":
    """The eight-digit permalink of a document id (a column or column name)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (c + F.lit(PERMALINK_OFFSET)).cast("string")


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, seq, title, content, permalink)`` from the ``documents`` table."""
    return documents.select(
        F.col("doc_id"),
        F.col("doc_id").alias("seq"),
        first_line(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        permalink_of("doc_id").alias("permalink"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(read_table(spark, sf_dir, "documents"))
