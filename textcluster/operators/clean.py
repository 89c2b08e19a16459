"""Record cleaning.

Rule: content = coalesce(content, title); a record is valid when it parsed, has an id and has
content, and (when ``require_title``) a title. Invalid records are kept in a rejected output with
a reason, never silently dropped. Reasons (fixed values): the parser's error text,
``missing_title_and_content``, ``missing_id``, ``missing_title``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finalize(parsed: DataFrame, require_title: bool = True, title_fallback: bool = True) -> DataFrame:
    """fill content from title (XML records) and add ``reject_reason`` (null = valid)."""
    content = F.coalesce(F.col("content"), F.col("title")) if title_fallback else F.col("content")
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("title").isNull() & F.col("content").isNull(), F.lit("missing_title_and_content"))
        .when(F.col("permalink").isNull(), F.lit("missing_id"))
        .when(F.col("content").isNull() & F.lit(not title_fallback), F.lit("missing_content"))
    )
    if require_title:
        reason = reason.when(F.col("title").isNull(), F.lit("missing_title"))
    from_title = F.col("content").isNull() & F.col("title").isNotNull() & F.lit(title_fallback)
    return (
        parsed.withColumn("reject_reason", reason)
        .withColumn("title_as_content", from_title)
        .withColumn("content", content)
        .drop("error")
    )


def valid(df: DataFrame) -> DataFrame:
    """F9 (good side): valid records, without the reason column."""
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    """F9 (rejected side)."""
    return df.where(F.col("reject_reason").isNotNull())


def ingest_counts(df: DataFrame) -> DataFrame:
    """``(n_read, n_valid, n_rejected)`` in one pass."""
    ok = F.col("reject_reason").isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(ok).alias("n_valid"),
        F.count_if(~ok).alias("n_rejected"),
    )


def reject_reasons(df: DataFrame) -> DataFrame:
    """A7 by reason: ``(reject_reason, n)`` over rejected records."""
    return rejected(df).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def drop_null(df: DataFrame) -> DataFrame:
    """drop rows with a null in any column."""
    return df.na.drop("any")


def project_stream(df: DataFrame) -> DataFrame:
    """the ``(permalink, content)`` pair the vectorizer consumes."""
    return df.select("permalink", "content")
