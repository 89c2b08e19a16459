"""Tokens and term statistics.

Plan shape: every document is one row, so its term counts (A1) are made inside the row, with no
exchange of text or terms. Corpus statistics (A2, A3) shuffle by term after a partial aggregation in
each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import english_stop_words
from ..functions.text import remove_words, tokenize
from .models import in_slices, list_sizes


def _words(stop_words):
    return english_stop_words() if stop_words is None else tuple(stop_words)


def add_tokens(df: DataFrame, text_col: str = "content", out_col: str = "tokens", stop_words=None) -> DataFrame:
    """C10 + F7 as an array column, token order kept (``stop_words=()`` keeps every token)."""
    return df.withColumn(out_col, remove_words(tokenize(F.col(text_col)), _words(stop_words)))


def token_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "content", stop_words=None) -> DataFrame:
    """``(id_col, term)``: one row per kept token occurrence."""
    words = _words(stop_words)
    rows = df.select(id_col, F.explode(tokenize(F.col(text_col))).alias("term"))
    return rows.where(~F.col("term").isin(list(words))) if words else rows


def term_freq(df: DataFrame, id_col: str = "doc_id", text_col: str = "content", stop_words=None) -> DataFrame:
    """A1: ``(id_col, term, tf)`` from documents; a row's tokens are counted in slices of
    their Arrow batch."""
    id_type = df.schema[id_col].dataType.simpleString()
    toks = add_tokens(df.select(id_col, text_col), text_col, "t", stop_words).select(id_col, "t")
    return toks.mapInArrow(_count_fn(id_col), f"{id_col} {id_type}, term string, tf bigint")


def _count_fn(id_col: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in in_slices(batches, list_sizes("t")):
            lists = b.column("t")
            rows = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            coded = pc.list_flatten(lists).dictionary_encode()
            width = max(len(coded.dictionary), 1)
            key, tf = np.unique(rows * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            cols = [b.column(id_col).take(pa.array(key // width)), coded.dictionary.take(pa.array(key % width)), pa.array(tf)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "term", "tf"])

    return run


def term_stats_from_docs(df: DataFrame, text_col: str = "content", stop_words=None, only: DataFrame | None = None) -> DataFrame:
    """A2 + A3 straight from the documents, with no exchange of text: each row emits its distinct
    terms (``array_distinct``, flag 1: a df contribution) followed by every occurrence (flag 0: a
    cf contribution); partial aggregation by term leaves one row per term per task to shuffle.
    Built from array built-ins only (no lambdas), with the tokens computed once per row. ``only``
    (a column ``term``) restricts the counts to those terms, before the aggregation."""
    tok = df.select(remove_words(tokenize(F.col(text_col)), _words(stop_words)).alias("t"))
    distinct = F.array_distinct("t")
    flags = F.concat(F.array_repeat(F.lit(1), F.size(distinct)), F.array_repeat(F.lit(0), F.size("t")))
    rows = tok.select(F.inline(F.arrays_zip(F.concat(distinct, F.col("t")).alias("term"), flags.alias("d"))))
    rows = rows if only is None else rows.join(only, "term", "left_semi")
    return rows.groupBy("term").agg(
        F.sum("d").cast("bigint").alias("df"), F.sum(F.lit(1) - F.col("d")).cast("bigint").alias("cf")
    )


def term_stats(tf: DataFrame) -> DataFrame:
    """A2 + A3: ``(term, df, cf)`` = documents containing the term, and its total count."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf"))
