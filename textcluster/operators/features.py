"""Vocabulary, idf and tf-idf weights.

Relational ("long") form: ``(doc_id, term_idx, term, weight)`` rows, checkable against SQL.
The vocabulary is capped at ``max_features`` rows, so it is the only table we broadcast; its size
bound is structural (a top-n), never a guess.

idf = ln((1 + N) / (1 + df)) + 1 (smoothed, with the + 1 Spark's ``IDF`` lacks).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import term_stats

VECTORIZERS = ("tfidf", "hashing")
NORMS = ("l1", "l2")
COUNTED_BY = ("grouping", "summary")


@dataclass(frozen=True)
class TfidfParams:
    """Defaults equal the reference settings: df bounds 0.05..0.7, 10,000 terms, L1 rows."""

    min_df: float = 0.05
    max_df: float = 0.7
    max_features: int = 10000
    norm: str = "l1"
    stop_words: tuple | None = field(default=None)  # None = Spark's English list

    def __post_init__(self):
        if self.norm not in NORMS:
            raise ValueError(f"norm must be one of {NORMS}, got {self.norm!r}")
        if not (0.0 <= self.min_df <= 1.0 and 0.0 <= self.max_df <= 1.0):
            raise ValueError("min_df and max_df are fractions of the document count")
        if self.max_features <= 0:
            raise ValueError("max_features must be positive")


def check_vectorizer(name: str) -> str:
    """M9: the vectorizer choice; anything else is an error."""
    if name not in VECTORIZERS:
        raise ValueError(f"unsupported vectorizer {name!r}; use one of {', '.join(VECTORIZERS)}")
    return name


def doc_count(docs: DataFrame) -> Column:
    """N as a scalar subquery: computed once, shipped to tasks as a constant."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()


def vocabulary(tf: DataFrame, n_docs: Column, params: TfidfParams = TfidfParams()) -> DataFrame:
    """F8 + L3 + L5 from per-document term counts: see ``vocabulary_from_stats``."""
    return vocabulary_from_stats(term_stats(tf), n_docs, params)


def vocabulary_from_stats(stats: DataFrame, n_docs: Column, params: TfidfParams = TfidfParams()) -> DataFrame:
    """F8 + L3 + L5: ``(term_idx, term, df, cf)`` from ``(term, df, cf)``.

    Keep terms with min_df*N <= df <= max_df*N, then the ``max_features`` most frequent by corpus
    count (ties by term), then index them alphabetically from 0. At most ``max_features`` rows.
    """
    kept = stats.where(
        (F.col("df") >= F.lit(float(params.min_df)) * n_docs) & (F.col("df") <= F.lit(float(params.max_df)) * n_docs)
    )
    top = kept.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(params.max_features)
    # Global window over at most max_features rows.
    idx = F.row_number().over(Window.orderBy("term")) - 1
    return top.select(idx.cast("bigint").alias("term_idx"), "term", "df", "cf")


def idf_table(vocab: DataFrame, n_docs: Column) -> DataFrame:
    """A4: ``(term_idx, term, df, idf)`` over the vocabulary."""
    idf = F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return vocab.select("term_idx", "term", "df", idf.alias("idf"))


def normalise_long(weights: DataFrame, norm: str = "l1", id_col: str = "doc_id", w_col: str = "w") -> DataFrame:
    """A5: divide each weight by its document's L1 (sum |w|) or L2 (sqrt sum w^2) norm."""
    win = Window.partitionBy(id_col)
    if norm == "l1":
        n = F.sum(F.abs(F.col(w_col))).over(win)
    elif norm == "l2":
        n = F.sqrt(F.sum(F.col(w_col) * F.col(w_col)).over(win))
    else:
        raise ValueError(f"norm must be one of {NORMS}")
    return weights.withColumn("weight", F.col(w_col) / n).drop(w_col)


def tfidf_long(tf: DataFrame, idf: DataFrame, norm: str = "l1", id_col: str = "doc_id") -> DataFrame:
    """M1 (long form): ``(doc_id, term_idx, term, tf, weight)`` for terms in the vocabulary.

    The broadcast side is the vocabulary, a top-n of at most ``max_features`` rows; the norm window
    exchanges the weights by document. ``vectors.tfidf_rows`` gives the same rows with no exchange,
    from a fitted vectorizer. Documents with no kept term have no rows (a zero vector).
    """
    joined = tf.join(F.broadcast(idf.select("term", "term_idx", "idf")), "term")
    w = joined.select(id_col, "term_idx", "term", "tf", (F.col("tf") * F.col("idf")).alias("w"))
    return normalise_long(w, norm, id_col)
