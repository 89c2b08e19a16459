"""A corpus cleaning pipeline over ``documents``: toxic documents go, repeated lines go, one document
of each near-duplicate group stays, documents with benchmark windows go, the rest is encoded.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame; all but the last return the columns of ``docs``. ``run`` writes each result as Parquet in
the shared checkpoint folder and reads it back as the next stage's input.

Null, empty, very long, tied and repeated texts, empty tables and extra columns are handled as each
operator's module states; extra columns of the input are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcluster.llm import decontaminate, jaccard, line_dedup, pieces, toxicity
from textcluster.llm.common import table, written

#: near duplicates: word 5-grams, Jaccard similarity of 0.8 or more
NEAR = jaccard.Similarity(k=5, num=80, den=100)
SEED, RATE = 7, 0.1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity cut of their language; the classifier is fitted on labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by many documents stay in the last of them only; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    changed = F.col("__ld_dropped") > 0
    new = {"text": F.col("__ld_kept"), "n_chars": F.when(changed, F.length("__ld_kept").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {"text": F.col("__ld_kept")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return jaccard.keep_one(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids under merge-dropout, their number, and whether they decode
    to the text; an input column with one of these names gives way."""
    return pieces.encode_documents(docs, pieces.load(), seed=SEED, rate=RATE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("piece_encoding", encode),
]
#: the fitted classifier of the first stage has no SQL; tests compare the others with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
