"""Term statistics of the frequent terms only (F8, A2, A3, L3), by a mergeable heavy-hitter summary.

``min_df`` asks for terms in at least ``min_df * N`` documents. A grouping by term shuffles every distinct
term of every task for that, most of them seen once. Here each task keeps a Misra-Gries summary of its
documents' distinct terms: at most ``counters`` terms, each counted too low by at most the task's ``error``.
Summaries add up: a term's document frequency is at most its summed count plus the summed errors, also
if no task kept it. Where the summed errors stay below the bound asked for, the terms whose upper limit
reaches it hold every frequent term, and a second pass counts only those, exactly.

The summed error of W (document, distinct term) pairs is at most W / (counters + 1). If the first summary is
too coarse, W and N are known by then and the second is made with enough counters. Bounds that would
need more than ``MAX_COUNTERS`` (few documents, or ``min_df`` near 0: nearly every term is asked for) go
to the grouping by term, with the same result.

Null and empty texts count as documents without terms; an empty table gives no terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_words, tokenize
from ..session import scratch_path
from .features import TfidfParams
from .tokens import _words, term_stats_from_docs

#: counters of a task's first summary, and the most that a summary may have
COUNTERS, MAX_COUNTERS = 1 << 16, 1 << 20
SUMMARY = "term string, n bigint, docs bigint, weight bigint, error bigint"


def cut(counts: np.ndarray, counters: int) -> int:
    """What to take off every count so that at most ``counters`` stay above 0. With more than that many
    counts, at least ``counters + 1`` of them lose this much, which bounds the sum of all cuts."""
    if len(counts) <= counters:
        return 0
    return int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])


def _summary_fn(counters: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        docs = weight = error = 0
        held = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

        def trimmed(table):
            nonlocal error
            less = cut(table["n"].to_numpy(), counters)
            error += less
            if not less:
                return table
            table = table.set_column(table.schema.get_field_index("n"), "n", pc.subtract(table["n"], less))
            return table.filter(pc.greater(table["n"], 0))

        for b in batches:
            docs += b.num_rows
            terms = pc.list_flatten(b.column("t")).cast(pa.string())
            weight += len(terms)
            counted = pc.value_counts(terms)
            new = pa.table({"term": counted.field("values"), "n": counted.field("counts")})
            held = pa.concat_tables([held, new]).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
            if len(held) > 2 * counters:
                held = trimmed(held)
        held = trimmed(held).combine_chunks()
        none = pa.array([None], pa.int64())
        sums = [pa.array([x], pa.int64()) for x in (docs, weight, error)]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), none, *sums], names=["term", "n", "docs", "weight", "error"])
        for b in held.to_batches():
            gone = [pa.nulls(b.num_rows, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column("term"), b.column("n"), *gone], names=["term", "n", "docs", "weight", "error"])

    return run


@dataclass
class Summary:
    """``terms`` is ``(term, n)``, ``n`` at most ``error`` below the document frequency; ``docs`` and
    ``weight`` count the documents and their distinct terms."""

    terms: DataFrame
    docs: int
    weight: int
    error: int


def summarise(docs: DataFrame, text_col: str = "content", stop_words=None, counters: int = COUNTERS) -> Summary:
    """The tasks' summaries, written once and added up by term: at most ``counters`` + 1 rows a task."""
    if counters < 1:
        raise ValueError("counters must be positive")
    spark = docs.sparkSession
    tok = docs.select(F.array_distinct(remove_words(tokenize(F.col(text_col)), _words(stop_words))).alias("t"))
    path = scratch_path(spark, "heavy")
    tok.mapInArrow(_summary_fn(counters), SUMMARY).write.parquet(path)
    rows = spark.read.schema(SUMMARY).parquet(path)
    whole = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "weight", "error")]).first()
    terms = rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    return Summary(terms, whole["docs"], whole["weight"], whole["error"])


def counters_for(weight: int, least: float) -> int:
    """Counters whose summed error is at most half of ``least``."""
    return int(2 * weight / least) + 1 if least > 0 else MAX_COUNTERS + 1


def candidates(docs: DataFrame, least_share: float, text_col: str = "content", stop_words=None, counters: int = COUNTERS) -> DataFrame | None:
    """``(term)``: every term in at least ``least_share`` of the documents, and some below. The summed
    error is at most half the bound, so they are at most 2 * W / (least_share * N): twice the mean of
    distinct terms a document over ``least_share``, whatever N. None where no summary is fine enough."""
    found = summarise(docs, text_col, stop_words, counters)
    least = least_share * found.docs
    if found.error > least / 2:
        needed = counters_for(found.weight, least)
        if needed > MAX_COUNTERS:
            return None
        found = summarise(docs, text_col, stop_words, needed)
    elif least <= 1:
        return None
    return found.terms.where(F.col("n") + F.lit(found.error) >= F.lit(least)).select("term")


def frequent_term_stats(docs: DataFrame, params: TfidfParams = TfidfParams(), text_col: str = "content", counters: int = COUNTERS) -> DataFrame:
    """A2 + A3 of at least the terms that ``params.min_df`` keeps: ``(term, df, cf)``, exact. Equal to
    ``tokens.term_stats_from_docs`` on those terms; ``vocabulary_from_stats`` gives the same vocabulary."""
    kept = candidates(docs, params.min_df, text_col, params.stop_words, counters)
    if kept is None:
        return term_stats_from_docs(docs, text_col, params.stop_words)
    # Broadcast: at most 2 * W / (min_df * N) terms, see ``candidates``.
    return term_stats_from_docs(docs, text_col, params.stop_words, only=F.broadcast(kept))
