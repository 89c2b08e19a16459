"""A bounded, deterministic sample of labelled documents for fitting a classifier, and calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: at most this many rows of label 1 and of label 0 are used for fitting, whatever the input
SAMPLE_PER_LABEL = 3000
FOLDS = 5


def fold(id_col: Column) -> Column:
    """crc32 of the id as text modulo 5; fold 0 is held out. A null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE_PER_LABEL) -> tuple[pa.Table, dict[int, int]]:
    """(table of text, y, fold on the driver; number of usable labelled ids by label).

    Ids are drawn by hash among those that are not held out, at most ``per_label`` of each label; one
    text per id, so the table is bounded however often an id repeats."""
    own = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    own = own.filter(fold(F.col("id")) != 0).dropDuplicates(["id", "y"])
    counts = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    drawn = None
    for y in (0, 1):
        part = own.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(label), "id"), "id").limit(per_label)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    met = rows.join(F.broadcast(drawn), "id").dropDuplicates(["id", "y"]).select("id", "text", "y", fold(F.col("id")).cast("int").alias("fold"))
    found = met.toArrow()
    return found.sort_by([("id", "ascending"), ("y", "ascending")]), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-back rows."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 of label 1; among equals the middle of the widest gap."""
    order = np.argsort(logits)
    x, t = logits[order], y[order] > 0
    above = t.sum() - np.concatenate([[0], np.cumsum(t)])[:-1]  # label 1 at or above each value
    size = len(x) - np.arange(len(x))
    f1 = 2 * above / np.maximum(size + t.sum(), 1)
    lower = np.concatenate([[x[0] - 2.0], x[:-1]])
    f1 = np.where(x > lower, f1, -1)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    best = top[np.argmax((x - lower)[top])]
    return float((x[best] + lower[best]) / 2)
