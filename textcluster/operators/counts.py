"""Row numbers, part numbers and document counts.

A dense 0-based rank over any order key never takes a global window over the data, and no row is
moved for it but its key. The keys alone are range-partitioned and sorted, so that a partition holds
a stretch of the order of bounded size, however sparse or skewed the keys are; one row per partition
gives its offset. Ranks go back to the rows by key, or, for part numbers, as the few keys at which
a part begins: a row's part is found by binary search in its own task, with no exchange at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

PART_THRESHOLD = 100000
#: blocks of records whose offsets go to every task; with more, records and offsets are exchanged by block
MAX_BLOCKS = 20000


def ranked_keys(df: DataFrame, *order_cols: str, out_col: str = "idx") -> DataFrame:
    """W1 for the keys alone: ``order_cols + (out_col)``, one row per row of ``df`` (equal keys have
    consecutive ranks). The checkpoint keeps the sorted partitions, which both passes count."""
    ensure_checkpoint_dir(df.sparkSession)
    keys = df.select(*order_cols).repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).checkpoint()
    keys = keys.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    # a task numbers its rows from (partition << 33) on, in the order that it holds them
    own = keys.withColumn("_m", F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33))
    counts = own.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return own.join(F.broadcast(offsets), "_p").select(*order_cols, (F.col("_m") + F.col("_off")).cast("bigint").alias(out_col))


def dense_index(df: DataFrame, order_col: str = "seq", out_col: str = "idx") -> DataFrame:
    """Add ``out_col`` = 0-based rank of ``order_col`` (a unique key of any type and spacing). For
    narrow rows, such as keys: they are joined with the ranks by key."""
    return df.join(ranked_keys(df, order_col, out_col=out_col), order_col)


def part_starts(df: DataFrame, order_col: str = "seq", threshold: int = PART_THRESHOLD) -> list:
    """The key of the first row of part 2, 3, ...: one value per part to the driver."""
    ranks = ranked_keys(df, order_col)
    # rows 0..threshold are part 1, then threshold each
    first = (F.col("idx") > threshold) & ((F.col("idx") - 1) % threshold == 0)
    return [r[0] for r in ranks.where(first).orderBy("idx").select(order_col).collect()]


def located_parts(df: DataFrame, order_col: str = "seq", threshold: int = PART_THRESHOLD, starts: list | None = None) -> DataFrame:
    """W2 in place: ``part`` of every row from the parts' first keys (``starts``, where the caller has them),
    with no exchange of rows. The keys reach the tasks as one value (an array with one key per
    ``threshold`` rows)."""
    starts = part_starts(df, order_col, threshold) if starts is None else starts
    if not starts:
        return df.withColumn("part", F.lit(1).cast("bigint"))
    kind = df.schema[order_col].dataType
    local = df.sparkSession.createDataFrame([(starts,)], f"starts array<{kind.simpleString()}>").scalar()
    return df.withColumn("_starts", local).withColumn("part", _upper_bound(F.col("_starts"), F.col(order_col)) + 1).drop("_starts")


def _upper_bound(starts, key):
    """How many of the sorted ``starts`` are at most ``key``, by halving the range 32 times or until
    it is empty: the built-ins' aggregate over a fixed sequence of steps."""
    size = F.size(starts)
    state = F.struct(F.lit(0).alias("lo"), size.alias("hi"))

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        below = F.get(starts, mid) <= key
        lo = F.when(open_ & below, mid + 1).otherwise(acc["lo"])
        hi = F.when(open_ & ~below, mid).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1), state, halve, lambda a: a["lo"].cast("bigint"))


def number_records(records: DataFrame, out_col: str = "seq") -> DataFrame:
    """W1 over several files: ``seq`` replaced by one unique, dense number 0..n-1 in (file, block,
    seq) order.

    ``records`` must be a written table whose ``seq`` has no gaps inside a (source_file, block). A
    record's number is its distance from the first of its block plus the records of all blocks
    before, from one row per input split; no record is sorted, or moved where there are at most
    ``MAX_BLOCKS`` blocks.
    """
    keys = ["source_file", "block"]
    per_block = records.groupBy(*keys).agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row per input split
    offsets = per_block.select(*keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    numbered = records.join(sent_if_few(offsets, per_block), keys).withColumn(out_col, (F.col("seq") + F.col("_off")).cast("bigint"))
    return numbered.drop("_off", "block")


def sent_if_few(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``offsets`` of ``blocks``, broadcast where there are at most ``MAX_BLOCKS``."""
    return F.broadcast(offsets) if blocks.limit(MAX_BLOCKS + 1).count() <= MAX_BLOCKS else offsets


def part_number(idx_col: str = "idx", threshold: int = PART_THRESHOLD):
    """Staged part of a 0-based row index: rows 0..threshold are part 1, then threshold each."""
    return F.greatest(F.lit(1), F.ceil(F.col(idx_col) / F.lit(threshold))).cast("bigint")


def with_parts(df: DataFrame, order_col: str = "seq", threshold: int = PART_THRESHOLD) -> DataFrame:
    """W1 + W2: add ``idx`` and ``part`` (for narrow rows; ``located_parts`` moves no row)."""
    return dense_index(df, order_col).withColumn("part", part_number("idx", threshold))


def part_counts(parts: DataFrame, part_col: str = "part") -> DataFrame:
    """A6 per part + W4: ``(part, n_docs, running_total)``; the window runs over one row per part."""
    per = parts.groupBy(part_col).agg(F.count(F.lit(1)).alias("n_docs"))
    upto = Window.orderBy(part_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("running_total", F.sum("n_docs").over(upto).cast("bigint"))


def first_n(df: DataFrame, n: int, *order_cols: str) -> DataFrame:
    """L1 / L2: the first ``n`` records in read order (a top-n per task, then a merge)."""
    return df.orderBy(*order_cols).limit(n)
