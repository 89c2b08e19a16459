"""Staged record sets (K1, K2) and their replay.

Staged data is Parquet. K1 keeps the exact part numbers (W2) as a partition column, so a part is a
folder and a replay can read any subset of parts; ``max_records_per_file`` bounds file size. For a replay
file by file the part can be a plain column instead, so that files are made by size and not one per part
and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import PART_THRESHOLD, located_parts, part_starts

#: files that a replayable staging aims at while they hold fewer than ``PART_THRESHOLD`` records each
REPLAY_FILES = 48
ROW_GROUP = 8 << 20  # bytes, so that the tasks of a micro-batch share its file


def write_parts(
    df: DataFrame, path: str, threshold: int = PART_THRESHOLD, order_col: str = "seq", mode: str = "overwrite", folders: bool = True
) -> None:
    """K1: one folder per part of ``threshold`` records (part 1 has one more, see W2). Records are
    written where they were read: only their order keys are exchanged, to find where parts begin.

    With ``folders=False`` the same rows go to files that share parts (``part`` is a column in them): a
    replay file by file then takes about ``REPLAY_FILES`` micro-batches, or one per ``PART_THRESHOLD``
    records where there are more, and not parts x tasks."""
    if folders:
        located_parts(df, order_col, threshold).write.mode(mode).option("maxRecordsPerFile", threshold).partitionBy("part").parquet(path)
        return
    starts = part_starts(df, order_col, threshold)
    share = -(-(len(starts) + 1) * threshold // REPLAY_FILES)
    located_parts(df, order_col, threshold, starts).write.mode(mode).option(
        "maxRecordsPerFile", max(threshold, min(share, PART_THRESHOLD))
    ).option("parquet.block.size", ROW_GROUP).parquet(path)


def write_per_source(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: one folder per input file, named by its whole path so that equal names in two folders stay
    apart. Rows of a file meet in the tasks that write its folder."""
    named = df.withColumn("source_name", F.regexp_replace(F.regexp_replace("source_file", "^[a-z]+:/+", ""), "[/=]", "__"))
    named.write.mode(mode).partitionBy("source_name").parquet(path)


def read_staged(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of staged folders or parts (``part`` typed as written, bigint)."""
    if len(paths) > 1:
        df = spark.read.option("basePath", _base(paths[0])).parquet(*paths)
    else:
        df = spark.read.parquet(paths[0])
    return _typed(df)


def _typed(df: DataFrame) -> DataFrame:
    # Partition discovery infers small integers as int; parts are bigint everywhere else.
    return df.withColumn("part", F.col("part").cast("bigint")) if "part" in df.columns else df


def _base(p: str) -> str:
    return p.rsplit("/part=", 1)[0] if "/part=" in p else p


def staged_exists(spark: SparkSession, path: str) -> bool:
    """A completely written folder is present (its writer has left the success marker)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker))


def load_or_stage(spark: SparkSession, path: str, build, threshold: int = PART_THRESHOLD) -> DataFrame:
    """Replay staged records when present, else build them (``build()`` -> DataFrame), stage, replay."""
    if not staged_exists(spark, path):
        write_parts(build(), path, threshold)
    return read_staged(spark, path)
