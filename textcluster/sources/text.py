"""Delimited text records.

A record ends with its id line (a line starting ``PMID``), which belongs to the record; text after
the last id line is not a record. ``read_text_records`` reads each file whole (one task per file);
``read_text_lines`` numbers the lines of splittable text for line-based processing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.counts import sent_if_few
from ..session import ensure_checkpoint_dir
from .files import TEXT_EXTENSIONS, with_source

# Fixed value: one record = shortest text ending with a line that starts with the id tag.
RECORD_PATTERN = r"(?ms)(.*?^PMID[^\n]*)"
#: bytes of a record's lines in one split from which on they are exchanged line by line
LONG = 16 << 20


def split_records(text_col) -> "F.Column":
    """S3 on a whole text: the records in order."""
    return F.regexp_extract_all(text_col, F.lit(RECORD_PATTERN), F.lit(1))


def read_text_records(spark: SparkSession, path, extensions=TEXT_EXTENSIONS, on_bad: str = "skip") -> DataFrame:
    """``(source_file, seq, record)``, ``seq`` = 0-based record number within its file."""
    raw = spark.read.option("encoding", "UTF-8").text(path, wholetext=True)
    raw = with_source(raw.select("value", "_metadata"), extensions, on_bad, path)
    return raw.select("source_file", F.posexplode(split_records(F.col("value"))).alias("seq", "record")).select(
        "source_file", F.col("seq").cast("bigint").alias("seq"), "record"
    )


def read_text_lines(spark: SparkSession, path, extensions=TEXT_EXTENSIONS, on_bad: str = "skip") -> DataFrame:
    """``(source_file, block, line_key, line)``. Lines are ordered by (file, block, line_key):
    ``block`` is the start offset of the input split, ``line_key`` increases within a split."""
    raw = spark.read.text(path)
    raw = with_source(raw.select("value", "_metadata"), extensions, on_bad, path)
    return raw.select(
        "source_file",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_key"),
        F.col("value").alias("line"),
    )


def _cut(batches):
    """Inside one scan partition the lines of each (file, split) arrive contiguously and in order: cuts
    them into records as they come. Gives ``("records", key, n, texts)``, whole records of a split from its
    ``n``-th on (``n`` is an array); ``("lines", key, n, line_keys, lines)``, lines of the split's ``n``-th record
    where it may begin or end in another split, or has over ``LONG`` bytes in this one; and
    ``("count", key, n)``, the id lines of a split. Not more than ``LONG`` bytes and a batch are held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    key, done, held, size, loose = None, 0, [], 0, True

    def rest():
        for line_keys, lines in held:
            yield "lines", key, done, line_keys, lines

    for b in batches:
        b = b.filter(pc.is_valid(b.column("line")))
        if not b.num_rows:
            continue
        files = b.column("source_file").to_numpy(zero_copy_only=False)
        blocks = b.column("block").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for lo, hi in zip([0, *starts.tolist()], [*starts.tolist(), b.num_rows]):
            if key != (files[lo], blocks[lo]):
                if key is not None:
                    yield from rest()
                    yield "count", key, done
                key, done, held, size, loose = (files[lo], blocks[lo]), 0, [], 0, True
            line_keys, lines = b.column("line_key").slice(lo, hi - lo), b.column("line").slice(lo, hi - lo)
            ends = np.flatnonzero(pc.starts_with(lines, "PMID").to_numpy(zero_copy_only=False)) + 1
            if loose:
                stop = int(ends[0]) if len(ends) else len(lines)
                yield "lines", key, done, line_keys.slice(0, stop), lines.slice(0, stop)
                line_keys, lines = line_keys.slice(stop), lines.slice(stop)
                if not len(ends):
                    continue
                done, loose, ends = done + 1, False, ends[1:] - stop
            if len(lines):
                held.append((line_keys, lines))
                size += pc.sum(pc.binary_length(lines)).as_py() + len(lines)
            if len(ends):
                line_keys, lines = (pa.concat_arrays(list(x)) for x in zip(*held))
                ends = ends + (len(lines) - len(held[-1][1]))
                first = np.concatenate([[0], ends[:-1]])
                upto = np.concatenate([[0], np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
                long = upto[ends] - upto[first] > LONG
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), lines)
                texts = pc.binary_join(lists, "\n")
                n = done + np.arange(len(ends))
                yield "records", key, n[~long], texts.filter(pa.array(~long))
                for i in np.flatnonzero(long):
                    yield "lines", key, int(n[i]), line_keys.slice(first[i], ends[i] - first[i]), lines.slice(first[i], ends[i] - first[i])
                done += len(ends)
                held = [(line_keys.slice(ends[-1]), lines.slice(ends[-1]))]
                size = int(upto[-1] - upto[ends[-1]])
            if size > LONG:
                yield from rest()
                held, size, loose = [], 0, True
    if key is not None:
        yield from rest()
        yield "count", key, done


def _whole_records(batches):
    import numpy as np
    import pyarrow as pa

    for kind, key, *found in _cut(batches):
        if kind == "records" and len(found[0]):
            n, texts = found
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(n), pa.string()), pa.array(np.full(len(n), key[1], np.int64)), pa.array(n.astype(np.int64)), texts],
                names=["source_file", "block", "local", "record"],
            )


def _other_lines(batches):
    """Lines of the records that are not whole in a split, and a row with the split's number of id lines."""
    import numpy as np
    import pyarrow as pa

    for kind, key, n, *found in _cut(batches):
        if kind == "records" or kind == "lines" and not len(found[0]):
            continue
        line_keys, lines = found or (pa.array([None], pa.int64()), pa.array([None], pa.string()))
        own = np.full(len(lines), n, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]] * len(lines), pa.string()), pa.array(np.full(len(lines), key[1], np.int64)), line_keys, lines,
                pa.array(own), pa.array(own, mask=np.full(len(lines), kind == "lines")),
            ],
            names=["source_file", "block", "line_key", "line", "local", "n_id"],
        )


def records_from_lines(lines: DataFrame) -> DataFrame:
    """S3 for files too large to read whole: ``(source_file, seq, record)`` from numbered lines.

    A line's record number is the count of id lines before it in its file, taken in two levels so
    that no task holds a whole file: inside each split where the lines already are, plus the split's
    offset = id lines in earlier splits of the file (one row per split). A record that stands whole
    in a split is joined there and its lines are not exchanged. Only the others' lines (before a split's first
    id line, behind its last, or of a record of over ``LONG`` bytes) are grouped per record and joined in
    order; trailing text with no id line is not a record.
    """
    ensure_checkpoint_dir(lines.sparkSession)
    other = lines.mapInArrow(
        _other_lines, "source_file string, block bigint, line_key bigint, line string, local bigint, n_id bigint"
    ).checkpoint()
    per_split = other.where("n_id IS NOT NULL").select("source_file", "block", "n_id")
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select("source_file", "block", F.coalesce(F.sum("n_id").over(before), F.lit(0)).alias("off"))
    # lines behind a file's last id line belong to no record: they go before any grouping
    records = per_split.groupBy("source_file").agg(F.sum("n_id").alias("n_records"))
    offsets = sent_if_few(offsets.join(records, "source_file"), per_split)
    seq = (F.col("off") + F.col("local")).cast("bigint").alias("seq")
    numbered = other.where("n_id IS NULL").join(offsets, ["source_file", "block"])
    grouped = numbered.select("source_file", seq, "block", "line_key", "line", "n_records").where("seq < n_records").groupBy("source_file", "seq").agg(
        F.sort_array(F.collect_list(F.struct("block", "line_key", "line"))).alias("ls")
    )
    joined = grouped.select(
        "source_file", "seq", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("record")
    )
    whole = lines.mapInArrow(_whole_records, "source_file string, block bigint, local bigint, record string")
    return whole.join(offsets, ["source_file", "block"]).select("source_file", seq, "record").unionByName(joined)


def read_text_records_by_lines(spark: SparkSession, path, extensions=TEXT_EXTENSIONS, on_bad: str = "skip") -> DataFrame:
    """S2 + S3 over splittable line reads: same records as ``read_text_records`` (without the final
    line break), for files of any size."""
    return records_from_lines(read_text_lines(spark, path, extensions, on_bad))
