"""Line deduplication with DataFrame operations only.

Line hashes are range-partitioned with a secondary sort by document and position; each partition is
streamed once to find where a new document starts holding a line. The result is not text but a
compressed keep bitmap per document: a map from a 64-line word number to the bits of its dropped
lines, holding only words with a dropped line.

Defined results: a null or empty text is one empty line; a null id counts as one document that sorts
below every id; repeated rows with the same id are one document when holders are counted, and each
row loses the same lines; lines below ``min_chars`` are never keys; an empty table gives an empty
result. Only the id and text columns are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MIN_LONG, ascii_lower, fingerprint, written

STRIP = " \t\n\x0b\f\r"
#: a line held by a third of all documents is dealt over this many streams
SALTS = 64
KEY = ["h1", "h2", "salt"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("__ld_doc"), F.xxhash64(text).alias("__ld_text")]


def line_holders(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """One row per line that can be a key: (h1, h2, salt, doc, text_hash, pos)."""
    lines = docs.select(*_rows(docs, id_col, text_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    h1, h2 = fingerprint(F.col("key"))
    return keyed.select(
        h1.alias("h1"), h2.alias("h2"), F.pmod(F.xxhash64("__ld_doc"), F.lit(SALTS)).cast("int").alias("salt"),
        F.col("__ld_doc").alias("doc"), F.col("__ld_text").alias("text_hash"), "pos",
    )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, text_hash, dropped, n_dropped) for documents that lose a line: keys in at least
    ``min_docs`` documents stay only in the largest id that holds them."""
    held = written(line_holders(docs, id_col, text_col, min_chars), "line-holders")
    stream = held.repartitionByRange(*KEY).sortWithinPartitions(*KEY, F.desc("doc"), "pos")
    # the range partitioning and the sort already suit this window and this grouping: no exchange between
    before = F.lag("doc").over(Window.partitionBy(*KEY).orderBy(F.desc("doc"), "pos"))
    firsts = stream.withColumn("first", F.coalesce((before != F.col("doc")).cast("int"), F.lit(1)))
    per_stream = firsts.groupBy(*KEY).agg(F.sum("first").alias("n"), F.max("doc").alias("last"))
    repeated = (
        per_stream.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("last").alias("keeper"), F.collect_list("salt").alias("salts"))
        .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper", F.explode("salts").alias("salt"))
    )
    lost = held.join(repeated, KEY).filter(F.col("doc") != F.col("keeper"))
    word, bit = (F.col("pos") / 64).cast("int"), F.expr("shiftleft(1L, pos % 64)")
    words = lost.groupBy("doc", "text_hash", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"), F.sum(F.bit_count("bits")).alias("n_dropped")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns plus ``__ld_lines``, ``__ld_dropped`` (line counts) and ``__ld_kept``
    (the text without its dropped lines; a null text stays null, a text that loses every line is empty)."""
    bits = bitmaps.select(F.col("doc").alias("__ld_doc"), F.col("text_hash").alias("__ld_text"), F.col("dropped").alias("__ld_bits"), F.col("n_dropped").alias("__ld_n"))
    doc, text = _rows(docs, id_col, text_col)
    joined = docs.withColumns({"__ld_doc": doc, "__ld_text": text}).join(bits, ["__ld_doc", "__ld_text"], "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    word = lambda i: F.coalesce(F.element_at("__ld_bits", (i / 64).cast("int")), F.lit(0).cast("long"))
    kept = F.array_join(F.filter(lines, lambda line, i: F.getbit(word(i), (i % 64).cast("int")) == 0), "\n")
    return joined.select(
        *[F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias("__ld_lines"), F.coalesce("__ld_n", F.lit(0)).cast("long").alias("__ld_dropped"),
        F.when(F.col("__ld_bits").isNull(), F.col(text_col)).otherwise(kept).alias("__ld_kept"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
