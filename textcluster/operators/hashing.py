"""Signed hashing vectors whose every weight can be recomputed elsewhere.

A term's bucket is the first four bytes of its MD5 (UTF-8, big-endian) modulo the width; the lowest bit of
the fifth byte set makes its counts negative, so that terms that share a bucket cancel on average
instead of adding up. A document's vector holds its signed counts divided by their norm: a stateless
step, alike on tables and on streams. The document frequency of a bucket counts the documents with an
entry other than 0; ``bucket_df`` adds it up in each task first, so at most ``width`` + 1 rows a task are
shuffled, and its tables add up over batches.

Null and empty texts give empty vectors and count as documents.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import flatten_vectors, in_slices, list_sizes, vector_sizes
from .tokens import add_tokens

HASH_FEATURES = 1 << 20
#: the row of ``bucket_df`` that counts the documents
ALL = -1
DF_TABLE = "bucket int, df bigint"


#: MD5: turns, constants and mixes of its 64 steps; the longest text that fits one block with its length; texts at a time
TURNS = ([7, 12, 17, 22] * 4, [5, 9, 14, 20] * 4, [4, 11, 16, 23] * 4, [6, 10, 15, 21] * 4)
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MIXES = (lambda b, c, d: d ^ (b & (c ^ d)), lambda b, c, d: c ^ (d & (b ^ c)), lambda b, c, d: b ^ c ^ d, lambda b, c, d: c ^ (b | ~d))
ONE_BLOCK, AT_A_TIME = 55, 1 << 13


def codes(terms, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, signs) of terms, a list or an Arrow array without nulls."""
    import pyarrow as pa

    terms = pa.array(terms, pa.string()) if isinstance(terms, list) else terms.cast(pa.string())
    first, fifth = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for at in range(0, len(terms), AT_A_TIME):
        own = terms.slice(at, AT_A_TIME)
        first[at : at + AT_A_TIME], fifth[at : at + AT_A_TIME] = _md5(own)
    return first % width, 1.0 - 2.0 * (fifth & 1)


def _md5(terms) -> tuple[np.ndarray, np.ndarray]:
    """(first four bytes of the MD5 as a big-endian number, a number with the lowest bit of the fifth), all
    texts of one block at once."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    size = np.diff(offsets)
    short = np.flatnonzero(size <= ONE_BLOCK)
    length, n = size[short], len(short)
    blocks = np.zeros((n, 64), np.uint8)
    begins = np.cumsum(length) - length
    of = np.repeat(np.arange(n), length)
    column = np.arange(len(of)) - begins[of]
    text = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    blocks[of, column] = text[offsets[short][of] + column]
    blocks[np.arange(n), length] = 0x80
    words = np.ascontiguousarray(blocks.view("<u4").T).astype(np.uint32)
    words[14] = length * 8
    some = words.any(axis=1)
    start = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        kind, step = divmod(i, 16)
        word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
        mixed = MIXES[kind](b, c, d) + a + np.uint32(SINES[i])
        if some[word]:
            mixed += words[word]
        turn = TURNS[kind][step]
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(turn)) | (mixed >> np.uint32(32 - turn)))
    first, fifth = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    first[short], fifth[short] = (a + start[0]).byteswap(), b + start[1]
    for i in np.flatnonzero(size > ONE_BLOCK):
        digest = hashlib.md5(terms[int(i)].as_py().encode(), usedforsecurity=False).digest()
        first[i], fifth[i] = int.from_bytes(digest[:4], "big"), digest[4]
    return first, fifth


def _divided(rows: np.ndarray, val: np.ndarray, n: int, norm: str) -> np.ndarray:
    size = np.bincount(rows, np.abs(val), n) if norm == "l1" else np.sqrt(np.bincount(rows, val * val, n))
    return val / size[rows]


def _sparse(n: int, rows: np.ndarray, idx: np.ndarray, val: np.ndarray, width: int):
    """An Arrow column of sparse ML vectors from entries sorted by row and index."""
    import pyarrow as pa

    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (idx.astype(np.int32), val.astype(np.float64))]
    head = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32))]
    return pa.StructArray.from_arrays([*head, *lists], ["type", "size", "indices", "values"])


def _counts_fn(cols: list[str], width: int, norm: str, out_col: str):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in in_slices(batches, list_sizes("__tokens")):
            lists = b.column("__tokens")
            rows = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            coded = pc.list_flatten(lists).dictionary_encode()
            buckets, signs = codes(coded.dictionary, width)
            at = coded.indices.to_numpy(zero_copy_only=False)
            keys, where = np.unique(rows * width + buckets[at], return_inverse=True)
            val = np.bincount(where, signs[at], len(keys))
            keys, val = keys[val != 0], val[val != 0]
            val = _divided(keys // width, val, b.num_rows, norm)
            vectors = _sparse(b.num_rows, keys // width, keys % width, val, width)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], vectors], names=[*cols, out_col])

    return run


def signed_counts(
    docs: DataFrame, width: int = HASH_FEATURES, norm: str = "l1", keep=("doc_id", "permalink"), text_col: str = "content",
    stop_words=None, out_col: str = "features",
) -> DataFrame:
    """The ``keep`` columns and each document's signed counts over ``width`` buckets, divided by their norm."""
    if norm not in ("l1", "l2"):
        raise ValueError("norm must be one of ('l1', 'l2')")
    if width < 1:
        raise ValueError("width must be positive")
    cols = [c for c in keep if c in docs.columns]
    tok = add_tokens(docs.select(*cols, F.col(text_col).alias("__text")), "__text", "__tokens", stop_words)
    schema = T.StructType([*[docs.schema[c] for c in cols], T.StructField(out_col, VectorUDT())])
    return tok.select(*cols, "__tokens").mapInArrow(_counts_fn(cols, width, norm, out_col), schema)


def _df_fn(width: int, features_col: str):
    def run(batches):
        import pyarrow as pa

        docs, df = 0, np.zeros(width, np.int64)
        for b in in_slices(batches, vector_sizes(features_col)):
            n, _, idx, val = flatten_vectors(b.column(features_col))
            docs += n
            np.add.at(df, idx[val != 0], 1)
        at = np.flatnonzero(df)
        rows = [pa.array(np.concatenate([[ALL], at]).astype(np.int32)), pa.array(np.concatenate([[docs], df[at]]))]
        yield pa.RecordBatch.from_arrays(rows, names=["bucket", "df"])

    return run


def bucket_df(vectors: DataFrame, width: int, features_col: str = "features") -> DataFrame:
    """``(bucket, df)``: documents with an entry in the bucket; bucket -1 counts all documents. At most
    ``width`` + 1 rows; tables of disjoint documents add up (``add_df``)."""
    rows = vectors.select(features_col).mapInArrow(_df_fn(width, features_col), DF_TABLE)
    return rows.groupBy("bucket").agg(F.sum("df").alias("df"))


def add_df(a: DataFrame, b: DataFrame) -> DataFrame:
    """The document frequencies of both tables' documents together."""
    return a.unionByName(b).groupBy("bucket").agg(F.sum("df").alias("df"))


def idf_of(df: DataFrame, width: int) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of every bucket, on the driver: ``width`` doubles, whatever the documents."""
    rows = df.toArrow()
    at, n = rows["bucket"].to_numpy(), rows["df"].to_numpy()
    out = np.zeros(width)
    out[at[at != ALL]] = n[at != ALL]
    return np.log((1.0 + n[at == ALL].sum()) / (1.0 + out)) + 1.0


def entries(vectors: DataFrame, id_col: str = "doc_id", features_col: str = "features") -> DataFrame:
    """``(id_col, bucket, weight)`` of the stored entries, read off each row."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in in_slices(batches, vector_sizes(features_col)):
            _, rows, idx, val = flatten_vectors(b.column(features_col))
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(rows)), pa.array(idx.astype(np.int64)), pa.array(val)], names=[id_col, "bucket", "weight"])

    return vectors.select(id_col, features_col).mapInArrow(run, f"{id_col} {id_type}, bucket bigint, weight double")
