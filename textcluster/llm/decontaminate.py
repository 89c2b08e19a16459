"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over documents.

A word is a run of ASCII letters (lower-cased), digits and non-ASCII characters. An item gives all
its windows of ``width`` words, a shorter one a single window of all its words. Documents are scanned
with rolling window hashes; each hash found in the set is verified against the window's words.

The window set is broadcast only if its measured size is at most ``max_bytes``; beyond that the
windows of documents and items meet in a shuffled join (``joined_scan``) with the same results.

Defined results: null or empty texts have no words and are clean; items without words or without an
id give no window; repeated items count once per id; repeated documents are scanned each for itself,
also where rows share an id or have none;
empty tables give clean documents or no rows. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,starts:array<int>,ends:array<int>>"
FILTER_BITS = 20


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = scan.runs(data, offsets, scan.ALNUM[data])
    return starts, ends, first, scan.run_hashes(data, starts, ends)


def _windows_udf(width: int, short: bool):
    """array<struct<hash, pos, words>> of a text: all its windows, and with ``short`` the whole of a shorter text."""

    @F.arrow_udf("array<struct<hash:bigint,length:int,pos:int,words:binary>>")
    def windows(column: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in scan.texts(column):
            _, _, first, hashes = _words(data, offsets)
            low = scan.LOWER[data].tobytes()
            for i in range(len(offsets) - 1):
                own, n = WORDS.findall(low[offsets[i] : offsets[i + 1]]), int(first[i + 1] - first[i])
                size = width if n >= width else n if short else 0
                found = scan.window_hashes(hashes[first[i] : first[i + 1]], size).view(np.int64).tolist() if size else []
                out.append([{"hash": h, "length": size, "pos": p, "words": b" ".join(own[p : p + size])} for p, h in enumerate(found)])
        return pa.array(out, pa.list_(pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("pos", pa.int32()), ("words", pa.binary())])))

    return windows


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(item, hash, length, words), distinct."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("body")).filter("item is not null and body is not null")
    return rows.select("item", F.inline(_windows_udf(width, True)("body"))).select("item", "hash", "length", "words").distinct()


def window_set(windows: DataFrame, max_bytes: int) -> dict | None:
    """{length: {words: items}} on the driver, or None if it would take more than ``max_bytes``."""
    size = windows.agg(F.sum(F.octet_length("words") + 100)).first()[0] or 0
    if size > max_bytes:
        return None
    found: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    for row in windows.select("length", "words", "item").toLocalIterator():
        found[row[0]][bytes(row[1])].append(row[2])
    return {n: dict(by_words) for n, by_words in found.items()}


def _tables(found: dict) -> dict:
    """{length: (sorted hashes, filter bits)}: hashes are made again from the words, as in the scan."""
    out = {}
    for length, by_words in found.items():
        hashes = np.empty(len(by_words), np.uint64)
        for i, words in enumerate(by_words):
            data = np.frombuffer(words, np.uint8)
            hashes[i] = scan.window_hashes(_words(data, np.array([0, len(data)]))[3], length)[0]
        hashes.sort()
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        out[length] = (hashes, bits)
    return out


def scan_column(spark, found: dict, text: Column) -> Column:
    """The ``FOUND`` struct of a text against a broadcast window set."""
    shared = spark.sparkContext.broadcast((found, _tables(found)))

    @F.arrow_udf(FOUND)
    def search(column: pa.Array) -> pa.Array:
        sets, tables = shared.value
        n_words, n_hit, items, begins, stops = [], [], [], [], []
        for _, data, offsets in scan.texts(column, 1 << 20):
            starts, ends, first, hashes = _words(data, offsets)
            count = np.diff(first)
            last = np.repeat(first[1:], count)
            edge = np.zeros(len(starts) + 1, np.int32)
            by_doc: dict[int, set] = defaultdict(set)
            low = None
            for length, (known, bits) in tables.items():
                found_at = scan.window_hashes(hashes, length)
                at = np.flatnonzero(bits[(found_at >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                at = at[at + length <= last[at]]
                place = np.minimum(np.searchsorted(known, found_at[at]), len(known) - 1)
                at = at[known[place] == found_at[at]]
                if not len(at):
                    continue
                low = low if low is not None else scan.LOWER[data].tobytes()
                owner = np.searchsorted(first, at, "right") - 1
                for i, doc in zip(at.tolist(), owner.tolist(), strict=True):
                    own = sets[length].get(b" ".join(WORDS.findall(low[starts[i] : ends[i + length - 1]])))
                    if own:
                        edge[i] += 1
                        edge[i + length] -= 1
                        by_doc[doc].update(own)
            hit = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_words += count.tolist()
            n_hit += (total[first[1:]] - total[first[:-1]]).tolist()
            points = scan.code_points(data) if by_doc else None
            for doc in range(len(count)):
                items.append(sorted(by_doc[doc]) if doc in by_doc else [])
                a, b = _spans(hit[first[doc] : first[doc + 1]], starts[first[doc] : first[doc + 1]], ends[first[doc] : first[doc + 1]], points, offsets[doc]) if doc in by_doc else ([], [])
                begins.append(a)
                stops.append(b)
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(begins, kind), pa.array(stops, kind)],
            ["n_words", "n_hit", "items", "starts", "ends"],
        )

    return search.asNondeterministic()(text)


def _spans(hit, starts, ends, points, origin):
    """Code point spans of runs of hit words."""
    flag = np.concatenate([[0], hit.view(np.int8), [0]])
    a, b = np.flatnonzero(np.diff(flag) == 1), np.flatnonzero(np.diff(flag) == -1) - 1
    return (points[starts[a]] - points[origin]).tolist(), (points[ends[b]] - points[origin]).tolist()


def joined_scan(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, text_hash, n_words, n_hit, items, at), one row for each id and text: the same counts without
    a broadcast, by joining window hashes; ``at`` lists the hit words' places."""
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most ``width`` numbers
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("body"))
    counted = rows.select("doc", "text_hash", scan_column(docs.sparkSession, {}, F.col("body"))["n_words"].alias("n_words")).distinct()
    found = None
    for length in lengths:
        own = rows.select("doc", "text_hash", F.inline(_windows_udf(length, False)("body"))).join(windows.select("hash", "words", "item"), ["hash", "words"])
        own = own.select("doc", "text_hash", "pos", "length", "item")
        found = own if found is None else found.unionByName(own)
    none = F.array().cast("array<bigint>"), F.array().cast("array<int>")
    if found is None:
        return counted.select("doc", "text_hash", "n_words", F.lit(0).cast("long").alias("n_hit"), none[0].alias("items"), none[1].alias("at"))
    hits = found.groupBy(F.col("doc").alias("d"), F.col("text_hash").alias("t")).agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.collect_set(F.struct("pos", "length")).alias("places")
    )
    places = F.flatten(F.transform("places", lambda x: F.sequence(x["pos"], x["pos"] + x["length"] - 1)))
    hits = hits.select("d", "t", "items", F.sort_array(F.array_distinct(places)).alias("at"))
    out = counted.join(hits, [counted.doc.eqNullSafe(hits.d), counted.text_hash == hits.t], "left")
    out = out.select("doc", "text_hash", "n_words", F.coalesce("items", none[0]).alias("items"), F.coalesce("at", none[1]).alias("at"))
    return out.select("doc", "text_hash", "n_words", F.size("at").cast("long").alias("n_hit"), "items", "at")


def _place_udf():
    """Code point spans of the runs of words at the given places of a text."""

    @F.arrow_udf("struct<starts:array<int>,ends:array<int>>")
    def place(column: pa.Array, at: pa.Array) -> pa.Array:
        begins, stops = [], []
        for i, data, offsets in scan.texts(column):
            starts, ends, first = scan.runs(data, offsets, scan.ALNUM[data])
            points = scan.code_points(data)
            for doc in range(len(offsets) - 1):
                own = slice(first[doc], first[doc + 1])
                hit = np.zeros(first[doc + 1] - first[doc], bool)
                hit[at[i + doc].as_py()] = True
                a, b = _spans(hit, starts[own], ends[own], points, offsets[doc])
                begins.append(a)
                stops.append(b)
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(begins, kind), pa.array(stops, kind)], ["starts", "ends"])

    return place.asNondeterministic()


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = 10, max_bytes: int = 64 << 20, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``__dc_n_words``, ``__dc_n_hit``, ``__dc_items`` and the spans ``__dc_starts``,
    ``__dc_ends`` (code points) of the hit words."""
    windows = item_windows(items, width=width)
    found = window_set(windows, max_bytes)
    if found is None:
        part = joined_scan(docs, windows, id_col, text_col, width)
        part = part.select(F.col("doc").alias("__dc_doc"), F.col("text_hash").alias("__dc_hash"), *[F.col(c).alias(f"__dc_{c}") for c in ("n_words", "n_hit", "items", "at")])
        own = docs.withColumn("__dc_key", F.xxhash64(F.col(text_col)))
        joined = own.join(part, own[id_col].eqNullSafe(part["__dc_doc"]) & (own["__dc_key"] == part["__dc_hash"]))
        marked = joined.withColumn("__dc", _place_udf()(F.col(text_col), F.col("__dc_at")))
        counts = [F.col(f"__dc_{c}") for c in ("n_words", "n_hit", "items")]
        return marked.select(*[F.col(c) for c in docs.columns], *counts, *[F.col(f"__dc.{c}").alias(f"__dc_{c}") for c in ("starts", "ends")])
    marked = docs.withColumn("__dc", scan_column(docs.sparkSession, found, F.col(text_col)))
    return marked.select(*[F.col(c) for c in docs.columns], *[F.col(f"__dc.{c}").alias(f"__dc_{c}") for c in ("n_words", "n_hit", "items", "starts", "ends")])


def remove_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = 10, **more) -> DataFrame:
    """``docs`` without those that hold any window of an item."""
    return mark(docs, items, text_col, width, **more).filter("__dc_n_hit = 0").select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = 10, max_bytes: int = 64 << 20, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the hit spans cut out of their texts."""
    marked = mark(docs, items, text_col, width, max_bytes, id_col)
    text = F.col(text_col)
    begin = F.concat(F.array(F.lit(0)), F.col("__dc_ends"))
    end = F.concat(F.col("__dc_starts"), F.array(F.length(text)))
    pieces = F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"]))
    cut = F.when(F.col("__dc_n_hit") > 0, F.array_join(pieces, "")).otherwise(text)
    return marked.withColumn("__dc_text", cut).select(*[F.col("__dc_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])
