"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes cuts every text wherever it falls below a threshold, between
characters only. Cuts depend on the 32 bytes before them alone, so an insertion moves no cut behind
it. Chunks of at least ``SEED_BYTES`` are looked up by 128-bit digest; the first place that holds a chunk
(smallest document, then position) keeps it, and in all other documents it is a repeat. Repeats that
follow each other both here and in their keeper form a run, and a run is grown to both sides as far as
the two texts agree, at most ``REACH`` code points, which also covers the shorter chunks in between;
runs that then meet are one span. A span thus stands as a whole in the one document that it names.
Spans of at least ``min_chars`` code points are returned.

Chunks go through one shuffle; a bitmap of the repeated digests (fixed size) keeps the others out of
the second. Texts are read again only at the ends of the runs.

Defined results: null and empty texts have no chunks; repeats inside the keeping document stay; a
null id sorts below all ids and is returned as null; rows that repeat an id keep their own spans and
equal rows give one; an empty table gives no rows; only the id and text columns are read. Spans of
different keepers may overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scan
from .common import MIN_LONG, bitmap, lookup, maybe_in, total, written

GEAR = scan.keyed(101, 256).astype(np.uint32)
SECOND = scan.keyed(202, 256)
#: bytes between cuts on average, most bytes of a chunk, least bytes of a chunk that is looked up
MEAN_BYTES, MAX_BYTES, SEED_BYTES = 24, 512, 20
REACH, MIN_SPAN = 128, 64
KEY, TEXT = ["h1", "h2"], ["doc", "text_hash"]
KEEPER = ["kept_doc", "kept_hash"]


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """hash[i] = sum of GEAR[data[i - j]] << j over the last 32 bytes of the same text, by doubling."""
    out = GEAR[data]
    begin, end = offsets[:-1, None], offsets[1:, None]
    for step in (1, 2, 4, 8, 16):
        more = out.copy()
        more[step:] += out[:-step] << np.uint32(step)
        head = begin + np.arange(step)
        head = head[head < end]
        more[head] = out[head]  # nothing of the text before
        out = more
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """End positions of all chunks; every non-empty text ends with a cut."""
    if not len(data):
        return np.zeros(0, np.int64)
    inner = (data & 0xC0) == 0x80
    marks = np.flatnonzero((gear_hashes(data, offsets) < np.uint32((1 << 32) // MEAN_BYTES)) & ~np.append(inner[1:], False)) + 1
    out = np.unique(np.concatenate([marks, offsets[1:][np.diff(offsets) > 0]]))
    forced, last = [], np.concatenate([[0], out[:-1]])
    for i in np.flatnonzero(out - last > MAX_BYTES).tolist():
        at = int(last[i])
        while out[i] - at > MAX_BYTES:
            at += MAX_BYTES
            while inner[at]:
                at -= 1
            forced.append(at)
    return np.sort(np.concatenate([out, np.array(forced, np.int64)]))


def _chunks_udf():
    fields = [("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]

    @F.arrow_udf("array<struct<h1:bigint,h2:bigint,start:int,end:int>>")
    def chunks(column: pa.Array) -> pa.Array:
        """The chunks of SEED_BYTES and more, at their code points."""
        parts, counts = [], [np.zeros(1, np.int64)]
        for _, data, offsets in scan.texts(column, 1 << 20):
            ends = cuts(data, offsets)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            starts, ends = (x[ends - starts >= SEED_BYTES] for x in (starts, ends))
            points = scan.code_points(data)
            n = np.diff(np.searchsorted(starts, offsets))
            base = np.repeat(points[offsets][:-1], n)
            h = [scan.span_hashes(scan.prefix_sums(data, values), starts, ends).view(np.int64) for values in (scan.EXACT, SECOND)]
            parts.append([*h, (points[starts] - base).astype(np.int32), (points[ends] - base).astype(np.int32)])
            counts.append(n)
        flat = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(fields))]
        rows = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(flat, fields, strict=True)], [n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), rows)

    return chunks


def _same(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b or b.startswith(a):
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _growth_udf():
    @F.arrow_udf("struct<left:int,right:int>")
    def growth(own_left: pa.Array, own_right: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        """How far two runs agree beyond their ends, given the texts on either side of both."""
        back = [_same(a[::-1], b[::-1]) for a, b in zip(own_left.to_pylist(), left.to_pylist(), strict=True)]
        on = [_same(a, b) for a, b in zip(own_right.to_pylist(), right.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(back, pa.int32()), pa.array(on, pa.int32())], ["left", "right"])

    return growth


def _identity(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc"), F.xxhash64(text_col).alias("text_hash")]


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, h1, h2, start, end) of every chunk that is looked up; start and end in code points."""
    return docs.select(*_identity(docs, id_col, text_col), F.inline(_chunks_udf()(F.col(text_col))))


def _runs(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, start, end, n_chunks, KEEPER, kept_start): repeats that follow each other here and there."""
    groups = rows.groupBy(*KEY).agg(F.min(F.struct("doc", "start", "text_hash")).alias("k"), F.max("doc").alias("last"), F.count("*").alias("n"))
    groups = groups.filter("k.doc < last").select(*KEY, F.col("k.doc").alias(KEEPER[0]), F.col("k.text_hash").alias(KEEPER[1]), F.col("k.start").alias("kept_start"), "n")
    groups = written(groups, "chunk-groups")
    near = maybe_in(rows, bitmap(groups, KEY), [F.col(c) for c in KEY]).filter("__maybe").drop("__maybe")
    found = lookup(near, groups, KEY, "n", [*KEEPER, "kept_start"], total(groups, "n")).filter(f"doc > {KEEPER[0]}")
    found = found.groupBy(*TEXT, "start").agg(*[F.first(c).alias(c) for c in ("end", *KEEPER, "kept_start")])
    found = found.withColumn("shift", F.col("start") - F.col("kept_start"))
    order = Window.partitionBy(*TEXT).orderBy("start")
    on = (F.lag("end").over(order) == F.col("start")) & F.lag(F.struct(*KEEPER, "shift")).over(order).eqNullSafe(F.struct(*KEEPER, "shift"))
    runs = found.withColumn("fresh", F.when(on, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy(*TEXT, "run", *KEEPER).agg(
        F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.count("*").alias("n_chunks"), F.min("kept_start").cast("int").alias("kept_start")
    ).drop("run")


def _surroundings(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``places`` (TEXT, start, end, uses) with the texts on their left and right."""
    asked = places.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "end", "uses")).alias("at"))
    asked = written(asked, "chunk-asked")
    own = docs.select(*_identity(docs, id_col, text_col), F.col(text_col).alias("body"))
    own = maybe_in(own, bitmap(asked, TEXT), [F.col(c) for c in TEXT]).filter("__maybe")
    own = own.groupBy(*TEXT).agg(F.first("body").alias("body")).join(asked, TEXT)
    body = F.col("body")

    @F.arrow_udf("array<struct<start:int,end:int,uses:bigint,left:string,right:string>>")
    def cut(texts: pa.Array, at: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts, at, strict=True):  # one text as a Python string at a time
            text = text.as_py()
            out.append([{**s, "left": text[max(0, s["start"] - REACH) : s["start"]], "right": text[s["end"] : s["end"] + REACH]} for s in spans.as_py()])
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("uses", pa.int64()), ("left", pa.string()), ("right", pa.string())])
        return pa.array(out, pa.list_(kind))

    return written(own.select(*TEXT, F.inline(cut(body, F.col("at")))), "chunk-surroundings")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_SPAN) -> DataFrame:
    """(doc, text_hash, start, end, n_chunks, kept_in): spans that stand as a whole in the text of the
    smaller document ``kept_in``."""
    rows = written(chunk_rows(docs, id_col, text_col), "chunks")
    runs = written(_runs(rows), "chunk-runs")
    kept_end = (F.col("kept_start") + F.col("end") - F.col("start")).alias("kept_end")
    here = runs.select(*TEXT, "start", "end", F.lit(0).cast("long").alias("uses"))
    there = runs.select(*[F.col(c).alias(t) for c, t in zip(KEEPER, TEXT, strict=True)], F.col("kept_start").alias("start"), kept_end.alias("end"))
    places = here.unionByName(there.withColumn("uses", F.lit(1).cast("long"))).groupBy(*TEXT, "start", "end").agg(F.sum("uses").alias("uses"))
    around = _surroundings(docs, places, id_col, text_col)
    own = runs.join(around.select(*TEXT, "start", "end", F.col("left").alias("own_left"), F.col("right").alias("own_right")), [*TEXT, "start", "end"])
    at = [*KEEPER, "kept_start", "kept_end"]
    keepers = around.filter("uses > 0").select(*[F.col(c).alias(k) for c, k in zip([*TEXT, "start", "end"], at, strict=True)], "uses", "left", "right")
    met = lookup(own.withColumn("kept_end", kept_end), keepers, at, "uses", ["left", "right"], total(keepers, "uses"))
    grown = met.withColumn("g", _growth_udf()("own_left", "own_right", "left", "right")).select(
        *TEXT, *KEEPER, (F.col("start") - F.col("g.left")).alias("start"), (F.col("end") + F.col("g.right")).alias("end"), "n_chunks", (F.col("start") - F.col("kept_start")).alias("shift")
    )
    # runs on the same diagonal that now meet are one span
    order = Window.partitionBy(*TEXT, *KEEPER, "shift").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = grown.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("span", F.sum("fresh").over(order))
    spans = spans.groupBy(*TEXT, *KEEPER, "shift", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"))
    real = lambda c: F.when(F.col(c) != MIN_LONG, F.col(c))
    return spans.filter(F.col("end") - F.col("start") >= min_chars).select(real("doc").alias("doc"), "text_hash", "start", "end", "n_chunks", real(KEEPER[0]).alias("kept_in"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_SPAN) -> DataFrame:
    """``docs`` with their repeated spans cut out of the texts."""
    spans = repeated_spans(docs, id_col, text_col, min_chars).select(F.coalesce("doc", F.lit(MIN_LONG)).alias("doc"), "text_hash", "start", "end")
    order = Window.partitionBy(*TEXT).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("reach", F.coalesce(reach, F.lit(0))).filter("end > reach").select(*TEXT, F.greatest("start", "reach").alias("start"), "end")
    per_doc = parts.groupBy(*TEXT).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cd_spans"))
    per_doc = written(per_doc.select(F.col("doc").alias("__cd_doc"), F.col("text_hash").alias("__cd_hash"), "__cd_spans"), "chunk-cut")
    own = _identity(docs, id_col, text_col)
    marked = maybe_in(docs, bitmap(per_doc, ["__cd_doc", "__cd_hash"]), own)
    same = marked.filter(~F.col("__maybe")).select(*docs.columns)
    other = marked.filter("__maybe").select(*docs.columns, own[0].alias("__cd_own"), own[1].alias("__cd_key"))
    joined = other.join(per_doc, (F.col("__cd_own") == F.col("__cd_doc")) & (F.col("__cd_key") == F.col("__cd_hash")), "left")
    text = F.col(text_col)
    begin = F.concat(F.array(F.lit(0)), F.col("__cd_spans.end"))
    end = F.concat(F.col("__cd_spans.start"), F.array(F.length(text)))
    pieces = F.transform(F.arrays_zip(begin.alias("a"), end.alias("b")), lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"]))
    cut = F.when(F.col("__cd_spans").isNull(), text).otherwise(F.array_join(pieces, ""))
    return same.unionByName(joined.withColumn("__cd_text", cut).select(*[F.col("__cd_text").alias(c) if c == text_col else F.col(c) for c in docs.columns]))
