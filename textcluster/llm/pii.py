"""Personal data: pattern spans plus information-theoretic sanitisation of the words around them.

Emails, IP addresses, card and phone numbers are found by fixed patterns. Each kind is a protected
entity c; its contexts are the ``RADIUS`` words on either side of its spans. Over all documents,
p(c) is the share of all words that stand in contexts of c and p(c | t) the share of the occurrences
of term t that do. By pointwise mutual information log2(p(c | t) / p(c)) against the information
content -log2 p(c), a term reveals part of what the entity does: from ``GENERALISE`` of it on, its
occurrences in contexts of c are generalised, from ``REMOVE`` on removed. A term must also stand
``LEAST`` times in contexts of c, whatever the corpus. Counts and mutual information are made by term
in Spark; the disclosing terms are broadcast if their measured size is at most ``max_bytes``, and
beyond that meet the words in contexts in a shuffled join with the same results.

Defined results: null and empty texts have no spans; spans of different kinds may overlap, spans of
one kind do not; terms never lie inside a pattern span; repeated documents count as often as they
occur; an empty table gives no rows; only the text column is read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[^0-9]+")
RADIUS, LEAST, GENERALISE, REMOVE = 8, 3, 0.5, 0.75
#: share of an entity's contexts that a term must fill: none, as any would rise with the corpus
SUPPORT = 0.0
#: bytes that a term takes in a broadcast
TERM_BYTES = 200
#: copies of a term in the shuffled join
DEAL = 16


def emails(text: str) -> list[tuple[int, int]]:
    """A match starts at the run of local characters before an @ (any later start in that run would
    match or fail alike), but never before the end of the match before."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        low = found.end() if found else at + 1
        at = text.find("@", low)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _card(found: str) -> bool:
    digits = DIGIT.sub("", found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.groups()))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if _card(m.group())]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.sub("", m.group())) <= 15]
    return out


def _suspects(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts with an @ or a digit; the others cannot hold a span."""
    mark = np.concatenate([[0], np.cumsum((data == 0x40) | ((data >= 0x30) & (data <= 0x39)))])
    return np.flatnonzero(np.diff(mark[offsets])).tolist()


def _contexts(body: np.ndarray, spans: list[tuple[int, int, int]]):
    """(words, kinds): for every kind, the indices of the words in its contexts; words is (starts,
    ends, hashes) of the text, in bytes."""
    ends_at = np.array([0, len(body)])
    starts, ends, _ = scan.runs(body, ends_at, scan.LETTER[body])
    hashes = scan.run_hashes(body, starts, ends)
    place = np.flatnonzero(np.concatenate([(body & 0xC0) != 0x80, [True]]))
    inside = np.zeros(len(starts) + 1, np.int32)
    byte_spans = [(k, int(place[a]), int(place[b])) for k, a, b in spans]
    for _, a, b in byte_spans:  # words that touch a pattern span are no terms
        inside[np.searchsorted(ends, a, "right")] += 1
        inside[np.searchsorted(starts, b, "left")] -= 1
    free = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    kinds = []
    for kind in range(len(KINDS)):
        near = np.zeros(len(free) + 1, np.int32)
        for k, a, b in byte_spans:
            if k == kind:
                left, right = np.searchsorted(starts[free], a), np.searchsorted(starts[free], b)
                near[max(0, left - RADIUS)] += 1
                near[min(len(free), right + RADIUS)] -= 1
        kinds.append(free[np.cumsum(near[:-1]) > 0])
    return (starts, ends, hashes), kinds


def _slices(batches):
    for batch in batches:
        for _, data, offsets in scan.texts(batch.column(0)):
            yield data, offsets


def term_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, term, told): the word hashes that reveal a kind, with "generalise" or "remove", from
    statistics over all documents."""

    def count(batches):
        for data, offsets in _slices(batches):
            starts, ends, _ = scan.runs(data, offsets, scan.LETTER[data])
            found = [(-1, scan.run_hashes(data, starts, ends))]
            for i in _suspects(data, offsets):
                body = data[offsets[i] : offsets[i + 1]]
                spans = base_spans(body.tobytes().decode())
                if spans:
                    (_, _, hashes), kinds = _contexts(body, spans)
                    found += [(kind, hashes[at]) for kind, at in enumerate(kinds) if len(at)]
            for kind in sorted({k for k, _ in found}):
                terms, n = np.unique(np.concatenate([h for k, h in found if k == kind]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), kind, np.int32)), pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "term", "n"])

    rows = docs.select(text_col).mapInArrow(count, "kind int, term long, n long")
    own = {"whole": -1} | {f"n{k}": k for k in range(len(KINDS))}
    counts = written(rows.groupBy("term").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for c, k in own.items()]), "pii-terms")
    sizes = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in own]).first()
    kinds = []
    for kind in range(len(KINDS)):
        share = sizes[f"n{kind}"] / sizes["whole"] if sizes["whole"] else 0.0
        if 0 < share < 1:
            kinds.append(F.struct(F.lit(kind).alias("kind"), F.col(f"n{kind}").alias("n"), F.lit(share).alias("share"), F.lit(float(-np.log2(share))).alias("content")))
    if not kinds:
        return counts.select(F.lit(0).alias("kind"), "term", F.lit("").alias("told")).limit(0)
    near = counts.select("term", "whole", F.inline(F.array(*kinds))).filter(F.col("n") >= LEAST)
    pmi = F.log2(F.col("n") / F.col("whole") / F.col("share"))
    told = F.when(pmi >= REMOVE * F.col("content"), "remove").when(pmi >= GENERALISE * F.col("content"), "generalise")
    return written(near.select("kind", "term", told.alias("told")).filter("told is not null"), "pii-told")


def _on_driver(table: DataFrame) -> dict[int, dict[int, str]]:
    out: dict[int, dict[int, str]] = {}
    for row in table.toLocalIterator():
        out.setdefault(row["kind"], {})[row["term"]] = row["told"]
    return out


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> dict[int, dict[int, str]]:
    """{kind: {word hash: "generalise" or "remove"}} on the driver, for tables known to be small."""
    return _on_driver(term_table(docs, text_col))


FOUND = "struct<kind:string,start:int,end:int>"


def spans_column(spark, terms: dict[int, dict[int, str]], text: Column) -> Column:
    """array<struct<kind, start, end>> of a text: pattern spans by kind and start, then term spans
    by kind (``generalise``, ``remove``) and start."""
    shared = spark.sparkContext.broadcast(terms)

    @F.arrow_udf(f"array<{FOUND}>")
    def find(column: pa.Array) -> pa.Array:
        known, out = shared.value, []
        for _, data, offsets in scan.texts(column):
            rows: list[list] = [[] for _ in range(len(offsets) - 1)]
            for i in _suspects(data, offsets):
                body = data[offsets[i] : offsets[i + 1]]
                spans = base_spans(body.tobytes().decode())
                rows[i] = [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
                if spans and known:
                    (starts, ends, hashes), kinds = _contexts(body, spans)
                    told: dict[int, str] = {}
                    for kind, at in enumerate(kinds):
                        own = known.get(kind, {})
                        for w, h in zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True):
                            if h in own:
                                told[w] = max(told.get(w, ""), own[h])
                    points = scan.code_points(body) if told else None
                    for w in sorted(told, key=lambda w: (told[w], w)):
                        rows[i].append({"kind": told[w], "start": int(points[starts[w]]), "end": int(points[ends[w]])})
            out += rows
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return find.asNondeterministic()(text)


def _context_words_udf():
    """array<struct<kind, term, start, end>> of a text: the words in contexts of each kind."""
    names = ("kind", "term", "start", "end")

    @F.arrow_udf("array<struct<kind:int,term:bigint,start:int,end:int>>")
    def near(column: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in scan.texts(column):
            rows: list[list] = [[] for _ in range(len(offsets) - 1)]
            for i in _suspects(data, offsets):
                body = data[offsets[i] : offsets[i + 1]]
                spans = base_spans(body.tobytes().decode())
                if spans:
                    (starts, ends, hashes), kinds = _contexts(body, spans)
                    points = scan.code_points(body)
                    for kind, at in enumerate(kinds):
                        each = (hashes[at].view(np.int64).tolist(), points[starts[at]].tolist(), points[ends[at]].tolist())
                        rows[i] += [dict(zip(names, (kind, *x), strict=True)) for x in zip(*each, strict=True)]
            out += rows
        return pa.array(out, pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)))))

    return near.asNondeterministic()


def _joined_mark(docs: DataFrame, text_col: str, table: DataFrame) -> DataFrame:
    """``mark`` without a broadcast: words in contexts meet the terms by kind and term, the spans found
    come back to the rows by text. A term may stand beside every span, so its words are dealt out over
    ``DEAL`` copies of it."""
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    texts = docs.select(key.alias("__pii_key"), F.col(text_col).alias("body")).filter("body rlike '[@0-9]'")
    words = texts.dropDuplicates(["__pii_key"]).select("__pii_key", F.inline(_context_words_udf()("body")))
    words = words.withColumn("deal", F.pmod(F.xxhash64("__pii_key", "start"), F.lit(DEAL)).cast("int"))
    dealt = table.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    found = words.join(dealt, ["kind", "term", "deal"]).groupBy("__pii_key", "start", "end").agg(F.max("told").alias("told"))
    found = found.groupBy("__pii_key").agg(F.sort_array(F.collect_list(F.struct("told", "start", "end"))).alias("__pii_told"))
    own = docs.withColumn("__pii_own", F.coalesce(key, F.lit("")))
    base = own.join(found, own["__pii_own"] == found["__pii_key"], "left").withColumn("__pii_base", spans_column(docs.sparkSession, {}, F.col(text_col)))
    told = F.transform("__pii_told", lambda x: F.struct(x["told"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return base.select(*docs.columns, F.concat("__pii_base", F.coalesce(told, F.array().cast(f"array<{FOUND}>"))).alias("__pii"))


def mark(docs: DataFrame, text_col: str = "text", terms: dict | None = None, max_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with ``__pii``, the spans of each text."""
    if terms is None:
        table = term_table(docs, text_col)
        if table.count() * TERM_BYTES > max_bytes:
            return _joined_mark(docs, text_col, table)
        terms = _on_driver(table)
    return docs.withColumn("__pii", spans_column(docs.sparkSession, terms, F.col(text_col)))


def sanitise(docs: DataFrame, text_col: str = "text", terms: dict | None = None, max_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with pattern spans replaced by their kind, generalised terms by [TERM], removed terms
    by nothing. Where spans overlap, the one that starts first (then the longer) is replaced."""
    order = F.array_sort("__pii", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text, shown = F.col(text_col), {k: f"[{k.upper()}]" for k in KINDS} | {"generalise": "[TERM]", "remove": ""}
    name = lambda kind: F.element_at(F.create_map(*[F.lit(x) for kv in shown.items() for x in kv]), kind)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc, span):
        added = F.concat(acc["out"], F.substring(text, acc["at"] + 1, span["start"] - acc["at"]), name(span["kind"]))
        return F.when(span["start"] < acc["at"], acc).otherwise(F.struct(added.alias("out"), span["end"].alias("at")))

    clean = F.aggregate(order, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    marked = mark(docs, text_col, terms, max_bytes).withColumn("__pii_text", F.when(F.size("__pii") > 0, clean).otherwise(text))
    return marked.select(*[F.col("__pii_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])
