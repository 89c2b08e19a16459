"""Record parsers.

F1 turns one XML record into ``(title, content, permalink, error)``. Arrow batches go through the
standard-library XML parser slice by slice: one parse per record, and a malformed record sets ``error``
instead of failing the job. Built-in ``xpath`` would raise on the first malformed record and would
re-parse the record once per field.

Fixed values (XML record shape):
  * file root element ``PubmedArticleSet``; record element ``PubmedArticle``; title ``ArticleTitle``;
    abstract ``Abstract``; id ``PMID``
  * own id: the first ``MedlineCitation/PMID`` directly under the record, else the first ``PMID``
  * text of an element: its text nodes joined by one space, whitespace runs collapsed, trimmed

F2 splits a delimited text record into segments. Fixed values: separator ``SEGMENTBREAK``; content
segment 4, title segment 1 (0-based, after trimming the record's outer line breaks); the id is
searched in the whole record.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse_blank_lines, element_at_index, extract_id, split_literal
from .models import in_slices, text_sizes

ROOT_TAG = "PubmedArticleSet"
RECORD_TAG = "PubmedArticle"
TITLE_TAG = "ArticleTitle"
ABSTRACT_TAG = "Abstract"
ID_TAG = "PMID"
OWN_ID_PATH = "MedlineCitation/PMID"

SEGMENT_SEP = "SEGMENTBREAK"
CONTENT_SEGMENT = 4
TITLE_SEGMENT = 1

PARSED = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

_WS = re.compile(r"[ \t\r\n]+")


def _text_of(el) -> str:
    return _WS.sub(" ", " ".join(el.itertext())).strip(" \t\r\n")


def parse_xml_record(rec: str | None) -> tuple:
    """One record -> (title, content, permalink, error). ``content`` is None when there is no
    abstract element; an empty abstract gives ''."""
    import xml.etree.ElementTree as ET

    if rec is None:
        return (None, None, None, "empty_record")
    try:
        root = ET.fromstring(rec)
    except ET.ParseError as e:
        return (None, None, None, f"malformed: {e}")
    if root.tag != RECORD_TAG:
        found = root.find(f".//{RECORD_TAG}")
        if found is None:
            return (None, None, None, "no_record_element")
        root = found
    pid = root.find(OWN_ID_PATH)
    if pid is None:
        pid = root.find(f".//{ID_TAG}")
    title = root.find(f".//{TITLE_TAG}")
    abstract = root.find(f".//{ABSTRACT_TAG}")
    return (
        None if title is None else _text_of(title),
        None if abstract is None else _text_of(abstract),
        None if pid is None else _text_of(pid),
        None,
    )


def _parsed(records):
    """An Arrow column of records -> one of PARSED structs. Python objects exist for a slice at a time."""
    names = ["title", "content", "permalink", "error"]
    parts = [pa.array([], pa.struct([(n, pa.string()) for n in names]))]
    for b in in_slices([pa.RecordBatch.from_arrays([records], ["record"])], text_sizes("record")):
        fields = zip(*[parse_xml_record(r.as_py()) for r in b.column("record")])
        parts.append(pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in fields], names))
    return pa.concat_arrays(parts)


@F.arrow_udf(PARSED)
def xml_record_udf(records: pa.Array) -> pa.Array:
    return _parsed(records)


def parse_xml(df: DataFrame, record_col: str = "record", keep: tuple[str, ...] = ("source_file", "seq")) -> DataFrame:
    """``keep + (title, content, permalink, error)`` from XML record strings. A task holds one Arrow
    batch of records, their fields as an Arrow column, and Python objects for one slice."""
    cols = [c for c in keep if c in df.columns]
    # marked as nondeterministic so that no filter or projection above copies the parse
    parsed = df.select(*cols, xml_record_udf.asNondeterministic()(F.col(record_col)).alias("p"))
    return parsed.select(*cols, "p.title", "p.content", "p.permalink", "p.error")


def segments(record: Column, sep: str = SEGMENT_SEP) -> Column:
    """C6 + C3: segments of a text record: blank-line runs separate, each segment trimmed."""
    return F.transform(split_literal(collapse_blank_lines(record, sep), sep), lambda s: F.trim(s))


def parse_text(
    df: DataFrame,
    record_col: str = "record",
    sep: str = SEGMENT_SEP,
    content_idx: int = CONTENT_SEGMENT,
    title_idx: int = TITLE_SEGMENT,
    keep: tuple[str, ...] = ("source_file", "seq"),
) -> DataFrame:
    """``keep + (title, content, permalink, error)`` from delimited text records.

    Fields are taken in the order content, title, id; when an index is out of range the record
    keeps only the fields already taken (so with the defaults a record of fewer than five segments
    has no fields). There is no title fallback for text records.
    """
    cols = [c for c in keep if c in df.columns]

    def fields(record: Column, segs: Column) -> Column:
        content = element_at_index(segs, content_idx)
        title = F.when(content.isNotNull(), element_at_index(segs, title_idx))
        return F.struct(
            title.alias("title"),
            content.alias("content"),
            F.when(title.isNotNull(), extract_id(record)).alias("permalink"),
            F.when(content.isNull(), F.lit("too_few_segments")).alias("error"),
        )

    # a lambda's argument is evaluated once, and nothing above a generator is pushed into it: the
    # segments of a record are cut once, whatever reads or filters its fields
    cut = F.transform(F.array(F.col(record_col)), lambda r: F.struct(r.alias("record"), segments(r, sep).alias("segs")))
    return df.select(*cols, F.inline(F.transform(cut, lambda x: fields(x["record"], x["segs"]))))


# The record-parser extension point. A parser maps the raw record column to a new record column
# before field extraction; the default is the identity.
RecordParser = Callable[[Column], Column]


def identity_parser(record: Column) -> Column:
    return record


def apply_parser(df: DataFrame, parser: RecordParser | None = None, record_col: str = "record") -> DataFrame:
    """Replace ``record_col`` by ``parser(record_col)`` (a Column function or a pandas UDF)."""
    p = parser or identity_parser
    return df.withColumn(record_col, p(F.col(record_col)))
