"""Raw XML and delimited-text records built in a column from ``documents`` (and ``pages``).

These let the parsers run over whole tables and be checked against SQL, and they feed the
directory-scan and streaming jobs. The record shape varies by language (fixed rule):

  XML  : en full record; fr full record with a cited id after the own one and the title in
         ``<i>`` markup; es without an abstract (content falls back to the title); de without an id
         (rejected as ``missing_id``).
  text : citation, title, authors, author information, abstract, id line, separated by one blank
         line; de uses runs of two blank lines; es lacks the two author segments (too few segments).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_line, xml_escape
from .tables import permalink_of

NL = "\n"


def _el(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))


def xml_record(doc_id: Column, text: Column, lang: Column) -> Column:
    """One ``PubmedArticle`` record string."""
    pid = F.concat(F.lit('<PMID Version="1">'), permalink_of(doc_id), F.lit("</PMID>"))
    title_txt = xml_escape(first_line(text))
    title = F.when(lang == "fr", _el("ArticleTitle", _el("i", title_txt))).otherwise(_el("ArticleTitle", title_txt))
    abstract = F.when(lang == "es", F.lit("")).otherwise(_el("Abstract", _el("AbstractText", xml_escape(text))))
    cited = F.when(
        lang == "fr",
        F.concat(
            F.lit("<CommentsCorrectionsList><CommentsCorrections><PMID Version=\"1\">"),
            permalink_of(doc_id + F.lit(1)),
            F.lit("</PMID></CommentsCorrections></CommentsCorrectionsList>"),
        ),
    ).otherwise(F.lit(""))
    own = F.when(lang == "de", F.lit("")).otherwise(pid)
    return F.concat(
        F.lit("<PubmedArticle><MedlineCitation>"),
        own,
        F.lit("<DateCreated><Year>2017</Year></DateCreated><Article>"),
        title,
        abstract,
        F.lit("</Article>"),
        cited,
        F.lit("</MedlineCitation></PubmedArticle>"),
    )


def xml_record_of(record_id: Column, title: Column, body: Column) -> Column:
    """A full record with escaped title and abstract text (any text, markup included)."""
    return F.concat(
        F.lit('<PubmedArticle><MedlineCitation><PMID Version="1">'),
        record_id.cast("string"),
        F.lit("</PMID><Article>"),
        _el("ArticleTitle", xml_escape(title)),
        _el("Abstract", _el("AbstractText", xml_escape(body))),
        F.lit("</Article></MedlineCitation></PubmedArticle>"),
    )


def xml_records(documents: DataFrame) -> DataFrame:
    """``(doc_id, seq, lang, record)``."""
    return documents.select(
        "doc_id", F.col("doc_id").alias("seq"), "lang", xml_record(F.col("doc_id"), F.col("text"), F.col("lang")).alias("record")
    )


def one_line(text: Column) -> Column:
    """A field on one line: line breaks become spaces."""
    return F.regexp_replace(text, r"[\r\n]", " ")


def text_record(doc_id: Column, text: Column, lang: Column, source: Column) -> Column:
    """One delimited text record, ending with its id line."""
    gap = F.when(lang == "de", F.lit(NL * 3)).otherwise(F.lit(NL * 2))
    authors = F.when(lang == "es", F.lit("")).otherwise(
        F.concat(F.lit("Auth A."), gap, F.lit("Author information: X"), gap)
    )
    return F.concat(
        doc_id.cast("string"),
        F.lit(". J "),
        F.coalesce(source, F.lit("")),
        F.lit(". 2017."),
        gap,
        one_line(first_line(text)),
        gap,
        authors,
        one_line(text),
        gap,
        F.lit("PMID: "),
        permalink_of(doc_id),
        F.lit("  [Indexed]"),
        F.lit(NL),
    )


def text_records(documents: DataFrame) -> DataFrame:
    """``(doc_id, seq, lang, record)``."""
    return documents.select(
        "doc_id",
        F.col("doc_id").alias("seq"),
        "lang",
        text_record(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")).alias("record"),
    )


def xml_struct(documents: DataFrame) -> DataFrame:
    """Records as nested structs for Spark's XML writer: ``(lang, MedlineCitation)``."""
    return documents.select(
        "lang",
        F.struct(
            F.struct(F.lit("1").alias("_Version"), permalink_of(F.col("doc_id")).alias("_VALUE")).alias("PMID"),
            F.struct(
                first_line(F.col("text")).alias("ArticleTitle"),
                F.struct(F.col("text").alias("AbstractText")).alias("Abstract"),
            ).alias("Article"),
        ).alias("MedlineCitation"),
    )
