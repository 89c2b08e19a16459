"""Scalar text functions, all JVM built-ins so they stay inside whole-stage code generation.

Fixed values that must equal the behaviour being reproduced:
  * token pattern: runs of two or more letter, digit or underscore characters, after lower-casing
  * record id pattern: ``PMID:`` then white space then exactly eight digits
  * whitespace class for collapsing text: space, tab, carriage return, line feed
  * characters a URL quote leaves alone: ASCII letters, digits, ``_ . - ~`` and ``/``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "TOKEN_PATTERN",
    "ID_PATTERN",
    "WS_PATTERN",
    "tokenize",
    "remove_words",
    "collapse_ws",
    "extract_id",
    "split_literal",
    "element_at_index",
    "last_path_component",
    "collapse_blank_lines",
    "starts_with_id_line",
    "url_quote",
    "join_terms",
    "has_extension",
    "first_line",
    "xml_escape",
]

# Fixed values (see module docstring).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
ID_PATTERN = r"PMID:\s+(\d{8})"
WS_PATTERN = r"[ \t\r\n]+"
ID_LINE_PREFIX = "PMID"


def tokenize(text: Column) -> Column:
    """Lower-case, then every run of >= 2 word characters, in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def remove_words(tokens: Column, words) -> Column:
    """drop tokens found in ``words`` (a hash-set lookup per token; order kept)."""
    words = list(words)
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def collapse_ws(text: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(text, F.lit(WS_PATTERN), F.lit(" ")))


def extract_id(text: Column) -> Column:
    """The eight-digit record id after ``PMID:``, or null."""
    return F.nullif(F.regexp_extract(text, ID_PATTERN, 1), F.lit(""))


def split_literal(text: Column, sep: str) -> Column:
    """Split by a literal separator (quoted for the regex engine)."""
    import re

    return F.split(text, re.escape(sep))


def element_at_index(arr: Column, index: int) -> Column:
    """C4: element at a 0-based index, negative counts from the end; null when out of range."""
    return F.try_element_at(arr, F.lit(index + 1 if index >= 0 else index))


def last_path_component(path: Column) -> Column:
    """Part after the last backslash."""
    return F.substring_index(path, "\\", -1)


def collapse_blank_lines(text: Column, sep: str) -> Column:
    """Every run of one or more blank lines becomes one separator; line breaks inside a
    segment become spaces; leading and trailing breaks are dropped."""
    t = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    # before one of these at the end of a text, "$" matches too; in all other texts the regex is a plain trim
    ends = F.contains(text, F.lit("\u0085")) | F.contains(text, F.lit("\u2028")) | F.contains(text, F.lit("\u2029"))
    t = F.when(ends, F.regexp_replace(t, r"^\n+|\n+$", "")).otherwise(F.btrim(t, F.lit("\n")))
    t = F.regexp_replace(t, r"\n[ \t]*\n(?:[ \t]*\n)*", F.lit(sep))
    return F.replace(t, F.lit("\n"), F.lit(" "))


def starts_with_id_line(line: Column) -> Column:
    """The line begins with the record id tag."""
    return F.startswith(line, F.lit(ID_LINE_PREFIX))


def url_quote(text: Column) -> Column:
    """Percent-encode like a URL path quote that keeps ``/``.

    Java's form encoder turns space into ``+`` (a literal ``+`` is already ``%2B``), encodes ``~``
    and ``/`` and keeps ``*``; map those four back.
    """
    q = F.url_encode(text)
    q = F.replace(q, F.lit("+"), F.lit("%20"))
    q = F.replace(q, F.lit("*"), F.lit("%2A"))
    q = F.replace(q, F.lit("%7E"), F.lit("~"))
    return F.replace(q, F.lit("%2F"), F.lit("/"))


def join_terms(terms: Column) -> Column:
    """Terms joined by comma and space."""
    return F.array_join(terms, ", ")


def has_extension(name: Column, extensions=(".txt", ".xml")) -> Column:
    """C11: file name ends with one of the extensions, case-insensitively."""
    low = F.lower(name)
    cond = F.lit(False)
    for ext in extensions:
        cond = cond | F.endswith(low, F.lit(ext.lower()))
    return cond


def first_line(text: Column) -> Column:
    """Text up to the first line feed."""
    return F.substring_index(text, "\n", 1)


def xml_escape(text: Column) -> Column:
    """Escape ``& < >`` for XML character data."""
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    t = F.replace(t, F.lit("<"), F.lit("&lt;"))
    return F.replace(t, F.lit(">"), F.lit("&gt;"))
