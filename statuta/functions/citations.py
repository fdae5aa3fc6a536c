"""Statute citations: reading and writing ``Art. N[ Abs. M] BOOK``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUFFIX = r"(bis|ter|quater|quinquies|sexies|septies|octies|novies|[a-z])?(?![\p{L}\d])"
_W = r"[\s\u00a0]*"
_SEP = rf"{_W},?{_W}"
#: article, its suffix, paragraph, its suffix, the rest (book or statute name)
CITATION = (
    rf"(?is)^{_W}art(?:icle|ikel)?\.?{_W}(\d+){_W}{_SUFFIX}"
    rf"(?:{_SEP}(?:abs(?:atz)?|al|para?|cpv)\.?{_W}(\d+){_W}{_SUFFIX})?"
    rf"(?:{_SEP}(?:lit|bst|let|buchstabe|litera|ziff(?:er)?|satz|nr)\b\.?{_W}[\p{{L}}\d]{{1,4}}(?![\p{{L}}\d])\.?\)?)*"
    rf"{_SEP}(.*?){_W}$"
)
_MARK = "\u0001"


def parse_citation(c: Column) -> Column:
    """``STRUCT<art, suffix, abs, abs_suffix, book>`` of strings, null where ``c`` is no citation.

    Letters, sentences and numbers below the paragraph are read over; missing parts are empty strings. One regex pass.
    """
    flat = F.regexp_replace(c, CITATION, _MARK.join(["", "$1", "$2", "$3", "$4", "$5"]))
    parts = F.split(flat, _MARK)
    names = ("art", "suffix", "abs", "abs_suffix", "book")
    fields = [F.lower(F.get(parts, F.lit(i + 1))).alias(n) if n != "book" else F.get(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return F.when(c.isNotNull() & flat.startswith(_MARK), F.struct(*fields))


def book_stem(book: Column) -> Column:
    """A book as written, without printing marks: footnote digits and signs behind it, brackets and dots around it."""
    return F.regexp_replace(F.regexp_replace(book, r"[\s\u00a0]+", " "), r"^[\s.,;:(\[\"'«»]+|[\s\d.,;:)\]\"'«»*†‡¹²³⁴-⁹⁰]+$", "")


def citation_key(parsed: Column) -> Column:
    """The identity of a citation: article with suffix, paragraph with suffix, book; case, spacing and marks don't count."""
    number = lambda n: F.regexp_replace(parsed[n], r"^0+(?=\d)", "")
    return F.concat_ws("|", F.concat(number("art"), parsed["suffix"]), F.concat(number("abs"), parsed["abs_suffix"]), F.lower(book_stem(parsed["book"])))


def write_citation(parsed: Column, book: Column) -> Column:
    """``Art. N[ Abs. M] BOOK`` with single spaces and lower-case suffixes."""
    number = lambda n: F.regexp_replace(parsed[n], r"^0+(?=\d)", "")
    para = F.when(parsed["abs"] != "", F.concat(F.lit("Abs. "), number("abs"), parsed["abs_suffix"]))
    return F.concat_ws(" ", F.concat(F.lit("Art. "), number("art"), parsed["suffix"]), para, book)
