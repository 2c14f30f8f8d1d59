"""Splitting documents into overlapping chunks with stable ids. No shuffle: one array expression for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip

#: How assignments look (fixed values).
_ASSIGNED = r"""(?U)^[A-Za-z0-9_]+\s*=\s*["']"""
_CLOSED = r"""(?U)^[A-Za-z0-9_]+\s*=\s*["'](.*)["']\s*$"""
_LIST_START = r"(?U)^documents\s*=\s*\["
#: Columns of a chunk that extra metadata can't replace.
FIXED = ("source", "chunk_index", "char_length")


def check_sizes(size: int, overlap: int) -> None:
    if overlap >= size:
        raise ValueError(f"the overlap ({overlap}) must be smaller than the chunk size ({size})")


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def assignment_paragraphs(text: Column) -> Column:
    """Of a text in which values are assigned to names: one paragraph a line. A value quoted on its line stands alone (even an empty one); the line that opens a list goes."""
    rows = F.filter(F.transform(lines(text), strip), lambda line: (line != "") & ~line.rlike(_LIST_START))
    return F.transform(rows, lambda line: F.when(line.rlike(_CLOSED), strip(F.regexp_extract(line, _CLOSED, 1))).otherwise(line))


def pieces(paragraph: Column, size: int, overlap: int) -> Column:
    """The paragraph, or windows of ``size`` characters that begin ``size - overlap`` apart up to the one that reaches its end, stripped, without blank ones."""
    step = size - overlap
    last = (F.ceil((F.length(paragraph) - size) / step) * step).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda s: strip(F.substring(paragraph, s + 1, F.lit(size))))
    return F.when(F.length(paragraph) <= size, F.array(paragraph)).otherwise(F.filter(windows, lambda w: w != ""))


def chunk(docs: DataFrame, source: str = "source", text: str = "text", size: int = 400, overlap: int = 60, assignments: bool = False, extra: str | None = None) -> DataFrame:
    """docs -> chunk_id, text, source, chunk_index (from 0 in the document), char_length, and extra (a map column, without the fixed keys).

    ``assignments``: documents with a line ``name = "...`` are read line by line. Null and blank texts have no chunks."""
    check_sizes(size, overlap)
    body = strip(F.coalesce(F.col(text), F.lit("")))
    paras = paragraphs(body)
    if assignments:
        assigned = F.exists(F.transform(lines(body), strip), lambda line: line.rlike(_ASSIGNED))
        paras = F.when(assigned, assignment_paragraphs(body)).otherwise(paras)
    parts = F.flatten(F.transform(paras, lambda p: pieces(p, size, overlap)))
    keep = F.map_filter(F.col(extra), lambda k, _: ~k.isin(*FIXED)) if extra else None
    rows = docs.select(F.col(source).cast("string").alias("source"), *([keep.alias("extra")] if extra else []), F.posexplode_outer(parts).alias("chunk_index", "text")).filter("text IS NOT NULL")
    cols = [F.format_string("%s#chunk-%04d", "source", "chunk_index").alias("chunk_id"), "text", "source", "chunk_index", F.length("text").alias("char_length")]
    return rows.select(*cols, *(["extra"] if extra else []))
