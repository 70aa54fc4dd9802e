"""Column expressions over text: lengths, terms, hashed term buckets, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE = r"[^.!?\n]+[.!?]*"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: a character outside the basic plane counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order, repeats kept."""
    return F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: t != "")


def occurrences(found: str, word: str) -> Column:
    """How often ``word`` is among the terms in array column ``found``."""
    return F.size(F.filter(found, lambda t: t == word))


def term_bucket(term: Column, dims: int) -> Column:
    """Bucket 0..dims-1 of a term. MD5 makes it the same in every engine that reads the vectors."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % F.lit(dims)).cast("int")


def term_buckets(text: Column, dims: int) -> Column:
    return F.transform(terms(text), lambda t: term_bucket(t, dims))


def sentences(text: Column) -> Column:
    """Sentences of a text with their end marks; a line break always ends one."""
    cut = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def contains_text(column: Column, query: str) -> Column:
    """Case-insensitive literal substring test; ``%`` and ``_`` are plain characters."""
    return F.lower(column).contains(F.lower(F.lit(query)))
