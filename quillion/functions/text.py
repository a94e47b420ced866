"""Scalar text functions as column expressions: Markdown stripping, term keys, slugs, paths, excerpts."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillion.functions.regex import S, rewrite, squeeze, trim


@F.pandas_udf(StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no function for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def frontmatter_offset(md: Column) -> Column:
    """Characters of a leading ``---`` block with its closing line; 0 without one."""
    block = F.regexp_extract(md, r"(?s)\A(---\n.*?\n---[^\n]*(?:\n|\z))", 1)
    # The block closes at the first line that starts with dashes after the opening one.
    return F.length(block)


def strip_frontmatter(md: Column) -> Column:
    """struct(content, offset)"""
    at = frontmatter_offset(md)
    return F.struct(F.substring(md, at + 1, F.length(md)).alias("content"), at.alias("offset"))


def strip_markdown(c: Column) -> Column:
    """Plain text: images vanish, links and wiki links leave their label or target, marks become spaces."""
    c = rewrite(
        F.coalesce(c, F.lit("")),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1"),
        (r"`([^`]*)`", "$1"),
        (r"[*_~=#>]", " "),
    )
    return squeeze(c)


def normalize_term(c: Column) -> Column:
    """Canonical key of a term: plain, without accents, with straight quotes, ASCII letters and digits at both ends, lower case."""
    c = rewrite(nfkd(strip_markdown(c)), ("[\\u0300-\\u036f]", ""), ("[“”]", '"'), ("[‘’]", "'"), (r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""), (f"{S}+", " "))
    return trim(F.lower(c))


def _upper(c: str) -> str:
    """The one capital of a letter; ß has one that Unicode's full mapping, to SS, does not use."""
    return next((u for u in (c.upper(), c.title(), "ẞ" if c == "ß" else c) if len(u) == 1), c)


@functools.cache
def _cased() -> tuple[str, str]:
    """Letters up to the last one that has a capital, and their capitals."""
    pairs = [(c, u) for c in map(chr, range(0x1E944)) if (u := _upper(c)) != c]
    return "".join(c for c, _ in pairs), "".join(u for _, u in pairs)


def upper(c: Column) -> Column:
    """Capitals letter by letter, as in SQL: a text keeps its length, where Java's make SS of ß."""
    return F.translate(c, *_cased())


def slugify(c: Column, fallback: str = "") -> Column:
    slug = F.substring(rewrite(normalize_term(c), ("&", " and "), ("[^a-z0-9]+", "-"), ("^-+|-+$", "")), 1, 80)
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback or "item"))


def parent_path(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), r"(?s)\A(.*)/", 1)


def base_name(c: Column) -> Column:
    """Last part of a path, without its extension."""
    return F.regexp_replace(F.substring_index(F.coalesce(c, F.lit("")), "/", -1), r"\.[^.]+$", "")


def normalize_sentence(c: Column) -> Column:
    return F.lower(strip_markdown(c))


def excerpt_around(md: Column, start: Column, end: Column, radius: int = 500) -> Column:
    """Plain text around [start, end), at most twice the radius long."""
    low = F.greatest(start - radius, F.lit(0))
    high = F.least(end + radius, F.length(md))
    return F.left(strip_markdown(F.substring(md, low + 1, high - low)), F.lit(2 * radius))


def word_at(line: Column, position: Column) -> Column:
    """struct(word, from, to) of the letters and hyphens around a position; null for words under five characters."""
    at = F.greatest(F.least(position, F.length(line)), F.lit(0))
    before = F.regexp_extract(F.left(line, at), r"[A-Za-z-]*\z", 0)  # Java's $ also stands before a last line end
    after = F.regexp_extract(F.substring(line, at + 1, F.length(line)), "^[A-Za-z-]*", 0)
    word = F.concat(before, after)
    return F.when(F.length(word) >= 5, F.struct(word.alias("word"), (at - F.length(before)).alias("from"), (at + F.length(after)).alias("to")))


#: Mis-decoded sequences and what they stand for, in the order of replacing; then ligatures; then characters to drop.
MOJIBAKE = [("â€™", "’"), ("â€˜", "‘"), ("â€œ", "“"), ("â€", "”"), ("â€“", "–"), ("â€”", "—"), ("â€¦", "…"), ("Â ", " "), ("Â", "")]
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
LETTERS = "A-Za-zΑ-Ωα-ωÀ-ÖØ-öø-ÿ"


def repair_unicode(c: Column) -> Column:
    """Mis-decoded sequences, ligatures and control characters repaired, then composed."""
    for bad, good in (*MOJIBAKE, *LIGATURES):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return nfc(F.regexp_replace(c, CONTROL, ""))


def clean_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(repair_unicode(c), r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")


def merge_hyphenated(c: Column) -> Column:
    """Words broken by a hyphen at a line's end are whole again."""
    return F.regexp_replace(c, f"(?<=[{LETTERS}])-\n(?=[{LETTERS}])", "")


def truncate(c: Column, most: int = 4000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def occurrence_count(text: Column, term: str) -> Column:
    """Whole-word occurrences of a term, in any case; hyphens belong to words."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![A-Za-z0-9_-])\Q{term.lower()}\E(?![A-Za-z0-9_-])")).cast("long")
