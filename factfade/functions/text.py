"""Text columns: case folding, tokens, terms, snippets."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and the quote marks a term drops.
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
QUOTES = "\"“”„‟«»‹›"
TOKEN = r"[\p{L}\p{N}]+"
# The same two classes for text that is all ASCII: much faster to match.
ASCII_WHITE = r"[\t\n\x0B\f\r ]+"
ASCII_TOKEN = "[a-z0-9]+"
SNIPPET_LENGTH = 120


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters that are a base letter plus one mark, and their bases."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) == 2 and unicodedata.combining(parts[1]):
            marked.append(letter)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


ACCENTED, UNACCENTED = _accents()
# Bare combining marks are dropped: they have no counterpart in UNACCENTED.
MARKS = "".join(chr(code) for code in range(0x300, 0x332))


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII text takes the fast built-in path."""
    return F.when(_is_ascii(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def trim_white(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}|{WHITE}$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_white(c) == "", F.lit(True))


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def literal_contains(c: Column, needle: Column | str) -> Column:
    """Substring test in which ``%``, ``_`` and ``\\`` have no special meaning."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(ascii_lower(c), ascii_lower(needle))


def folded(c: Column) -> Column:
    """Lower case without accents, the form in which tokens are compared."""
    return F.when(_is_ascii(c), F.lower(c)).otherwise(
        F.translate(F.lower(c), ACCENTED + MARKS, UNACCENTED)
    )


def tokens(c: Column) -> Column:
    """Runs of letters and digits; an empty array for NULL."""
    found = F.when(
        _is_ascii(c), F.regexp_extract_all(F.lower(c), F.lit(ASCII_TOKEN), F.lit(0))
    ).otherwise(F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0)))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(found)


def split_white(c: Column) -> Column:
    return F.when(_is_ascii(c), F.split(c, ASCII_WHITE)).otherwise(F.split(c, WHITE))


def raw_terms(c: Column) -> Column:
    """White-space separated terms with their quote marks."""
    return F.filter(split_white(F.coalesce(c, F.lit(""))), lambda t: t != "")


def query_terms(c: Column) -> Column:
    """Terms without quote marks; terms that were nothing else disappear."""
    return F.filter(
        F.transform(raw_terms(c), lambda t: F.translate(t, QUOTES, "")), lambda t: t != ""
    )


def compact_snippet(c: Column, n: int = SNIPPET_LENGTH) -> Column:
    """struct<content, truncated>: at most ``n`` characters, the last one an ellipsis."""
    long = F.char_length(c) > n
    cut = F.concat(F.substring(c, 1, n - 1), F.lit("…"))
    return F.struct(
        F.when(long, cut).otherwise(c).alias("content"),
        F.coalesce(long, F.lit(False)).alias("truncated"),
    )


def truncate_ellipsis(c: Column, n: int) -> Column:
    """At most ``n`` characters, three dots at the end when something was cut."""
    if n <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    cut = F.substring(c, 1, n) if n <= 3 else F.concat(F.substring(c, 1, n - 3), F.lit("..."))
    return F.when(F.char_length(c) <= n, c).otherwise(cut)
