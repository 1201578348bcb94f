"""Column functions over paths, identifiers and lines of code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(col(c), _UPPER, _LOWER)


_WHITE = " \t\r\n\f\x0b"


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(col(c), F.lit(_WHITE))


def contains_ci(c: Column | str, text: str) -> Column:
    return F.lower(col(c)).contains(text.lower())


def starts_ci(c: Column | str, text: str) -> Column:
    return F.lower(col(c)).startswith(text.lower())


def like_ci(c: Column | str, pattern: str) -> Column:
    """Case-insensitive LIKE in which % and _ of the pattern are wildcards."""
    return F.lower(col(c)).like(pattern.lower())


def normalize_path(path: Column | str, collapse: str = "once") -> Column:
    """Back slashes become slashes; doubled slashes stay ("none"), are replaced in one
    pass ("once", so that /// becomes //) or all collapse ("all")."""
    slashed = F.replace(col(path), F.lit("\\"), F.lit("/"))
    if collapse == "none":
        return slashed
    if collapse == "once":
        return F.replace(slashed, F.lit("//"), F.lit("/"))
    return F.regexp_replace(slashed, "/{2,}", "/")


def join_path(directory: Column | str, name: Column | str) -> Column:
    """Path of a name in a directory; an empty directory and one ending in / add none."""
    d, n = F.coalesce(col(directory), F.lit("")), col(name)
    return F.when(d == "", n).when(d.endswith("/"), F.concat(d, n)).otherwise(F.concat(d, F.lit("/"), n))


def file_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def directory(path: Column | str) -> Column:
    p = col(path)
    return F.when(p.contains("/"), F.substring(p, F.lit(1), F.length(p) - F.length(file_name(p)) - 1)).otherwise("")


def extension(name: Column | str) -> Column:
    """What follows the last dot of a name, in lower case; null without one."""
    n = col(name)
    return F.when(n.contains("."), F.lower(F.substring_index(n, ".", -1)))


def is_under(path: Column | str, root: Column | str) -> Column:
    """Whether a path is a root or lies below it, on / boundaries."""
    p, r = col(path), col(root)
    return (p == r) | p.startswith(F.concat(F.when(r.endswith("/"), F.regexp_replace(r, "/+$", "")).otherwise(r), F.lit("/")))


def path_prefixes(path: Column | str) -> Column:
    """All ancestors of a directory path, itself included, shortest first."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def text_lines(text: Column | str) -> Column:
    """Lines without their ends; a final empty line does not count."""
    return F.split(F.regexp_replace(col(text), r"\r?\n$", ""), r"\r?\n")


def byte_column(line: Column | str, char_column: Column) -> Column:
    """Byte offset of a 0-based character column."""
    return F.octet_length(F.substring(col(line), F.lit(1), char_column))


def whole_word(word: str) -> str:
    """Regular expression of a word between ASCII word boundaries."""
    return rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"


def word_columns(line: Column | str, word: str) -> Column:
    """0-based character columns of every whole occurrence of a word in a line.

    Splitting at the word keeps the pieces between occurrences, so that running lengths
    are the columns; nothing leaves the JVM.
    """
    pieces = F.transform(F.split(col(line), whole_word(word), -1), lambda p: F.length(p))
    ends = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(word), F.lit(0)) + n)),
    )
    return F.when(F.size(pieces) > 1, ends).otherwise(F.array().cast("array<int>"))


def in_code(line: Column | str, column: Column) -> Column:
    """Whether a column lies before any // and outside double-quoted strings."""
    text = col(line)
    comment = F.instr(text, "//")
    before = F.regexp_replace(F.substring(text, F.lit(1), column), r"\\.", "")
    quotes = F.length(before) - F.length(F.replace(before, F.lit('"'), F.lit("")))
    return ((comment == 0) | (column < comment - 1)) & (quotes % 2 == 0)


def usage_kind(line: Column | str, column: Column, word: str) -> Column:
    """declaration, definition, call, write or read, by what stands around the word."""
    text = col(line)
    left = F.rtrim(F.substring(text, F.lit(1), column), F.lit(_WHITE))
    right = F.ltrim(F.substring(text, column + 1 + len(word), F.length(text)), F.lit(_WHITE))
    assigned = right.startswith("=") | F.substring(right, 1, 2).isin("+=", "-=", "*=", "/=")
    return (
        F.when(text.contains("UPROPERTY(") | text.contains("UFUNCTION("), "declaration")
        .when(left.contains("::") & right.startswith("("), "definition")
        .when(right.startswith("("), "call").when(assigned, "write").otherwise("read")
    )


def asset_path(path: Column | str) -> Column:
    """Logical path of a content file: .../Content/A/B.uasset becomes /Game/A/B."""
    return F.concat(F.lit("/Game/"), F.regexp_replace(F.substring_index(normalize_path(path, "none"), "/Content/", -1), r"\.[^./]*$", ""))


def shown_value(kind: Column, scalar: Column, items: Column) -> Column:
    """Display form of a configuration value: nil, at most 50 characters, or a count and
    the last of an array."""
    short = F.when(F.length(scalar) > 50, F.concat(F.substring(scalar, 1, 47), F.lit("..."))).otherwise(scalar)
    array = F.concat(F.lit("[Array x"), F.size(items).cast("string"), F.lit("] "), F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit("")))
    return F.when(kind == "null", "nil").when(kind == "array", array).otherwise(short)
