"""Columns over delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def atol(text: Column) -> Column:
    """The integer that leads the text after white space; 0 if there is none, as C's atol."""
    return F.coalesce(F.regexp_extract(text, "^[ \\t\\n\\x0B\\f\\r]*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("long"))


def split_char(text: Column, char: str) -> Column:
    """Split at each ``char``; empty parts stay."""
    return F.split(text, "\\Q" + char + "\\E", -1)


def split_any(text: Column, chars: str) -> Column:
    """Split at each of ``chars``; empty parts stay."""
    return F.split(text, "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]", -1)


def ucsc(text: Column) -> Column:
    """struct<chrom, start, end, error> of ``chr:start-end`` or ``chr:pos``; positions are taken as they are."""
    place = F.regexp_extract(text, "^[^:]*:(.*)$", 1)
    colon = text.contains(":")
    legal = place.rlike("^[0-9]+(-[0-9]+)?$")
    start = F.regexp_extract(place, "^([0-9]+)", 1).try_cast("bigint")
    end = F.when(place.contains("-"), F.regexp_extract(place, "-([0-9]+)$", 1).try_cast("bigint")).otherwise(start + 1)
    ok = colon & legal
    error = F.when(~colon, "no colon").when(~legal, "illegal character").otherwise("")
    return F.struct(F.when(ok, F.substring_index(text, ":", 1)).otherwise("").alias("chrom"), F.when(ok, start).otherwise(-1).alias("start"), F.when(ok, end).otherwise(-1).alias("end"), error.alias("error"))


def unescape(cell: Column) -> Column:
    """The escapes ``\\n \\t \\r \\\\`` of a table cell as characters; another escape is an error (null)."""
    marked = F.regexp_replace(cell, "\\\\\\\\", "\u0001")
    wrong = marked.rlike("\\\\([^ntr]|$)")
    for letter, char in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        marked = F.replace(marked, F.lit("\\" + letter), F.lit(char))
    return F.when(~wrong, F.replace(marked, F.lit("\u0001"), F.lit("\\")))


def escape(cell: Column) -> Column:
    out = F.replace(cell, F.lit("\\"), F.lit("\\\\"))
    for letter, char in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return out


def hex_byte(text: Column) -> Column:
    """The value of two hexadecimal digits; null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{2}$"), F.conv(text, 16, 10).cast("int"))


def span_of(text: Column, chars: str) -> Column:
    """Length of the leading part made of ``chars`` only."""
    return F.length(F.regexp_extract(text, "^([" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]*)", 1))


def span_until(text: Column, chars: str) -> Column:
    """Length of the leading part without any of ``chars``."""
    return F.length(F.regexp_extract(text, "(?s)^([^" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]*)", 1))


def find(text: Column, part: Column) -> Column:
    """Place of the first occurrence, from 0; the length of the text if there is none."""
    at = F.call_function("locate", part, text)
    return F.when(at == 0, F.length(text)).otherwise(at - 1)


def differ_at(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    places = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.get(places, 0) - 1, n)
