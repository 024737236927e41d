"""Scalar functions on text and bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "0.0.0"


def chomp(text: Column) -> Column:
    """Without one line end: CRLF, CR, LF, VT or FF."""
    return F.regexp_replace(text, r"(?:\r\n|[\r\n\x0b\f])\z", "")


def trim(text: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def ltrim(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\n\r\x0b\f"))


def rtrim(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\r\x0b\f"))


def starts_with(text: Column, prefix: str) -> Column:
    return F.startswith(text, F.lit(prefix))


def ends_with(text: Column, suffix: str) -> Column:
    return F.endswith(text, F.lit(suffix))


def insert(text: Column, at: int, part: str) -> Column:
    """``part`` before the character number ``at`` (from 0)."""
    return F.overlay(text, F.lit(part), F.lit(at + 1), F.lit(0))


def delete(text: Column, at: int, length: int) -> Column:
    return F.overlay(text, F.lit(""), F.lit(at + 1), F.lit(length))


def subreplace(text: Column, part: str, at: int, length: int) -> Column:
    return F.overlay(text, F.lit(part), F.lit(at + 1), F.lit(length))


def formatted(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def json_quoted(text: Column) -> Column:
    """A JSON string with quotes; the slash is escaped too."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("/", "\\/"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def find(text: Column, part: str, fold: bool = False) -> Column:
    """The first place of ``part`` (from 0), null if there is none; ``fold`` disregards ASCII case."""
    up = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    at = F.locate(part.upper(), up(text)) if fold and part.isascii() else F.locate(part, text)
    return F.nullif(at, F.lit(0)) - 1


def equal_fold(a: Column, b: Column) -> Column:
    """Equality without regard to ASCII case; other letters must be the same."""
    up = lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return up(a) == up(b)


def as_bool(text: Column) -> Column:
    """Empty, on and true are true, off and false are false; else whether the leading number isn't 0."""
    low = F.lower(text)
    return F.when(low.isin("", "on", "true"), F.lit(True)).when(low.isin("off", "false"), F.lit(False)).otherwise(as_int(text) != 0)


def as_int(text: Column) -> Column:
    """The leading decimal number after white space, 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def guess_encoding(data: Column, utf8: str | Column = "UTF-8") -> Column:
    """By the byte order mark, else by where the first four bytes are zero, else ``utf8`` of valid UTF-8; null if nothing tells."""
    head = F.hex(F.substring(data, 1, 4))
    # Marks, longest first, and patterns of zero bytes.
    marks = (("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))
    zeros = (("^000000(?!00)..$", "UTF-32BE"), ("^(?!00)..000000$", "UTF-32LE"), ("^00(?!00)..00(?!00)..$", "UTF-16BE"), ("^(?!00)..00(?!00)..00$", "UTF-16LE"))
    out = F.lit(None).cast("string")
    for pattern, name in reversed(zeros):
        out = F.when(head.rlike(pattern), F.lit(name)).otherwise(out)
    for mark, name in reversed(marks):
        out = F.when(head.startswith(mark), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.when(F.is_valid_utf8(data.cast("string")), F.lit(utf8) if isinstance(utf8, str) else utf8))


def first_bad_utf8(data: Column) -> Column:
    """The place of the first byte that isn't UTF-8, from 0; null for valid data."""
    fixed = F.encode(F.make_valid_utf8(data.cast("string")), "UTF-8")
    part = lambda c, n: F.substr(c, F.lit(1), n)

    def halve(found: Column, _: Column) -> Column:
        """Bounds of the number of bytes that are the same: each step compares one beginning."""
        middle = F.ceil((found["low"] + found["high"]) / 2).cast("int")
        same = part(data, middle) == part(fixed, middle)
        return F.struct(F.when(same, middle).otherwise(found["low"]).alias("low"), F.when(same, found["high"]).otherwise(middle - 1).alias("high"))

    bounds = F.struct(F.lit(0).alias("low"), F.least(F.octet_length(data), F.octet_length(fixed)).alias("high"))
    same = F.aggregate(F.sequence(F.lit(1), F.lit(32)), bounds, halve, lambda found: found["low"])
    return F.when(~F.is_valid_utf8(data.cast("string")), same)


def to_utf8(data: Column, encoding: Column) -> Column:
    """Text of bytes in one of the encodings that ``guess_encoding`` tells; null for others."""
    out = F.lit(None).cast("string")
    for name in ("UTF-32LE", "UTF-32BE", "UTF-16LE", "UTF-16BE", "UTF-8"):
        out = F.when(encoding == name, F.decode(data, name if name.startswith(("UTF-16", "UTF-8")) else "UTF-32")).otherwise(out)
    return F.regexp_replace(out, "^﻿", "")


def is_binary(data: Column) -> Column:
    """Whether one of the first 1,024 bytes is zero."""
    return F.contains(F.substring(data, 1, 1024), F.unhex(F.lit("00")))
