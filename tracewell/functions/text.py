"""Text as columns: folding, keys, tokens, similarity, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN_MARKS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def normalised(text: Column) -> Column:
    """Zero-width characters and soft hyphens removed, line ends unified, trimmed. Composed text is left as it is."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[​-‍⁠﻿­]", "")
    return F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"^\s+|\s+$", "")


def folded(text: Column) -> Column:
    """For matching only: lower-cased, plain quotes, single blanks."""
    t = F.translate(F.lower(normalised(text)), "‘’‛`´“”«»", "'''''\"\"\"\"")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def stripped(text: Column) -> Column:
    """Lower-cased without Latin diacritics."""
    return F.translate(F.lower(text), *LATIN_MARKS)


def input_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def sender_key(sender: Column) -> Column:
    """Digits only if there are any (eight or fewer get the country prefix 230), else lower-cased with single blanks."""
    digits = F.regexp_replace(sender, "[^0-9]", "")
    name = F.trim(F.regexp_replace(F.lower(sender), r"\s+", " "))
    return F.when(digits == "", F.nullif(name, F.lit(""))).when((F.length(digits) <= 8) & ~F.startswith(digits, F.lit("230")), F.concat(F.lit("230"), digits)).otherwise(digits)


def masked(identifier: Column) -> Column:
    """Phone-shaped identifiers show their last four digits only."""
    digits = F.regexp_replace(identifier, "[^0-9]", "")
    return F.when(F.length(digits) >= 6, F.concat(F.lit("•••• "), F.right(digits, F.lit(4)))).otherwise(identifier)


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; ends at the last line end, else blank, beyond four fifths of that if there is one."""
    head = F.left(text, F.lit(limit))
    at = lambda mark: limit - F.instr(F.reverse(head), mark)
    has = lambda mark: (F.instr(head, mark) > 0) & (at(mark) >= limit * 8 // 10)
    return F.when(F.length(text) <= limit, text).when(has("\n"), F.rtrim(F.left(head, at("\n")))).when(has(" "), F.rtrim(F.left(head, at(" ")))).otherwise(head)


def iban_ok(text: Column) -> Column:
    """Shape and check digits (modulo 97) of an account number."""
    t = F.upper(F.regexp_replace(text, r"\s", ""))
    moved = F.concat(F.substring(t, 5, 1000), F.left(t, F.lit(4)))
    value = lambda c: F.when(F.rlike(c, F.lit("[0-9]")), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda r, c: (F.when(value(c) > 9, r * 100).otherwise(r * 10) + value(c)) % 97)
    return F.rlike(t, F.lit(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")) & (rest == 1)


def half_up(x: Column) -> Column:
    """Nearest whole number, halves toward plus infinity."""
    return F.floor(x + 0.5).cast("long")


def tokens(text: Column) -> Column:
    """Distinct letter runs of two or more, stripped of marks."""
    return F.array_distinct(F.regexp_extract_all(stripped(text), F.lit("[a-z]{2,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))
