"""Sequence and quality expressions, all JVM-side.

Sequences are strings, qualities strings of Phred + 33 characters or arrays of scores. Positions count
from 0, as in the formulas of the field; null means that there is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def let(value: Column, body) -> Column:
    """body(value), where body sees the value and not the expression: what stands inside a higher-order
    function would otherwise be computed again for each element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def phred(qual: Column) -> Column:
    """Scores of a quality string; characters below '!' count as 0."""
    return F.transform(letters(qual), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0)))


def quality_string(scores: Column) -> Column:
    return F.array_join(F.transform(scores, lambda q: F.char(q + 33)), "")


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def expected_errors(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda s, q: s + error_probability(q))


def mean_quality(scores: Column) -> Column:
    """0 for a read without scores."""
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda s, q: s + q)
    return F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(F.lit(0.0))


def has_low_quality_window(scores: Column, least: float, width: int) -> Column:
    """Whether the mean of any `width` neighbouring scores is below `least`."""

    def search(q: Column) -> Column:
        total = lambda i: F.aggregate(F.slice(q, i, F.lit(width)), F.lit(0), lambda s, x: s + x)
        starts = F.when(F.size(q) >= width, F.sequence(F.lit(1), F.size(q) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: total(i) < F.lit(least * width))

    return let(scores, search)


def mismatches(a: Column, b: Column) -> Column:
    """Whether the letters differ, over the common length."""
    n = F.least(F.length(a), F.length(b))
    return F.zip_with(letters(F.substring(a, F.lit(1), n)), letters(F.substring(b, F.lit(1), n)), lambda x, y: x != y)


def hamming(a: Column, b: Column) -> Column:
    """Differing letters over the common length."""
    return F.size(F.filter(mismatches(a, b), lambda d: d))


def first_mismatch(a: Column, b: Column) -> Column:
    at = F.array_position(mismatches(a, b), True)
    return F.when(at > 0, at - 1)


def range_equal(a: Column, b: Column, start: Column, end: Column) -> Column:
    """Whether [start, end) is equal; bounds beyond either end are drawn in, an empty range is equal."""
    to = F.least(end, F.length(a), F.length(b))
    n = F.greatest(to - start, F.lit(0))
    return F.substring(a, start + 1, n) == F.substring(b, start + 1, n)


def reverse_complement(seq: Column) -> Column:
    """Upper-cased; what isn't a base is N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGTN", "TGCAN"))


def base_index(base: Column) -> Column:
    """A 0, C 1, G 2, T 3; anything else counts as A."""
    up = F.upper(base)
    return F.when(up == "C", 1).when(up == "G", 2).when(up == "T", 3).otherwise(0)


def kmers(seq: Column, k: int) -> Column:
    """The upper-cased k-mers of bases only, in order."""

    def cut(up: Column) -> Column:
        starts = F.when(F.length(up) >= k, F.sequence(F.lit(1), F.length(up) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: F.substring(up, i, F.lit(k))), lambda x: x.rlike("^[ACGT]+$"))

    return let(F.upper(seq), cut)


def hex_key(seq: Column) -> Column:
    """Lower-case hex of the sequence's bytes, the name of a variant."""
    return F.lower(F.hex(seq))
