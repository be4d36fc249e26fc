"""Primer search at both ends of reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.sequences import hamming, let

#: Bases beyond a primer's length that are searched.
SLACK = 5

# The bases of the ambiguity codes.
AMBIGUOUS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


@dataclass(frozen=True)
class PrimerConfig:
    """A primer that is empty isn't looked for. With iupac, a primer's ambiguity codes match their bases;
    without, they match themselves only."""

    fwd: str = ""
    rev: str = ""
    max_mismatches: int = 0
    min_overlap: int = 10
    iupac: bool = False


def _differences(part: Column, primer: str, n: Column, iupac: bool) -> Column:
    if not iupac:
        return hamming(part, F.substring(F.lit(primer), F.lit(1), n))
    wrong = [F.when((n > i) & ~F.substring(part, i + 1, 1).isin(*AMBIGUOUS.get(b, b), b), 1).otherwise(0) for i, b in enumerate(primer)]
    return sum(wrong[1:], wrong[0])


def _first(starts: Column, fits) -> Column:
    """The first start that fits, or null."""
    return F.get(F.filter(starts, fits), F.lit(0))


def _range(low: Column, high: Column) -> Column:
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def primer_start(seq: Column, config: PrimerConfig) -> Column:
    """Where the read begins after its 5' primer; null if it isn't there. The primer may be cut off by the
    end of the searched bases, down to min_overlap."""
    if not config.fwd:
        return F.lit(0)

    def search(s: Column) -> Column:
        end = F.least(F.lit(len(config.fwd) + SLACK), F.length(s))
        size = lambda i: F.least(F.lit(len(config.fwd)), end - i)
        at = _first(_range(F.lit(0), end - config.min_overlap), lambda i: _differences(F.substring(s, i + 1, size(i)), config.fwd, size(i), config.iupac) <= config.max_mismatches)
        return F.when(F.length(s) >= config.min_overlap, let(at, lambda i: i + size(i)))

    return let(seq, search)


def primer_end(seq: Column, config: PrimerConfig) -> Column:
    """Where the read ends before its 3' primer; null if it isn't there."""
    if not config.rev:
        return F.length(seq)

    def search(s: Column) -> Column:
        size = lambda i: F.least(F.lit(len(config.rev)), F.length(s) - i)
        low = F.greatest(F.length(s) - (len(config.rev) + SLACK), F.lit(0))
        return _first(_range(low, F.length(s) - config.min_overlap), lambda i: _differences(F.substring(s, i + 1, size(i)), config.rev, size(i), config.iupac) <= config.max_mismatches)

    return let(seq, search)


def located(reads: DataFrame, config: PrimerConfig) -> DataFrame:
    """reads with `start`, `stop` and whether they `pass`."""
    out = reads.withColumns({"start": primer_start(F.col("seq"), config), "stop": primer_end(F.col("seq"), config)})
    return out.withColumn("passes", F.coalesce(F.col("start") < F.col("stop"), F.lit(False)))


def trim_primers(reads: DataFrame, config: PrimerConfig) -> DataFrame:
    """The reads with both primers, without them. Qualities that don't reach as far are left out."""
    part = lambda c: F.substring(F.col(c), F.col("start") + 1, F.col("stop") - F.col("start"))
    kept = located(reads, config).where("passes")
    qual = F.when(F.length("qual") >= F.col("stop"), part("qual")).otherwise(F.lit(""))
    return kept.withColumns({"seq": part("seq"), "qual": qual}).drop("start", "stop", "passes")


def primer_stats(reads: DataFrame, config: PrimerConfig) -> DataFrame:
    return located(reads, config).groupBy("sample").agg(F.count("*").alias("reads_in"), F.count_if("passes").alias("reads_out"))


def remove_primers(reads: DataFrame, fwd: str = "", rev: str = "", max_mismatches: int = 2, min_overlap: int = 4, orient: bool = True, allow_indels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads without primers, stats) with the defaults of the stepwise interface. `orient` is accepted and
    has no effect; indels are an error, as primers are compared letter by letter."""
    if allow_indels:
        raise ValueError("allow_indels is not supported: primers are compared letter by letter")
    config = PrimerConfig(fwd, rev, max_mismatches, min_overlap)
    return trim_primers(reads, config), primer_stats(reads, config)
