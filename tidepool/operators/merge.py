"""Merging of mates: variants of forward and reverse reads that overlap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.kernels import compared
from tidepool.functions.sequences import reverse_complement


@dataclass(frozen=True)
class MergeConfig:
    min_overlap: int = 20
    max_mismatches: int = 0
    just_concatenate: bool = False


def merge_pairs(fwd: DataFrame, rev: DataFrame, config: MergeConfig = MergeConfig()) -> DataFrame:
    """(sample, fwd_seq, rev_seq, seq, abundance, overlap, mismatches) of every forward and reverse variant
    of a sample, asvs(sample, seq, abundance), with a valid overlap.

    The best overlap has the fewest mismatches, of those the longest. The first min_overlap letters of the
    reversed mate, cut into max_mismatches + 1 pieces, have one piece at least that stands unchanged in the
    forward read, so candidates come from an equi-join on pieces and not from all pairs. With
    just_concatenate the whole mate is appended, but an overlap is still required. seq is not made
    distinct: two pairs may give the same.
    """
    c = config
    if c.min_overlap <= c.max_mismatches:
        raise ValueError("min_overlap must be greater than max_mismatches")
    k = c.max_mismatches + 1
    cuts = [c.min_overlap * i // k for i in range(k + 1)]
    f = fwd.select("sample", F.col("seq").alias("fwd_seq"), F.col("abundance").alias("fwd_n")).where(F.length("fwd_seq") >= c.min_overlap)
    r = rev.select("sample", F.col("seq").alias("rev_seq"), reverse_complement(F.col("seq")).alias("mate"), F.col("abundance").alias("rev_n")).where(F.length("mate") >= c.min_overlap)
    pieces = F.array(*(F.struct(F.lit(i).alias("no"), F.substring("mate", cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("piece")) for i in range(k)))
    r_keys = r.select("*", F.explode(pieces).alias("x")).select("sample", "rev_seq", "mate", "rev_n", "x.no", "x.piece")
    # A piece can stand where the overlap's start leaves min_overlap letters or more to the read's end.
    starts = F.sequence(F.lit(0), F.length("fwd_seq") - c.min_overlap)
    pieces_at = lambda s: F.array(*(F.struct(F.lit(i).alias("no"), F.substring(F.col("fwd_seq"), s + (cuts[i] + 1), F.lit(cuts[i + 1] - cuts[i])).alias("piece")) for i in range(k)))
    places = F.flatten(F.transform(starts, pieces_at))
    f_keys = f.select("*", F.explode(F.array_distinct(places)).alias("x")).select("sample", "fwd_seq", "fwd_n", "x.no", "x.piece")
    parts = int(fwd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = f_keys.join(r_keys, ["sample", "no", "piece"]).select("sample", "fwd_seq", "rev_seq", "mate", "fwd_n", "rev_n")
    # Dealt by the pair, to a number of partitions that is kept: one shuffle makes pairs distinct and spreads them.
    pairs = pairs.repartition(parts, "sample", "fwd_seq", "rev_seq").distinct()

    def best(x, y, more):
        """The overlap with the fewest mismatches, tried from the longest."""
        least, chosen = np.full(len(x), c.max_mismatches + 1), np.zeros(len(x), np.int64)
        for n in range(min(x.shape[1], y.shape[1]), c.min_overlap - 1, -1):
            wrong = (x[:, x.shape[1] - n :] != y[:, :n]).sum(axis=1)
            better = wrong < least
            least[better], chosen[better] = wrong[better], n
        return {"overlap": chosen, "mismatches": least, "valid": chosen > 0}

    found = compared(pairs, "fwd_seq", "mate", "overlap int, mismatches int", best)
    rest = F.col("mate") if c.just_concatenate else F.substring(F.col("mate"), F.col("overlap") + 1, F.length("mate"))
    return found.select("sample", "fwd_seq", "rev_seq", F.concat("fwd_seq", rest).alias("seq"), F.least("fwd_n", "rev_n").alias("abundance"), "overlap", "mismatches")


def merger_table(merged: DataFrame) -> DataFrame:
    """merge_pairs' rows under the columns that stepwise users know; nmatch is the overlap's length."""
    return merged.select("sample", F.col("seq").alias("sequence"), "abundance", F.col("overlap").alias("nmatch"), F.col("mismatches").alias("nmismatch"), F.lit(0).alias("nindel"), F.lit(True).alias("accept"), F.col("overlap").alias("overlap_len"))
