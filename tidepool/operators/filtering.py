"""Filtering and trimming of reads, alone and in pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tidepool.functions.kernels import map_arrow, matrices

#: Probability of a wrong base at each score; beyond these it is below every sum's last digit.
_PROBABILITY = 10.0 ** (-np.arange(256) / 10.0)


@dataclass(frozen=True)
class FilterConfig:
    """trunc_len 0 doesn't truncate; the other lengths count bases."""

    trunc_len: int = 0
    min_len: int = 20
    max_ee: float = 2.0
    trunc_q: int = 2
    trim_left: int = 0
    trim_right: int = 0


def trimmed(reads: DataFrame, config: FilterConfig) -> DataFrame:
    """reads with `start` and `len` of what is left of each, its expected errors `ee` and whether it `passes`.

    In this order: both ends are cut (a read no longer than a cut is dropped), the read ends before its
    first base with a score of trunc_q or less, reads shorter than trunc_len are dropped and longer ones
    cut, reads shorter than min_len are dropped, and those with more than max_ee expected errors. A read
    whose qualities are missing has no score to end at and no expected errors.

    One pass over Arrow batches: errors are running sums along each read, in its order, so that every trim
    is made once, whatever is filtered or chosen later.
    """
    c = config
    added = _parse_datatype_string("start int, len int, ee double, passes boolean")

    def judge(size: np.ndarray, qual: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, score, inside in matrices(qual, fill=33):
            inner = np.maximum(size[i:j] - c.trim_left - c.trim_right, 0)
            score = np.maximum(score.astype(np.int64) - 33, 0)[:, c.trim_left :]
            inside = inside[:, c.trim_left :] & (np.arange(score.shape[1])[None] < inner[:, None])
            low = (score <= c.trunc_q) & inside
            length = np.where(low.any(axis=1), low.argmax(axis=1) if low.shape[1] else 0, inner)
            passes = np.ones(j - i, bool)
            if c.trim_left > 0:
                passes &= size[i:j] > c.trim_left
            if c.trim_right > 0:
                passes &= size[i:j] - c.trim_left > c.trim_right
            if c.trunc_len > 0:
                passes &= length >= c.trunc_len
                length = np.minimum(length, c.trunc_len)
            errors = np.where(inside, _PROBABILITY[np.minimum(score, len(_PROBABILITY) - 1)], 0.0)
            sums = np.hstack([np.zeros((j - i, 1)), np.cumsum(errors, axis=1)])
            ee = np.take_along_axis(sums, np.minimum(length, sums.shape[1] - 1)[:, None], 1)[:, 0]
            yield length, ee, passes & (length >= c.min_len) & (ee <= c.max_ee)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.fill_null(pc.utf8_length(batch.column("seq")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            length, ee, passes = (np.concatenate(x) for x in zip(*judge(size, batch.column("qual"))))
            more = [pa.array(np.full(batch.num_rows, c.trim_left, np.int32)), pa.array(length.astype(np.int32)), pa.array(ee), pa.array(passes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    names = [*reads.columns, *added.names]
    return map_arrow(reads, run, StructType([*reads.schema.fields, *added.fields]))


def cut(column: str) -> Column:
    return F.substring(F.col(column), F.col("start") + 1, F.col("len"))


def filter_reads(reads: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """The reads that pass, cut, with their expected errors."""
    if config.max_ee < 0:
        raise ValueError("max_ee must not be negative")
    kept = trimmed(reads, config).where("passes")
    return kept.withColumns({"seq": cut("seq"), "qual": cut("qual")}).drop("start", "len", "passes")


def filter_stats(reads: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """(sample, reads_in, reads_out)."""
    if config.max_ee < 0:
        raise ValueError("max_ee must not be negative")
    return trimmed(reads, config).groupBy("sample").agg(F.count("*").alias("reads_in"), F.count_if("passes").alias("reads_out"))


def paired(fwd: DataFrame, rev: DataFrame, fwd_config: FilterConfig, rev_config: FilterConfig) -> DataFrame:
    """Mates by place in their files: (sample, rec, both reads as f and r). Ids aren't compared. A record
    without a mate is an error when the rows are computed: the join keeps both sides' rows to see it."""
    side = lambda df, c, name: trimmed(df.select("sample", "rec", "id", "seq", "qual"), c).select("sample", "rec", F.struct("id", cut("seq").alias("seq"), cut("qual").alias("qual"), "ee", "passes").alias(name))
    both = side(fwd, fwd_config, "f").join(side(rev, rev_config, "r"), ["sample", "rec"], "full")
    wrong = F.raise_error(F.concat(F.lit("mates differ in number: sample "), F.col("sample"), F.lit(", record "), F.col("rec").cast("string")))
    # Whatever reads a mate sees the error; a filter of its own would turn the join into an inner one.
    return both.select("sample", "rec", F.coalesce("f", wrong).alias("f"), F.coalesce("r", wrong).alias("r"))


def filter_pairs(fwd: DataFrame, rev: DataFrame, fwd_config: FilterConfig, rev_config: FilterConfig) -> DataFrame:
    """(sample, rec, fwd_seq, fwd_qual, rev_seq, rev_qual) of the pairs of which both mates pass."""
    kept = paired(fwd, rev, fwd_config, rev_config).where("f.passes and r.passes")
    return kept.select("sample", "rec", F.col("f.id").alias("id"), *(F.col(f"{a}.{x}").alias(f"{b}_{x}") for a, b in (("f", "fwd"), ("r", "rev")) for x in ("seq", "qual")))


def pair_stats(fwd: DataFrame, rev: DataFrame, fwd_config: FilterConfig, rev_config: FilterConfig) -> DataFrame:
    f, r = F.col("f.passes"), F.col("r.passes")
    return paired(fwd, rev, fwd_config, rev_config).groupBy("sample").agg(
        F.count("*").alias("reads_in"), F.count_if(f & r).alias("pairs_out"), F.count_if(~f & r).alias("fwd_failed"), F.count_if(f & ~r).alias("rev_failed"), F.count_if(~f & ~r).alias("both_failed")
    )
