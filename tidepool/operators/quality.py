"""Quality profiles and what the qualities say about the platform."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.kernels import codes, matrices

MAX_QUAL = 41


def _profiled(batches):
    """For each batch the histogram (g, cycle, q) of scores capped at 41, with at most as many rows as it has
    samples, cycles and scores."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("g").dictionary_encode()
        number = pc.fill_null(group.indices, len(group.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        width = int(pc.max(pc.utf8_length(batch.column("qual"))).as_py() or 0)
        for i, j, code, inside in matrices(batch.column("qual")):
            q = np.minimum(np.maximum(code.astype(np.int64) - 33, 0), MAX_QUAL)
            at = (number[i:j, None] * width + np.arange(code.shape[1])[None]) * (MAX_QUAL + 1) + q
            found.append(np.unique(at[inside], return_counts=True))
        at, n = (np.concatenate(x) for x in zip(*found))
        g = pa.array(at // ((MAX_QUAL + 1) * max(width, 1)))
        names = pa.concat_arrays([group.dictionary, pa.nulls(1, group.dictionary.type)]).take(g)
        yield pa.RecordBatch.from_arrays([names, pa.array((at // (MAX_QUAL + 1) % max(width, 1)).astype(np.int32)), pa.array((at % (MAX_QUAL + 1)).astype(np.int32)), pa.array(n)], ["g", "cycle", "q", "n"])


def quality_profile(reads: DataFrame, n_reads: int = 0, by: str = "sample") -> DataFrame:
    """(by, cycle, mean, p25, p50, p75, cnt) with scores capped at 41. Percentiles are nearest rank.

    Only a histogram of 42 scores for each cycle is shuffled, whatever the number of reads; percentiles
    come from its running sums. n_reads > 0 takes each file's first reads.
    """
    some = reads.where(F.col("rec") < n_reads) if n_reads else reads
    kind = dict(reads.dtypes)[by]
    parts = some.select(F.col(f"`{by}`").alias("g"), "qual").mapInArrow(_profiled, f"g {kind}, cycle int, q int, n bigint")
    hist = parts.groupBy(F.col("g").alias(by), "cycle", "q").agg(F.sum("n").alias("n"))
    place = Window.partitionBy(by, "cycle")
    ranked = hist.withColumn("cnt", F.sum("n").over(place)).withColumn("upto", F.sum("n").over(place.orderBy("q")))
    rank = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("cnt") * F.lit(p)), F.col("q")))
    return ranked.groupBy(by, "cycle").agg(
        (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean"), rank(0.25).alias("p25"), rank(0.5).alias("p50"), rank(0.75).alias("p75"), F.max("cnt").alias("cnt")
    )


#: Scores that a histogram tells apart; a character beyond counts as the last.
_SCORES = 256


def _counted(batches):
    """(g, q, n): n of the scores q of each group, and with q -1 and -2 its reads and their letters."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("g").dictionary_encode()
        number = pc.fill_null(group.indices, len(group.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        data, lens = codes(batch.column("qual"))
        size = len(group.dictionary) + 1
        q = np.minimum(np.maximum(data.astype(np.int64) - 33, 0), _SCORES - 1)
        n = np.bincount(np.repeat(number, lens) * _SCORES + q, minlength=size * _SCORES)
        known = ~np.asarray(batch.column("qual").is_null())
        found = np.flatnonzero(n)
        g = np.r_[found // _SCORES, np.arange(size), np.arange(size)]
        more = np.r_[n[found], np.bincount(number, known, size), np.bincount(number, lens, size)].astype(np.int64)
        names = pa.concat_arrays([group.dictionary, pa.nulls(1, group.dictionary.type)]).take(pa.array(g))
        yield pa.RecordBatch.from_arrays([names, pa.array(np.r_[found % _SCORES, np.full(size, -1), np.full(size, -2)].astype(np.int32)), pa.array(more)], ["g", "q", "n"])


def quality_stats(reads: DataFrame, by: str | None = None) -> DataFrame:
    """(distinct scores, mean, greatest, mean read length). Batches are counted in numpy, so a histogram of
    scores is all that is shuffled."""
    kind = dict(reads.dtypes)[by] if by else "int"
    group = F.col(f"`{by}`") if by else F.lit(0)
    hist = reads.select(group.alias("g"), "qual").mapInArrow(_counted, f"g {kind}, q int, n bigint").where("n > 0").groupBy("g", "q").agg(F.sum("n").alias("n"))
    score, of = F.col("q") >= 0, lambda mark: F.sum(F.when(F.col("q") == mark, F.col("n")))
    out = (hist.groupBy("g") if by else hist).agg(
        F.count_distinct(F.when(score, F.least("q", F.lit(95)))).alias("distinct_q"), (F.sum(F.when(score, F.col("q") * F.col("n"))) / F.sum(F.when(score, F.col("n")))).alias("mean_q"),
        F.max(F.when(score, F.col("q"))).alias("max_q"), (of(-2) / of(-1)).alias("mean_len"),
    )
    return out.withColumnRenamed("g", by) if by else out


def detect_platform(reads: DataFrame, by: str | None = None) -> DataFrame:
    """quality_stats with the error function that suits them, and whether reads look like long noisy ones."""
    kind = F.when((F.col("mean_q") >= 35) & (F.col("distinct_q") <= 8), "pacbio").when(F.col("distinct_q") <= 12, "binned").otherwise("loess")
    return quality_stats(reads, by).withColumn("kind", kind).withColumn("noisy_long_reads", (F.col("kind") == "loess") & (F.col("mean_q") < 20) & (F.col("mean_len") > 500))
