"""Dereplication: distinct sequences with their numbers and summed qualities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.kernels import codes


#: Reads that a task sums at a time, and values that it merges at a time.
_READS, _VALUES = 200_000, 4_000_000


def _numbered(column) -> tuple[np.ndarray, pa.Array]:
    """(number of each value, the values by number); null has the last number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    own = column.dictionary_encode()
    number = pc.fill_null(own.indices, len(own.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    return number, pa.concat_arrays([own.dictionary, pa.nulls(1, own.dictionary.type)])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _sums(reads: pa.Table) -> pa.RecordBatch:
    """The distinct (g, seq) with an array of their number and the summed scores of each position;
    qualities of several lengths give a row each."""
    g, names = _numbered(reads.column("g"))
    s, seqs = _numbered(reads.column("seq"))
    data, lens = codes(reads.column("qual"))
    width = int(lens.max(initial=0)) + 1
    keys, group, number = np.unique((g * len(seqs) + s) * width + lens, return_inverse=True, return_counts=True)
    size = keys % width
    sizes = size + 1
    out, first = np.zeros(sizes.sum(), np.int64), np.cumsum(sizes) - sizes
    out[first] = number
    start = np.cumsum(lens) - lens
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(lens == n)
        rows = rows[np.argsort(group[rows], kind="stable")]
        bounds = np.flatnonzero(np.r_[True, np.diff(group[rows]) > 0])
        step = max(1, _VALUES // int(n))
        for i in range(0, len(rows), step):  # whole matrices of bounded size; a group that is cut adds up
            part = rows[i : i + step]
            at = np.unique(np.r_[0, bounds[(bounds > i) & (bounds < i + step)] - i])
            score = np.maximum(data[start[part][:, None] + np.arange(n)].astype(np.int64) - 33, 0)
            out[first[group[part[at]]][:, None] + 1 + np.arange(n)] += np.add.reduceat(score, at, axis=0)
    key = keys // width
    return pa.RecordBatch.from_arrays([names.take(pa.array(key // len(seqs))), seqs.take(pa.array(key % len(seqs))), _lists(out, sizes)], ["g", "seq", "v"])


def _summed(batches):
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= _READS:
            yield _sums(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _sums(pa.Table.from_batches(held))


def _merged(batches):
    """Sums of the arrays of equal (g, seq), which stand together; the last of a batch waits for the next."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        g, s = _numbered(rows.column("g"))[0], _numbered(rows.column("seq"))[0]
        first = np.flatnonzero(np.r_[True, (np.diff(g) != 0) | (np.diff(s) != 0)])
        v = rows.column("v").combine_chunks()
        lens = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.maximum.reduceat(lens, first)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(lens)]))
        at = np.repeat((np.cumsum(sizes) - sizes)[group] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        out = np.zeros(sizes.sum(), np.int64)
        np.add.at(out, at, v.flatten().to_numpy())
        done = pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(pa.array(first)) for c in ("g", "seq")] + [_lists(out, sizes)], ["g", "seq", "v"])
        rest = done.slice(len(done) - 1)
        if len(done) > 1:
            yield done.slice(0, len(done) - 1)
    if rest is not None:
        yield rest


def dereplicate(reads: DataFrame, by: str = "sample") -> DataFrame:
    """uniques(by, seq, cnt, qual_sum): qual_sum holds the sum of the scores at each position. Sequences
    are compared as they are, case included; a read without qualities counts, and adds to no sum. Tasks sum
    their reads in numpy first, so a sequence that makes up most of the reads sends a row or two a task;
    the sums of a sequence then meet in order and are added up as they come."""
    kind = dict(reads.dtypes)[by]
    schema = f"g {kind}, seq string, v array<bigint>"
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = reads.select(F.col(f"`{by}`").alias("g"), "seq", "qual").mapInArrow(_summed, schema)
    gathered = partial.repartition(parts, "g", "seq").sortWithinPartitions("g", "seq").mapInArrow(_merged, schema)
    return gathered.select(F.col("g").alias(by), "seq", F.col("v")[0].alias("cnt"), F.transform(F.slice("v", F.lit(2), F.size("v") - 1), lambda x: x.cast("double")).alias("qual_sum"))


def counts(reads: DataFrame, by: str = "sample") -> DataFrame:
    """uniques without qualities: (by, seq, cnt), one shuffle of partial counts."""
    return reads.groupBy(by, "seq").agg(F.count("*").alias("cnt"))


def ranked(uniques: DataFrame, by: str | None = "sample") -> DataFrame:
    """uniques with `rank` from 1: the commonest first, of equals by sequence."""
    order = Window.partitionBy(by) if by else Window.partitionBy()
    return uniques.withColumn("rank", F.row_number().over(order.orderBy(F.desc("cnt"), "seq")))


def pooled(uniques: DataFrame, double_first: bool = False) -> DataFrame:
    """pool(seq, cnt, per_sample, qual_sum): the samples' uniques together. double_first counts the
    qualities of each entry's first sample twice, as a known implementation does."""
    parts = uniques.select("sample", "seq", "cnt", F.posexplode_outer("qual_sum").alias("at", "s"))
    if double_first:
        first = Window.partitionBy("seq", "at").orderBy("sample")
        parts = parts.withColumn("s", F.when(F.row_number().over(first) == 1, 2 * F.col("s")).otherwise(F.col("s")))
    sums = parts.groupBy("seq", "at").agg(F.sum("s").alias("s")).groupBy("seq").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "s")))).alias("q"))
    totals = uniques.groupBy("seq").agg(F.sum("cnt").alias("cnt"), F.array_sort(F.collect_list(F.struct("sample", "cnt"))).alias("per_sample"))
    return totals.join(sums, "seq").select("seq", "cnt", "per_sample", F.transform("q", lambda x: x["s"]).alias("qual_sum"))
