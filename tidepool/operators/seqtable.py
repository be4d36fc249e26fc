"""Sample x variant tables, in long form: (sample, seq, cnt). They become wide at a sink only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.sequences import reverse_complement


def make_table(asvs: DataFrame, overwrite: bool = False) -> DataFrame:
    """Counts of asvs(sample, seq, abundance). A sequence that a sample has twice is summed, or with
    `overwrite` its last row (by `place`) counts."""
    if overwrite:
        return asvs.groupBy("sample", "seq").agg(F.max_by("abundance", "place").alias("cnt"))
    return asvs.groupBy("sample", "seq").agg(F.sum("abundance").alias("cnt"))


def column_order(table: DataFrame) -> DataFrame:
    """(seq, total): the columns' totals; a wide table has the greatest first, of equals by sequence."""
    return table.groupBy("seq").agg(F.sum("cnt").alias("total"))


def with_samples(table: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, total): samples without any variant have 0."""
    totals = table.groupBy("sample").agg(F.sum("cnt").alias("total"))
    return samples.select("sample").distinct().join(totals, "sample", "left").fillna(0, ["total"])


def merge_tables(tables: list[DataFrame], repeats: str = "error", try_rc: bool = False) -> DataFrame:
    """One long table of several. repeats says what becomes of a sequence that one table has twice for a
    sample: `error`, `sum`, or `first` (by `place`). A sample in two tables is an error. With try_rc a
    sequence whose reverse complement is in the first table takes that one's name; should two of a
    sample's then have one name they are summed."""
    if repeats not in ("error", "sum", "first"):
        raise ValueError(f"unknown repeats: {repeats}")

    def single(t: DataFrame) -> DataFrame:
        if repeats == "first":
            return t.groupBy("sample", "seq").agg(F.min_by("cnt", "place").alias("cnt"))
        total = t.groupBy("sample", "seq").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n"))
        if repeats == "error":
            wrong = F.raise_error(F.concat(F.lit("a table has this sequence twice: "), F.col("seq"))).cast("bigint")
            total = total.withColumn("cnt", F.when(F.col("n") > 1, wrong).otherwise(F.col("cnt")))
        return total.select("sample", "seq", "cnt")

    parts = [single(t).withColumn("source", F.lit(i)) for i, t in enumerate(tables)]
    whole = reduce(DataFrame.unionByName, parts)
    if try_rc:
        names = parts[0].select(F.col("seq").alias("name"), reverse_complement(F.col("seq")).alias("seq")).distinct()
        whole = whole.join(names, "seq", "left").withColumn("seq", F.when(F.col("source") > 0, F.coalesce("name", "seq")).otherwise(F.col("seq")))
    owners = whole.groupBy("sample").agg(F.count_distinct("source").alias("tables"))
    wrong = F.raise_error(F.concat(F.lit("two tables have the sample "), F.col("sample"))).cast("bigint")
    checked = whole.join(owners, "sample").withColumn("cnt", F.when(F.col("tables") > 1, wrong).otherwise(F.col("cnt")))
    return checked.groupBy("sample", "seq").agg(F.sum("cnt").alias("cnt"))


def get_uniques(found: DataFrame) -> DataFrame:
    """(seq, cnt) of what any step gives: distinct reads (cnt), variants (abundance), or merged pairs
    (sequence, abundance, accept), of which those count that are accepted."""
    names = set(found.columns)
    if "accept" in names:
        found = found.where("accept")
    seq = next((c for c in ("seq", "sequence") if c in names), None)
    n = next((c for c in ("cnt", "abundance") if c in names), None)
    if not seq or not n:
        raise ValueError("neither distinct reads nor variants nor merged pairs")
    return found.select(F.col(seq).alias("seq"), F.col(n).alias("cnt"))


def get_sequences(found: DataFrame) -> DataFrame:
    """(seq), a row for each row of get_uniques."""
    return get_uniques(found).select("seq")
