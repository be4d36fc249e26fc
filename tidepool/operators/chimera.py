"""Chimeras: variants whose beginning is one commoner variant's and whose rest is another's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.tables import stored

MIN_ARM = 8
BASES = "ACGT"


def _named(part: Column) -> list[Column]:
    """128 bits that stand for a part of a sequence."""
    return [F.xxhash64(F.lit(1), part).alias("h1"), F.xxhash64(F.lit(2), part).alias("h2")]


def chimeras(asvs: DataFrame, by: str = "sample") -> DataFrame:
    """The rows (by, id) of asvs(by, id, seq, abundance) that are chimeras: with two other rows p1, p2 of the
    group, both strictly commoner, and L the shortest of the three lengths, the sequence first differs from
    p1 at x within L, x >= 8, L - x >= 8, and equals p2 from x to L. Every row is judged against all rows.

    No pair of rows is ever formed, so a beginning that all sequences share costs no more than another.
    Left arms: each row meets the others under each of its beginnings, and running minima over those that
    are strictly commoner and go on with another letter give the shortest p1 for each x. Of equal ends the
    greatest x leaves the least to match, so a row has one left arm for each length of p1. Right arms: the
    ends that are asked for, (x, end), are cut out of all rows, and each end's greatest abundance decides.
    p1 and p2 need no check: they differ at x.
    """
    rows = asvs.select(F.col(f"`{by}`").alias("g"), "id", "seq", F.col("abundance").cast("long").alias("abundance"), F.length("seq").alias("size")).where(F.length("seq") >= 2 * MIN_ARM)
    rows = stored(rows, "asvs")  # read three times, and the end of a long pipeline
    starts = rows.select("*", F.explode(F.sequence(F.lit(MIN_ARM), F.col("size") - MIN_ARM)).alias("x"))
    starts = starts.select("g", "id", "abundance", "size", "x", F.substring(F.col("seq"), F.col("x") + 1, F.lit(1)).alias("next"), *_named(F.substring(F.col("seq"), F.lit(1), F.col("x"))))
    commoner = Window.partitionBy("g", "x", "h1", "h2").orderBy(F.desc("abundance")).rangeBetween(Window.unboundedPreceding, -1)
    by_letter = {f"p_{c}": F.min(F.when(F.col("next") == c, F.col("size"))).over(commoner) for c in BASES}
    odd = F.collect_set(F.when(~F.col("next").isin(*BASES), F.struct("next", "size"))).over(commoner)  # letters that are no bases
    shortest = [F.when(F.col("next") != c, F.col(f"p_{c}")) for c in BASES]
    others = F.array_min(F.transform(F.filter("p_odd", lambda o: o["next"] != F.col("next")), lambda o: o["size"]))
    left = starts.withColumns({**by_letter, "p_odd": odd}).withColumn("p1", F.least(*shortest, others)).where("p1 is not null")
    arms = left.groupBy("g", "id", F.least("size", "p1").alias("end")).agg(F.max("x").alias("x"))

    # An end is either reached by a longer p2, or is p2's own: then it may lie before the end of p1.
    sizes = rows.groupBy("g").agg(F.collect_set("size").alias("sizes"))
    ends = F.concat(F.array(F.struct(F.col("end").alias("end"), F.lit(False).alias("own"))), F.transform(F.filter("sizes", lambda n: (n < F.col("end")) & (n >= F.col("x") + MIN_ARM)), lambda n: F.struct(n.alias("end"), F.lit(True).alias("own"))))
    wanted = arms.join(sizes, "g").select("g", "id", F.explode(ends).alias("e"), "x").select("g", "id", "x", "e.end", "e.own")
    cuts = wanted.groupBy("g").agg(F.collect_set(F.struct("x", "end", "own")).alias("cuts"))  # at most lengths squared
    reached = F.filter("cuts", lambda c: F.col("size") >= c["end"])
    parts = rows.join(cuts, "g").select("g", "id", "seq", "size", "abundance", F.explode(reached).alias("c")).select("g", "id", "seq", "size", "abundance", "c.x", "c.end", "c.own")
    parts = parts.select("g", "id", "size", "abundance", "x", "end", "own", *_named(F.substring(F.col("seq"), F.col("x") + 1, F.col("end") - F.col("x"))))
    p2 = F.when(~F.col("own") | (F.col("size") == F.col("end")), F.col("abundance"))
    matched = parts.withColumn("most", F.max(p2).over(Window.partitionBy("g", "x", "end", "own", "h1", "h2"))).where("most > abundance")
    return matched.join(wanted, ["g", "id", "x", "end", "own"], "left_semi").select("g", "id").distinct().withColumnRenamed("g", by)


def remove_chimeras(asvs: DataFrame, by: str = "sample") -> DataFrame:
    """asvs(by, seq, abundance) without chimeras."""
    named = asvs.withColumn("id", F.col("seq")) if "id" not in asvs.columns else asvs
    out = named.join(chimeras(named, by), [by, "id"], "left_anti")
    return out.select([f"`{c}`" for c in asvs.columns])


def chimera_mask(table: DataFrame) -> DataFrame:
    """(seq, is_chimera) of a long table (sample, seq, cnt), by the sequences' totals."""
    totals = table.groupBy("seq").agg(F.sum("cnt").alias("abundance")).withColumns({"all": F.lit(1), "id": F.col("seq")})
    return totals.select("seq").join(chimeras(totals, "all").select(F.col("id").alias("seq"), F.lit(True).alias("bad")), "seq", "left").select("seq", F.coalesce("bad", F.lit(False)).alias("is_chimera"))
