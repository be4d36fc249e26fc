"""Species by exact or nearly exact match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.sequences import hamming, reverse_complement


@dataclass(frozen=True)
class SpeciesConfig:
    allow_multiple: bool = False
    n_mismatch: int = 0


def species_refs(refs: DataFrame) -> DataFrame:
    """(seq, genus, species), upper-cased and in both directions, of the references whose description has
    two words or more."""
    parts = F.split(F.trim(F.regexp_replace("description", r"\s+", " ")), " ")
    named = refs.where(F.size(parts) >= 2).select(F.upper("seq").alias("seq"), parts[0].alias("genus"), parts[1].alias("species"))
    return named.union(named.select(reverse_complement(F.col("seq")), "genus", "species")).distinct()


def _near(queries: DataFrame, refs: DataFrame, n: int) -> DataFrame:
    """Hits of equal length with at most n differing letters: of n + 1 chunks one is equal at least, so an
    equi-join on (length, chunk's number, chunk) finds them."""
    k = n + 1
    size = F.length("seq")
    bound = lambda i: F.floor(size * i / k).cast("int")
    chunks = F.array(*(F.substring(F.col("seq"), bound(i) + 1, bound(i + 1) - bound(i)) for i in range(k)))
    cut = lambda df: df.select("*", size.alias("size"), F.posexplode(chunks).alias("no", "chunk"))
    r = cut(refs).withColumnRenamed("seq", "ref_seq")
    pairs = cut(queries).join(r, ["size", "no", "chunk"]).where(hamming(F.col("seq"), F.col("ref_seq")) <= n)
    return pairs.select("qid", "genus", "species").distinct()


def species_hits(queries: DataFrame, refs: DataFrame, config: SpeciesConfig = SpeciesConfig()) -> DataFrame:
    """(qid, genus, species), distinct: exact hits, and for queries without any, near ones."""
    known = species_refs(refs)
    own = queries.select("qid", F.upper("seq").alias("seq"))
    exact = own.join(known, "seq").select("qid", "genus", "species").distinct()
    if config.n_mismatch == 0:
        return exact
    return exact.union(_near(own.join(exact, "qid", "left_anti"), known, config.n_mismatch))


def assign_species(queries: DataFrame, refs: DataFrame, config: SpeciesConfig = SpeciesConfig()) -> DataFrame:
    """(qid, genus, species) of every query: the hit if there is one only; with allow_multiple the genus if
    it is one, and all species joined by '/'; else nulls."""
    seen = species_hits(queries, refs, config).groupBy("qid").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("genus")).alias("gs"), F.array_sort(F.collect_set("species")).alias("ss"))
    some = F.lit(True) if config.allow_multiple else F.col("n") == 1
    genus = F.when(some & (F.size("gs") == 1), F.col("gs")[0])
    species = F.when(some, F.array_join("ss", "/"))
    return queries.select("qid").join(seen, "qid", "left").select("qid", genus.alias("genus"), species.alias("species"))


def add_species(taxonomy: DataFrame, assigned: DataFrame) -> DataFrame:
    """taxonomy(qid, ..., genus, ...) with the assigned species, where either genus is unknown or both are
    the same."""
    got = assigned.select("qid", F.col("genus").alias("_genus"), F.col("species").alias("_species"))
    agrees = F.col("genus").isNull() | F.col("_genus").isNull() | (F.col("genus") == F.col("_genus"))
    return taxonomy.join(got, "qid", "left").withColumn("species", F.when(agrees, F.col("_species"))).drop("_genus", "_species")
